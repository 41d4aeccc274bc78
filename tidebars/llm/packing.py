"""Packing documents into sequences: a configuration linear program over the length histogram.

Documents are encoded (``bpe``), closed by an end id and cut into pieces of at most ``width`` ids. What is optimised is the
histogram of piece lengths, at most ``width`` numbers whatever the corpus: lengths are rounded to classes, a covering
program over configurations (how many pieces of each class stand in one sequence) is solved by multiplicative weights, whose
oracle prices configurations by a knapsack dynamic program, and its solution is rounded down; what that leaves over is solved
again, and again. A configuration takes the lengths most often left in its classes, and as its last piece the one that makes it
exact. Pieces that stay over, about one in a hundred, go longest first, each into the smallest gap that holds it; like all of
this, on counts of equal sequences. The weights also give a bound below which no packing can be. The number of sequences is
checked against plain best fit: while it is larger, the least full sequences of the program are given back. Pieces get their places
by their number among those of one length, counted in two steps so that no length, however frequent, is one task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.llm._shared import materialize, partitions, slices
from tidebars.llm.bpe import codec

#: A sequence's make-up: (length, how many), longest first.
Config = tuple[tuple[int, int], ...]
#: How much of its solution the program takes by turn, so that no class runs out before the rest is solved again; then all.
SHARE = (0.6, 0.6, 0.7, 0.8)


def pieces(docs: DataFrame, path: str, width: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids, closed by ``end``, cut at ``width``.

    A null text counts as empty: one piece that holds the end id only. Repeated rows and null doc_ids are packed like any
    other; further columns are ignored.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    close = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 4 << 20):
            rows, cols = [], [[] for _ in names[1:]]
            for i, t in enumerate(b.column("text").to_pylist()):
                raw = memoryview(c.encode(t or "") + close)
                for n, at in enumerate(range(0, len(raw), 4 * width)):
                    part = raw[at : at + 4 * width]
                    rows.append(i)
                    for col, x in zip(cols, (n, at // 4, len(part) // 4, zlib.crc32(part), bytes(part) if ids else b"")):
                        col.append(x)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, kinds))], names)
        c.rest()

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration's value and how many of each class it holds: unbounded knapsack by dynamic programming."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for u in range(1, capacity + 1):
        best[u] = best[u - 1]
        if fits[u]:
            gain = best[u - sizes[: fits[u]]] + values[: fits[u]]
            j = int(gain.argmax())
            if gain[j] > best[u]:
                best[u], take[u] = gain[j], j
    out, u = np.zeros(len(sizes), np.int64), capacity
    while u > 0:
        if take[u] < 0:
            u -= 1
        else:
            out[take[u]] += 1
            u -= sizes[take[u]]
    return float(best[capacity]), out


def fractional(counts: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int = 800, rate: float = 0.1) -> tuple[list[tuple[float, np.ndarray]], np.ndarray]:
    """Configurations and how often to use each, so that every class is covered as often as it occurs; and the prices of the
    classes that gave the best lower bound.

    Multiplicative weights for covering: a class's weight falls exponentially with its coverage; each round adds the
    configuration that is worth most at the present weights, as often as the class that it covers fastest allows. Ends when
    the cover is within a thousandth of the bound, or after ``rounds``.
    """
    cover, used = np.zeros(len(counts)), Counter()
    weight, low, dual, total = sizes / (counts * sizes).sum(), 0.0, sizes.astype(float), 0.0
    volume = 0.01 * weight  # of worth beside the weights: leaves no room that a class without weight could use
    for _ in range(rounds):
        worth = weight + volume
        value, config = price(worth, sizes, capacity)
        if (counts @ worth) / value > low:
            low, dual = float(counts @ worth) / value, worth / value
        on = config > 0
        step = float((counts[on] / config[on]).min())
        total += step
        used[config.tobytes()] += step
        cover[on] += step * config[on] / counts[on]
        weight = weight * np.exp(-rate * step * config / counts)
        weight /= counts @ weight
        least = cover.min()
        if least > 0 and total / least <= low * 1.001:
            break
    scale = max(cover.min(), 1e-9)
    return sorted(((x / scale, np.frombuffer(k, np.int64)) for k, x in used.items()), key=lambda p: (-p[0], p[1].tobytes())), dual


def classed(left: dict[int, int], unit: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], bool]:
    """Sizes (in units), counts and lengths (longest first) of the classes, and whether they are dense, four lengths a class or
    more: then lengths are rounded to the nearest multiple of ``unit``, else up, as little can make good for it."""
    lengths = sorted((n for n, c in left.items() if c), reverse=True)
    dense = len(lengths) >= 4 * len({n // unit for n in lengths})
    group: dict[int, list[int]] = {}
    for n in lengths:
        group.setdefault(max(1, (2 * n + unit) // (2 * unit)) if dense else -(-n // unit), []).append(n)
    sizes = sorted(group)
    return np.array(sizes), np.array([sum(left[n] for n in group[s]) for s in sizes], float), [group[s] for s in sizes], dense


def _filled(config: np.ndarray, sizes: list[int], group: list[list[int]], left: dict[int, int], order: list[int], width: int, unit: int, spare: int | None) -> dict[int, int]:
    """Lengths (and how many of each) for a configuration of rounded classes, from those ``left`` (``order``: sorted).

    Each class gives the lengths most often left; the smallest piece is the longest, near its class, that the others leave
    room for. Empty if there are too few, or if the gap is larger than the configuration's own by more than ``spare`` (None: if
    there is a gap).
    """
    kinds = [j for j in np.flatnonzero(config).tolist()[::-1] for _ in range(int(config[j]))]
    own = max(0, width - unit * sum(sizes[j] for j in kinds))
    made: Counter = Counter()
    often = lambda n: left[n] // (made[n] + 1)
    gap, tail = width, unit * sum(sizes[j] for j in kinds[-2:])
    many = len(kinds) > 16  # rounding may add up to pieces: takes fewer or more
    body = kinds[:-2] + kinds[-1:] * (len(kinds) if many else 0)
    for at, j in enumerate(body):
        n = max(group[j], key=often)
        if many and (gap - n < tail // 2 or (at >= len(kinds) - 2 and gap <= tail * 3 // 2)):
            break
        if not often(n) or n > gap:
            return {}
        made[n] += 1
        gap -= n
    drift = tail if many else unit * (len(kinds) + 1) // 2
    least, most = unit * sizes[kinds[-1]] - drift, unit * sizes[kinds[-1]] + drift
    best = (0 if spare is None else spare + own, 0, 0, 0)
    for one in group[kinds[-2]] if len(kinds) > 1 else [0]:
        if one and not often(one):
            continue
        made[one] += 1
        at = bisect_right(order, min(gap - one, most)) - 1
        while at >= 0 and order[at] >= least and not often(order[at]):
            at -= 1
        if at >= 0 and order[at] >= least:
            two = order[at]
            best = min(best, (gap - one - two, -min(often(two), left.get(one, 1 << 60) // made[one]), one, two))
        made[one] -= 1
    if not best[1]:
        return {}
    made.update(n for n in best[2:] if n)
    return +made


def best_fit(open_: list[tuple[int, Config]], left: dict[int, int], width: int) -> list[tuple[int, Config]]:
    """Sequences ``open_`` with the pieces ``left`` added, longest first, each to the smallest gap that holds it."""
    left = dict(left)
    gaps: dict[int, list[tuple[int, Config]]] = {}
    order: list[int] = []

    def put(times: int, config: Config) -> None:
        gap = width - sum(n * k for n, k in config)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((times, config))

    for times, config in open_:
        put(times, config)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(order, n)
            if at == len(order):
                each = width // n
                full, rest = divmod(count, each)
                for times, k in ((full, each), (1 if rest else 0, rest)):
                    if times:
                        put(times, ((n, k),))
                break
            gap = order[at]
            times, config = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
                del gaps[gap]
            k = min(gap // n, count)
            use = min(times, count // k)
            for t, c in ((times - use, config), (use, _with(config, n, k))):
                if t:
                    put(t, c)
            count -= use * k
    return [x for g in gaps.values() for x in g]


def lower_bound(histogram: dict[int, int], width: int, dual: np.ndarray | None = None, sizes: np.ndarray | None = None, unit: int = 1) -> int:
    """No packing has fewer sequences: by volume, and by the program's prices, whatever they are, of lengths rounded down."""
    volume = sum(n * c for n, c in histogram.items())
    low = -(-volume // width)
    if dual is not None and len(dual):
        at = {n: n // unit for n in histogram}
        kinds = np.array(sorted({x for x in at.values() if x}))
        if len(kinds):
            worth = np.interp(kinds, sizes, dual)
            worth[kinds < sizes.min()] = dual[0] * kinds[kinds < sizes.min()] / sizes.min()
            top, _ = price(worth, kinds, width // unit)
            each = dict(zip(kinds.tolist(), (worth / max(top, 1e-12)).tolist()))
            low = max(low, int(np.ceil(sum(c * each.get(at[n], 0.0) for n, c in histogram.items()) - 1e-6)))
    return low


def solve(histogram: dict[int, int], width: int, classes: int = 256, small: int = 32, again: int = 6) -> list[tuple[int, Config]]:
    """(how many, make-up) of sequences that hold just the pieces in ``histogram`` (length -> count).

    Never more than best fit needs. Pieces shorter than ``width / small`` fill gaps only, if they are a fiftieth of all ids at most.
    """
    return planned(histogram, width, classes, small, again)[0]


def program(left: dict[int, int], width: int, classes: int = 256, small: int = 32, again: int = 6) -> tuple[list[tuple[int, Config]], int]:
    """Sequences that the program makes of the pieces ``left``, fullest first, and the bound. Some pieces stay over."""
    total, number = sum(n * c for n, c in left.items()), sum(left.values())
    unit = max(1, min(width // classes, total // max(1, 8 * number)))
    short = {n for n in left if n * small < width}
    if 50 * sum(n * left[n] for n in short) > total:
        short = set()
    rounds = max(50, 800 * classes * unit // width)
    low, open_, rest = lower_bound(left, width), [], dict(left)
    turn = 0
    while turn < again:
        sizes, counts, group, dense = classed({n: c for n, c in rest.items() if n not in short}, unit)
        if not len(sizes):
            break
        found, dual = fractional(counts, sizes, width // unit, rounds // 4 if turn else rounds)
        if not turn:
            low = max(low, lower_bound(left, width, dual, sizes, unit))
        last, before = turn == again - 1, len(open_)  # at last up, where no room is lost
        share = SHARE[turn] if dense and turn < len(SHARE) else 1.0
        spare = None if last else width if not dense else 0 if share < 1 else unit // 2
        order, names = sorted(n for n, c in rest.items() if c), sizes.tolist()
        for x, config in found:
            todo = int(np.ceil(x)) if last else int(x * share + 1e-9)
            while todo > 0 and (made := _filled(config, names, group, rest, order, width, unit, spare)):
                times = min([todo, *(rest[n] // k for n, k in made.items())])
                for n, k in made.items():
                    rest[n] -= k * times
                    if not rest[n]:
                        order.remove(n)
                open_.append((times, tuple(sorted(made.items(), reverse=True))))
                todo -= times
        if len(open_) == before and share == 1.0:
            turn = max(turn, again - 2)  # nothing is left to round down
        turn += 1
    return sorted(open_, key=lambda c: width - sum(n * k for n, k in c[1])), low


def planned(histogram: dict[int, int], width: int, classes: int = 256, small: int = 32, again: int = 6) -> tuple[list[tuple[int, Config]], int, int, int]:
    """``solve`` with the numbers of sequences of best fit and of the program, and the bound."""
    left = {n: c for n, c in histogram.items() if c > 0}
    whole: list[tuple[int, Config]] = [(left.pop(width), ((width, 1),))] if width in left else []
    full = sum(t for t, _ in whole)
    used = sum(t for t, _ in best_fit([], left, width))
    open_, low = program(left, width, classes, small, again)
    first = None
    while True:
        rest = Counter(left)
        for times, config in open_:
            for n, k in config:
                rest[n] -= k * times
        made = best_fit(open_, rest, width)
        count = sum(t for t, _ in made)
        first = count if first is None else first
        if count <= used:
            return whole + made, full + used, full + first, full + low
        open_ = open_[: len(open_) * 3 // 4]  # the fullest


def _with(config: Config, n: int, k: int) -> Config:
    made = Counter(dict(config))
    made[n] += k
    return tuple(sorted(made.items(), reverse=True))


def places(configs: list[tuple[int, Config]]) -> np.ndarray:
    """Rows (length, first number, first sequence, how many in each, first offset), by length and number: where the pieces
    of one length, numbered from 0, go."""
    rows, number, sequence = [], Counter(), 0
    for times, config in configs:
        offset = 0
        for n, k in config:
            rows.append((n, number[n], sequence, k, offset))
            number[n] += k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(rows: DataFrame, width: int = 4096) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ...: at most ``width`` long) with sequence_id and offset.

    Offsets are gapless from 0 in each sequence. Ties are broken by doc_id, piece and what else the rows hold; equal rows
    are interchangeable. An empty table gives no rows.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "pieces")
    parts = max(64, partitions(spark))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = materialize(rows.groupBy("length", "bucket").count(), "counts")
    histogram = dict(counts.groupBy("length").agg(F.sum("count")).collect())  # at most `width` rows
    table = places(solve({int(n): int(c) for n, c in histogram.items()}, width))
    order = W.partitionBy("length").orderBy("bucket")
    before = materialize(counts.select("length", "bucket", (F.sum("count").over(order) - F.col("count")).alias("before")), "before")
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("number", F.row_number().over(within) - 1).join(before.hint("merge"), ["length", "bucket"])  # dealt like the window
    numbered = numbered.withColumn("number", F.col("number") + F.col("before")).drop("before", "bucket")
    columns = [c for c in rows.columns if c != "bucket"]
    lengths = table[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table[:, 1].max(initial=0)) + 1
        keys = lengths * span + table[:, 1] if span < 1 << 48 else None
        for b in batches:
            n, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            if keys is not None:
                at = np.searchsorted(keys, n * span + np.minimum(number, span - 1), "right") - 1
            else:
                lo, hi = np.searchsorted(lengths, n, "left"), np.searchsorted(lengths, n, "right")
                at = np.array([i + np.searchsorted(table[i:j, 1], x, "right") - 1 for i, j, x in zip(lo, hi, number)], np.int64)
            _, first, sequence, each, offset = table[at].T
            rank = number - first
            extra = [pa.array(sequence + rank // each), pa.array(offset + rank % each * n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *extra], [*columns, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return numbered.select(*columns, "number").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, width: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each text."""
    return pack(pieces(docs, path, width, end), width)
