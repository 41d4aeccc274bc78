"""SimHash near-duplicates by deletion-variant signatures.

A text's words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; its shingles are ``shingle`` consecutive words,
repeats included, joined by one space (a shorter text is one shingle, a text without words has fingerprint zero).
Bit i of the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.

Two fingerprints link if they differ in at most ``distance`` bits. The 64 bits are cut into ``distance // 2 + 1``
segments, too few for two differing bits in each: of two linked fingerprints one segment differs by one bit at most.
Each fingerprint is indexed under its segments with one bit deleted (64 variants in all), variants meet by an equality
shuffle, and what meets is verified on all 64 bits. Copies are collapsed first; what meets under one variant is never
expanded into pairs: a search that visits each fingerprint once yields a spanning star of what is linked.
A variant shared by more than ``BLOCK`` fingerprints is dealt out as pairs of blocks, which is exact too.

``representatives`` uses the same index to find candidates only, in several independent fingerprints of the distinct words,
and takes two texts for near copies if the Jaccard similarity of their distinct five-word shingles is 0.8 or more, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.llm._shared import connected_components, materialize, release, slices, texts

SEED = 42
#: Fingerprints of one variant that one task compares at once; more are split into blocks.
BLOCK = 32768
#: Fingerprints of one variant that are all paired; more meet at the most central one first.
FEW = 32
#: Bins of a sketch of shingles, and how far below a similarity its estimate may be: over two deviations.
BINS, SLACK = 512, 0.035
#: Rows that may be sent to all tasks: 8 to 24 bytes each.
SENT = 1 << 20
#: For counting bits byte by byte: each byte's lane, and the eight bits of each byte value.
_LANES = np.arange(8, dtype=np.uint16) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of ``hashes``."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts = np.bincount((part.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
        votes += (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole if there are fewer words; none without words."""
    words = text.lower().split()  # bytes: only A-Z and the six ASCII spaces count
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(chain((0,), map(int(1).__add__, ends)), ends[shingle - 1 :])], "<u8")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one UTF-8 text."""
    hashes = shingle_hashes(text, shingle)
    return int(hashes[0]) if len(hashes) == 1 else _majority(hashes) if len(hashes) else 0


def word_fingerprints(text: bytes, n: int) -> list[int]:
    """``n`` independent fingerprints of the distinct words: all derived from one hash of each word."""
    words = set(text.lower().split())
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for k in range(n):
        if k:
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
        out.append(_majority(h) if len(h) else 0)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``: the fingerprint as a signed 64-bit integer; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(marks)], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def segments(distance: int) -> list[int]:
    """For each of the 64 bits the mask of its segment: as many segments as leave one with at most one wrong bit."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    return [next(m for m in masks if m >> b & 1) for b in range(64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Union:
    """Disjoint sets whose root is the least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (p := self.up.get(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            self.up[y] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))


def link_bucket(fps: np.ndarray, distance: int, join: Callable[[int, int], None]) -> None:
    """Call ``join`` for a spanning set of the links among the fingerprints of one bucket.

    Breadth-first: each visited fingerprint is compared with those not yet reached only, so a dense group of near copies
    costs about one comparison per member.
    """
    left = np.unique(fps)
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= distance
            if near.any():
                found, left = left[near], left[~near]
                for y in found.tolist():
                    join(int(x), y)
                todo.extend(found)


def _masked(distance: int) -> tuple[Column, list[int], list[int]]:
    """The column fp without the segment bits that variant ``bit`` leaves out; each bit's segment; first bits of segments."""
    masks = segments(distance)
    hole = F.array(*[F.lit(_signed(m & ~(1 << b))) for b, m in enumerate(masks)])
    return F.col("fp").bitwiseAND(F.get(hole, F.col("bit").cast("int"))), masks, [b for b in range(64) if b == 0 or masks[b] != masks[b - 1]]


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """The rows of ``fps`` (fp, ...) under each of their 64 variants: with bit and m, the masked fingerprint, and part.

    One count for each segment tells which variants may be too common for one task; those are dealt as pairs of blocks of
    about BLOCK, all pairs of which have a part of their own."""
    own = fps.columns
    key, masks, firsts = _masked(distance)
    seed = "seed" if "seed" in own else None
    by = [seed] if seed else []
    cut = F.array(*[F.struct(F.lit(b).cast("byte").alias("first"), F.col("fp").bitwiseAND(F.lit(_signed(masks[b]))).alias("s")) for b in firsts])
    common = fps.select(*by, F.explode(cut).alias("k")).groupBy(*by, "k.first", "k.s").count().where(F.col("count") > BLOCK // 2)
    seg = F.array(*[F.lit(_signed(m)) for m in masks])
    common = common.select(*by, F.col("s").alias("fp"), "count", "first", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where(F.get(seg, F.col("bit")) == F.get(seg, F.col("first").cast("int")))
    common = common.groupBy(*by, F.col("bit").cast("byte").alias("bit"), key.alias("m")).agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    common = materialize(common, "common-variants")
    keys = fps.select(*own, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(*own, F.col("bit").cast("byte").alias("bit"), key.alias("m"))
    if common.isEmpty():
        return keys.withColumn("part", F.lit(0))
    n = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n).cast("int")
    keys = keys.join(common, [*by, "bit", "m"], "left").select(*own, "bit", "m", n.alias("n"), mine.alias("mine"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    return keys.select(*own, "bit", "m", (F.least("mine", "other") * F.col("n") + F.greatest("mine", "other")).alias("part"))


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str], cols: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of batches sorted by ``key``: the arrays of ``cols`` in pieces that end with a group, and where groups start and end."""
    kept = None
    for b in batches:
        part = [b.column(c).to_numpy(zero_copy_only=False) for c in (*key, *cols)]
        part = [np.concatenate(x) for x in zip(kept, part)] if kept is not None else part
        if not len(part[0]):
            continue
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in part[: len(key)]])) + 1
        if len(new):
            yield [c[: new[-1]] for c in part], np.concatenate([[0], new])
        kept = [c[new[-1] if len(new) else 0 :] for c in part]
    if kept is not None and len(kept[0]):
        yield kept, np.array([0, len(kept[0])])


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``fps`` (fp): they connect exactly those that chains of links connect.

    Two fingerprints link within ``distance`` bits. An empty table gives no edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Union()
        for (_, _, _, fp), edge in _grouped(batches, ["bit", "m", "part"], ["fp"]):
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance] if len(two) else two
            for a, b in zip(fp[near].tolist(), fp[near + 1].tolist()):
                sets.join(a, b)
            for i in np.flatnonzero(size > 2).tolist():
                link_bucket(fp[edge[i] : edge[i + 1]], distance, sets.join)
        nodes = list(sets.up)
        for at in range(0, len(nodes), 10000):
            part = nodes[at : at + 10000]
            yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([sets.root(x) for x in part], pa.int64())})

    dealt = variants(fps.select("fp"), distance).repartition("bit", "m", "part").sortWithinPartitions("bit", "m", "part")
    return dealt.mapInArrow(run, "u long, v long").where("u <> v")


def first_meeting(x: np.ndarray, bit: int, masks: list[int], distance: int) -> np.ndarray:
    """Whether fingerprints that differ by ``x`` are within ``distance`` and have the variant ``bit`` as their first in common:
    each pair has one such variant, wherever else it meets."""
    good = np.bitwise_count(x) <= distance
    own = np.uint64(masks[bit])
    for m in dict.fromkeys(masks):
        if m == masks[bit]:
            break
        good &= np.bitwise_count(x & np.uint64(m)) > 1
    first = masks[bit] & -masks[bit] == 1 << bit
    inside = x & own
    return good & ((inside == np.uint64(1 << bit)) | ((inside == 0) if first else False))


def meetings(fps: DataFrame, distance: int) -> DataFrame:
    """(u, v, seed, bit, m): candidates u < v among the nodes of ``fps`` (node, seed, fp), each once a seed, from variants of at
    most FEW fingerprints; of larger ones those with the most central, and a row without u for the variant."""
    masks = segments(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (seed, bit, m, _, fp, node), edge in _grouped(batches, ["seed", "bit", "m", "part"], ["fp", "node"]):
            fp = fp.view(np.uint64)
            u, v, big = [], [], []
            for i in np.flatnonzero(np.diff(edge) > 1).tolist():
                a, b = edge[i], edge[i + 1]
                if b - a <= FEW:
                    p, q = np.triu_indices(b - a, 1)
                    p, q = p + a, q + a
                    good = first_meeting(fp[p] ^ fp[q], int(bit[a]), masks, distance)
                    u.append(node[p[good]])
                    v.append(node[q[good]])
                else:
                    middle = np.uint64(_majority(np.ascontiguousarray(fp[a:b])))
                    hub = a + int(np.bitwise_count(fp[a:b] ^ middle).argmin())
                    near = a + np.flatnonzero(first_meeting(fp[a:b] ^ fp[hub], int(bit[a]), masks, distance))
                    near = near[near != hub]
                    u.append(node[near])
                    v.append(np.full(len(near), node[hub]))
                    big.append(a)
            lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
            n, k = len(lo), len(big)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(np.minimum(lo, hi)), pa.nulls(k, pa.int64())]), pa.concat_arrays([pa.array(np.maximum(lo, hi)), pa.nulls(k, pa.int64())]),
                *(pa.concat_arrays([pa.nulls(n, t), pa.array(c[big], t)]) for c, t in ((seed, pa.int32()), (bit, pa.int8()), (m, pa.int64()))),
            ], ["u", "v", "seed", "bit", "m"])

    dealt = variants(fps, distance).repartition("seed", "bit", "m", "part").sortWithinPartitions("seed", "bit", "m", "part")
    return dealt.mapInArrow(run, "u long, v long, seed int, bit byte, m long")


def sketch(text: bytes, shingle: int) -> np.ndarray:
    """One-permutation MinHash: a byte of the least shingle hash of each bin, 0 where there is none."""
    h = shingle_hashes(text, shingle)
    least = np.full(BINS, (1 << 64) - 1, np.uint64)
    np.minimum.at(least, (h % np.uint64(BINS)).astype(np.int64), h // np.uint64(BINS))
    return np.where(least == np.uint64((1 << 64) - 1), 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def likely(one: np.ndarray, many: np.ndarray, least: float) -> np.ndarray:
    """Which sketches ``many`` may be of texts as similar to that of ``one`` as ``least``."""
    either = ((many != 0) | (one != 0)).sum(1)
    return ((many == one) & (one != 0)).sum(1) >= (least - SLACK) * either


def under(rows: DataFrame, wanted: DataFrame, distance: int) -> DataFrame:
    """The ``rows`` (node, root, seed, fp[, sketch]) under each of their variants that ``wanted`` (seed, bit, m, blocks) has, with
    bit, m and part: all pairs of blocks of a variant have a part of their own. Up to SENT variants are sent to all tasks, more
    are joined."""
    key, masks, _ = _masked(distance)
    names = rows.columns
    if wanted.count() > SENT:
        all_ = rows.select(*names, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(*names, F.col("bit").cast("byte").alias("bit"), key.alias("m"))
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        met = all_.join(wanted, ["seed", "bit", "m"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return met.withColumn("part", F.least(mine, "other") * F.col("blocks") + F.greatest(mine, "other")).select(*names, "bit", "m", "part")
    known = {(r["seed"], r["bit"], r["m"]): r["blocks"] for r in wanted.collect()}
    found: dict[tuple[int, int], list] = {}
    for (seed, bit, m), n in known.items():
        found.setdefault((seed, bit), []).append((m, n))
    at = {k: tuple(np.array(c, np.int64) for c in zip(*sorted(v))) for k, v in found.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            seed, fp, node = (b.column(c).to_numpy() for c in ("seed", "fp", "node"))
            for (s, bit), (ms, blocks) in at.items():
                masked = fp & np.int64(_signed(masks[bit] & ~(1 << bit)))
                place = np.minimum(np.searchsorted(ms, masked), len(ms) - 1)
                on = np.flatnonzero((seed == s) & (ms[place] == masked))
                if not len(on):
                    continue
                n = blocks[place[on]]
                mine = (node[on].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                row = np.repeat(np.arange(len(on)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                part = np.minimum(mine[row], other) * n[row] + np.maximum(mine[row], other)
                cols = [b.column(c).take(pa.array(on[row])) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(row), bit, np.int8)), pa.array(masked[on][row]), pa.array(part)], [*names, "bit", "m", "part"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", bit byte, m long, part long")


def across(fps: DataFrame, large: DataFrame, comps: DataFrame, distance: int, sketches: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Candidates (u, v) of different classes ``comps`` (u, root) that share one of the variants ``large`` (seed, bit, m) and
    whose ``sketches`` (of a table of nodes: node, sketch) may be as similar as ``least``."""
    masks = segments(distance)
    held = fps.join(comps.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialize(under(held, large.withColumn("blocks", F.lit(1)), distance), "large-variants")
    mixed = rows.groupBy("seed", "bit", "m").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = materialize(mixed.select("seed", "bit", "m", F.ceil(F.col("n") / 4096).cast("int").alias("blocks")), "mixed-variants")
    marks = materialize(sketches(rows.select("node").distinct()), "sketches")
    dealt = under(held.join(marks, "node"), mixed, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bit, _, _, fp, node, root, mark), edge in _grouped(batches, ["seed", "bit", "m", "part"], ["fp", "node", "root", "sketch"]):
            fp, mark = fp.view(np.uint64), np.frombuffer(b"".join(mark), np.uint8).reshape(-1, BINS)
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(edge.tolist(), edge[1:].tolist()):
                for i in range(a, b):
                    j = i + 1 + np.flatnonzero(root[i + 1 : b] != root[i])
                    j = j[first_meeting(fp[j] ^ fp[i], int(bit[a]), masks, distance)]
                    j = j[likely(mark[i], mark[j], least)] if len(j) else j
                    if len(j):
                        u.append(np.minimum(node[i], node[j]))
                        v.append(np.maximum(node[i], node[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    by = ["seed", "bit", "m", "part"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long").distinct()


def similar(pairs: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """The rows (u, v) of ``pairs`` whose texts in ``nodes`` (node, text) have distinct shingles of Jaccard similarity ``least``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], ["node", "held"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            good = []
            for x, y in zip(b.column("one").to_pylist(), b.column("two").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    involved = materialize(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "involved")
    held = nodes.join(F.broadcast(involved) if involved.count() <= SENT else involved, "node", "left_semi")
    held = held.mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.first("held").alias("held"))  # repeated rows
    held = materialize(held, "shingles")
    one, two = (held.select(F.col("node").alias(end), F.col("held").alias(side)) for end, side in (("u", "one"), ("v", "two")))
    met = pairs.select("u", "v").join(one, "u").join(two, "v").select("u", "v", "one", "two")
    out = materialize(met.mapInArrow(check, "u long, v long"), "near-copies")
    release(involved, held)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Each row's (doc_id, fp, component_id): the smallest doc_id that chains of links reach, its own included.

    Null texts count as empty; rows with equal doc_ids are kept as they are; a null doc_id takes part in the links but is
    never a component's id (null only where a whole component has no doc_id). Other columns are ignored; an empty table
    gives no rows.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = materialize(reps, "distinct-fingerprints")
    comps = connected_components(links(reps.select("fp"), distance), "fp", "root")
    rooted = materialize(reps.join(comps, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    labels = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = 5, least: float = 0.8, distance: int = 5, seeds: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of near copies.

    Two texts are near copies if their distinct ``shingle``-word shingles have a Jaccard similarity of ``least`` or more; it is
    checked exactly on all pairs that one of ``seeds`` independent fingerprints of the distinct words brings together within
    ``distance`` bits; in groups of more than FEW only on those with sketches within SLACK of it. Chains of near copies make groups. The smallest doc_id stays (null last; of rows with one doc_id the
    least hash of the row; of repeated rows one). Texts without words, null ones among them, are copies of each other.
    Columns may have any names; an empty table gives no rows.
    """
    key = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = texts(b)
            own = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in raw]
            fps = np.array([word_fingerprints(t, seeds) for t in raw], np.uint64).reshape(-1, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "r1", "r2")), pa.array(own, pa.binary()), pa.array(list(fps), pa.list_(pa.int64()))], ["doc_id", "r1", "r2", "own", "fps"])

    rows = docs.select("doc_id", "text", *key)
    marked = materialize(rows.mapInArrow(mark, f"doc_id {dict(rows.dtypes)['doc_id']}, r1 long, r2 long, own binary, fps array<long>"), "marks")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "r1", "r2")).alias("first")
    nodes = marked.groupBy("own").agg(place, F.first("fps").alias("fps")).select(F.monotonically_increasing_id().alias("node"), "first", "fps")
    nodes = materialize(nodes, "nodes")  # which fixes the numbers
    release(marked)
    fps = nodes.select("node", F.posexplode("fps").alias("seed", "fp"))
    met = materialize(meetings(fps, distance), "meetings")
    kept = nodes.select("node", F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2"))
    held = rows.select("text", "r1", "r2")
    pairs = materialize(met.where("u is not null").select("u", "v").distinct(), "candidates")

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted.join(kept, "node"), "wanted")
        small = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        return held.join(small, ["r1", "r2"]).select("node", "text")

    def verify(pairs: DataFrame) -> DataFrame:
        return similar(pairs, texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), shingle, least)

    def sketches(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([sketch(t, shingle).tobytes() for t in texts(b)], pa.binary())], ["node", "sketch"])

        return texts_of(wanted).mapInArrow(run, "node long, sketch binary").groupBy("node").agg(F.first("sketch").alias("sketch"))

    edges = verify(pairs)
    large = met.where("u is null").select("seed", "bit", "m").distinct()
    if not large.isEmpty():
        comps = connected_components(edges, "u", "root")
        edges = edges.unionByName(verify(materialize(across(fps, large, comps, distance, sketches, least), "candidates-across")))
    comps = connected_components(edges, "node", "root")
    rooted = nodes.join(comps, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = materialize(rooted.groupBy("root").agg(F.min("first").alias("f")).select("f.r1", "f.r2"), "kept")
    release(met, pairs)
    names = F.struct("*").alias("row")
    out = docs.select(names, *key).join(stay, ["r1", "r2"], "left_semi")
    one = out.withColumn("n", F.row_number().over(W.partitionBy("r1", "r2").orderBy("r1"))).where("n = 1")
    return one.select("row.*")
