"""Substring dedup: seed on winnowed anchors, extend both ways, remove maximal repeats.

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``length`` consecutive words of one document. A word goes if a window that
covers it stands earlier too: in a smaller doc_id, or earlier in its own document.

* Seed: each window has an anchor, the least (last of equals) hash among its ``gram``-word grams. Equal windows have equal
  anchors, so documents join on anchors, about one for every six words, and only where an anchor occurs twice.
* Extend: around each repeated anchor stand the windows that chose it, one run of words reaching both ways. Equal runs
  (128-bit hashes of their words) match as a whole: all but the earliest go. Only the earliest of each distinct run is
  compared window by window (96-bit hashes), which finds where unequal runs still share ``length`` words or more.
* What goes is merged into maximal spans for each document.

Counts are pre-aggregated before they are shuffled and every table that is joined by a common key is written first, so
that the engine can split a key that many documents share. No pair of documents is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm._shared import let_go, materialize, release, slices, texts

#: Odd multipliers of the two rolling hashes.
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_WORD = (1 << 64) - 1
#: Runs whose windows a worker remembers having written.
_SEEN = 200_000


def rolling(hashes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of all ``n`` consecutive items: doubling steps, so about 2 log n passes."""
    done, out, size, power = 0, None, 1, base
    part = hashes
    while n:
        if n & 1:
            if out is None:
                out, done = part, size
            else:  # out covers `done` items from each start, part the next `size`
                keep = min(len(out), len(part) - done)
                out = out[:keep] * power + part[done : done + keep]
                done += size
        n >>= 1
        if n:
            part, size, power = part[: len(part) - size] * power + part[size:], size * 2, np.uint64(int(power) ** 2 & _WORD)
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def owners(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor; and the grams' hashes."""
    grams = rolling(hashes, gram, _BASE[0])
    span = length - gram + 1
    views, out = sliding_window_view(grams, span), []
    for at in range(0, len(views), 1 << 16):
        out.append(at + np.arange(len(v := views[at : at + (1 << 16)])) + span - 1 - v[:, ::-1].argmin(1))
    return np.concatenate(out), grams


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, rk, p): each anchor's hash, its row's key and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = [[], [], []]
            for rk, t in zip(b.column("rk").to_numpy(), texts(b)):
                words = t.split()
                if len(words) >= length:
                    at, grams = owners(word_hashes(words), length, gram)
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                    cols[0].append(grams[at].view(np.int64))
                    cols[1].append(np.full(len(at), rk))
                    cols[2].append(at.astype(np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "rk", "p"])

    return docs.select("rk", "text").mapInArrow(run, "h long, rk long, p int")


def runs(hits: DataFrame, length: int, gram: int) -> DataFrame:
    """(c1, c2, rk, ord, a, n, wins) for each run of windows with one repeated anchor: the hash of its words, its row, its
    first window, how many windows, and their hashes (null if this worker gave those of the same run before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in slices(batches, 4 << 20):
            out: list[tuple] = []
            for rk, order, t, pos in zip(b.column("rk").to_pylist(), b.column("ord").to_pylist(), texts(b), b.column("pos")):
                words = t.split()
                hashes = word_hashes(words)
                own, _ = owners(hashes, length, gram)
                fine = np.zeros(len(words), bool)
                fine[pos.values.to_numpy()] = True
                keep = fine[own]
                starts = np.flatnonzero(keep)
                if not len(starts):
                    continue
                cut = np.flatnonzero((np.diff(starts) > 1) | (np.diff(own[starts]) != 0)) + 1
                edge = [0, *cut.tolist(), len(starts)]
                one, two = (rolling(hashes, length, x) for x in _BASE)
                wins = np.empty(len(one), np.dtype([("x", "<i8"), ("y", "<i4")]))
                wins["x"], wins["y"] = one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for i, j in zip(edge, edge[1:]):
                    a, n = int(starts[i]), j - i
                    key = xxhash.xxh3_128_digest(b" ".join(words[a : a + n + length - 1]))
                    c = int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)
                    new = c not in seen
                    if new:
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(c)
                    out.append((*c, rk, order, a, n, wins[a : a + n].tobytes() if new else None))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return hits.mapInArrow(run, "c1 long, c2 long, rk long, ord long, a int, n int, wins binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["c1", "c2", "rk", "ord", "a", "n", "wins"])


def windows(leaders: DataFrame) -> DataFrame:
    """(w1, w2, rk, ord, s): the windows of ``leaders`` row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = b.column("wins").to_pylist()
            n = np.array([len(x) // 12 for x in raw])
            all_ = np.frombuffer(b"".join(raw), np.dtype([("x", "<i8"), ("y", "<i4")]))
            first = np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(b.column("a").to_numpy(), n) + np.arange(len(all_)) - first
            cols = [np.ascontiguousarray(all_["x"]), np.ascontiguousarray(all_["y"]), np.repeat(b.column("rk").to_numpy(), n), np.repeat(b.column("ord").to_numpy(), n), s.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "rk", "ord", "s"])

    return leaders.select("rk", "ord", "a", "wins").mapInArrow(run, "w1 long, w2 int, rk long, ord long, s int")


def keyed(docs: DataFrame) -> DataFrame:
    """(rk, ord, doc_id, text): a key of the row's doc_id and text, and the doc_id as the order of documents (null last)."""
    last = F.lit((1 << 63) - 1)
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.coalesce(F.col("doc_id").cast("long"), last).alias("ord"), "doc_id", "text")


def _by_row(spans: DataFrame) -> DataFrame:
    return spans.groupBy("rk").agg(F.collect_list(F.struct("s", "n")).alias("spans"))


def repeats(docs: DataFrame, length: int = 20, gram: int = 10) -> DataFrame:
    """(rk, spans): for each row of ``keyed(docs)`` with something to remove, runs of windows (start, count) that stand
    earlier too. All windows are compared, whatever their number. A step's shuffle files go before the next one writes."""
    docs, spark = keyed(docs), docs.sparkSession
    found = materialize(anchors(docs, length, gram), "anchors")
    common = materialize(found.groupBy("h").count().where("count > 1").select("h"), "repeated-anchors")
    let_go(spark)
    hits = found.join(common, "h").select("rk", "p")
    hits = materialize(hits.groupBy("rk").agg(F.collect_list("p").alias("pos")), "hits")
    release(found, common)
    around = materialize(runs(docs.select("rk", "ord", "text").join(hits, "rk"), length, gram), "runs")
    release(hits)
    place = F.struct("ord", "a")
    firsts = around.groupBy("c1", "c2").agg(F.min(F.struct("ord", "a", "rk")).alias("f"), F.first("wins", True).alias("wins"))
    firsts = materialize(firsts.select("c1", "c2", "f.*", "wins"), "first-runs")
    let_go(spark)
    later = around.select("c1", "c2", "rk", "ord", "a", "n").join(
        firsts.select("c1", "c2", F.struct("ord", "a").alias("place")), ["c1", "c2"]
    ).where(place > F.col("place")).select("rk", F.col("a").alias("s"), "n")
    whole = materialize(_by_row(later), "whole-runs")
    release(around)
    single = windows(firsts)
    least = materialize(single.groupBy("w1", "w2").agg(F.min(F.struct("ord", "s")).alias("place"), F.count("*").alias("k")).where("k > 1").drop("k"), "first-windows")
    let_go(spark)
    again = single.join(least, ["w1", "w2"]).where(F.struct("ord", "s") > F.col("place")).select("rk", "s", F.lit(1).alias("n"))
    out = materialize(_by_row(again).unionByName(whole).groupBy("rk").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(firsts, least, whole)
    return out


def kept(words: list[bytes], spans: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which words stay when all words of the windows in ``spans`` go."""
    marks = np.zeros(len(words) + 1, np.int64)
    for s, n in spans:
        marks[s] += 1
        marks[s + n + length - 1] -= 1
    return np.cumsum(marks[:-1]) == 0


def _cut(length: int):
    """Function of a batch with text and spans: numbers of words, of removed words, and the words left."""

    def cut(b: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
        sizes, gone, left = [], [], []
        for t, spans in zip(texts(b), b.column("spans").to_pylist()):
            words = t.split()
            sizes.append(len(words))
            if spans:
                stay = kept(words, [(x["s"], x["n"]) for x in spans], length)
                words = [w for w, k in zip(words, stay.tolist()) if k]
            gone.append(sizes[-1] - len(words))
            left.append(b" ".join(words))
        return sizes, gone, left

    return cut


def deduplicate(docs: DataFrame, length: int = 20, gram: int = 10) -> DataFrame:
    """Each row's (doc_id, n_words, n_removed, kept): the words left, joined by one space.

    Null and empty texts have no words. A null doc_id counts as the largest. Rows with one doc_id stand at one place: none
    of them is earlier than another, so an exactly repeated row loses no more than the row does alone. Other columns are
    ignored; an empty table gives no rows.
    """
    found, cut = repeats(docs, length, gram), _cut(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, gone, left = cut(b)
            cols = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept"])

    rows = keyed(docs).select("rk", "doc_id", "text").join(found, "rk", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept string")


def trim(docs: DataFrame, length: int = 20, gram: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut from text (and n_chars, if there, set to its length).

    A text that loses words becomes its words left, joined by one space; all others stay as they are. Rows that lose all
    their words go. Otherwise defined like ``deduplicate``; columns may have any names.
    """
    found, cut = repeats(docs, length, gram), _cut(length)
    names, size = docs.columns, dict(docs.dtypes).get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, gone, left = cut(b)
            old = b.column("text").to_pylist()
            new = pa.array([w.decode() if g else t for w, g, t in zip(left, gone, old)], pa.string())
            row = dict(zip(names, b.column("row").flatten())) | {"text": new}
            if size in ("int", "bigint"):
                row["n_chars"] = pa.array([n if not g else len(w.decode()) for n, g, w in zip(row["n_chars"].to_pylist(), gone, left)], row["n_chars"].type)
            stay = pa.array([not g or g < n for g, n in zip(gone, sizes)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(row.values()), names).filter(stay)

    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("rk"), "text").join(found, "rk", "left")
    return rows.select("row", "text", "spans").mapInArrow(run, docs.schema)
