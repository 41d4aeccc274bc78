"""Exact top-k inner-product search as a Voronoi kNN join.

Queries and data are grouped by their nearest pivot. A bounded sample of the data gives each query a floor for its k-th
best score; a query group's summary is its radius R around its pivot p and its least floor. As q.x <= p.x + R |x| for all
queries q of the group, a vector x with p.x + R |x| below the floor can be among nobody's best and is not sent to the group;
all other vectors are, once. Each group then is solved locally by matrix products: its data are dealt to chunks of about
``CHUNK``, which tasks hold while all queries of the group pass by in batches, so that no group is one task's work and no number
of queries sends the data again. Vectors that repeat are represented by their k + 1 smallest ids, which is all that ties can
ask for. How much is sent depends on the data: nearly all of them for each group in many dimensions without clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.llm._shared import materialize, slices

PIVOTS, SAMPLE, CHUNK = 48, 2048, 32768


def quantize(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a double; vectors that are null or hold null or non-finite
    components, or come without vec_id, are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~odd)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(scale * e)).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lists = column.to_pylist()
    if all(len(x) == dim for x in lists):
        return np.array(lists, np.int64).reshape(len(lists), dim)
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where no sum can leave its exact range. Sums that a long might not hold
    are an error."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top >= 2**63:
        raise OverflowError("components are too large for exact inner products of 64 bits")
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if top < 2**52 else q @ x.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best, ties to the smaller id, without the row's own id."""
    least = np.iinfo(np.int64).min
    scores = np.where(own[:, None] == ids[None, :], least, scores)
    cut = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), least)
    row, col = np.nonzero((scores >= cut[:, None]) & (scores > least))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


def search(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``data`` (vec_id, v) for each row of ``queries`` (vec_id, v).

    A query's own vec_id is no candidate; ties go to the smaller vec_id. Rows that repeat both vec_id and vector count once;
    shorter vectors end in zeros. With fewer than k candidates all are returned; empty tables give no rows.
    """
    spark = data.sparkSession
    few = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    data = materialize(data.distinct().withColumn("n", few).where(F.col("n") <= k + 1).drop("n"), "vectors")
    queries = queries.distinct()
    dim = data.agg(F.max(F.size("v"))).first()[0] or 0
    dim = max(dim, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    known = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample, sample_ids = matrix(pa.array([r["v"] for r in known]), dim), np.array([r["vec_id"] for r in known])
    pivots = sample[:PIVOTS]
    norms = (pivots.astype(float) ** 2).sum(1)

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot, and a radius that surely holds each vector."""
        d = norms[None, :] - 2.0 * (x.astype(float) @ pivots.astype(float).T)
        cell = d.argmin(1)
        return cell, np.sqrt(((x - pivots[cell]).astype(float) ** 2).sum(1)) * (1 + 1e-9)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20):
            x, ids = matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
            cell, radius = near(x)
            score = np.where(ids[:, None] == sample_ids[None, :], np.iinfo(np.int64).min, products(x, sample))
            floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(x), np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(floor.astype(float))], ["vec_id", "v", "cell", "radius", "floor"])

    grouped = materialize(queries.mapInArrow(group, "vec_id long, v array<bigint>, cell int, radius double, floor double"), "queries")
    table = grouped.groupBy("cell").agg(F.max("radius").alias("radius"), F.min("floor").alias("floor"))
    summary = sorted(table.collect())  # PIVOTS rows at most
    cells, radii, floors = (np.array(x) for x in zip(*[(s["cell"], s["radius"], s["floor"]) for s in summary])) if summary else (np.zeros(0, int),) * 3
    chunks = max(1, -(-data.count() // CHUNK))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            x = matrix(b.column("v"), dim)
            if not len(cells):
                continue
            length = np.sqrt((x.astype(float) ** 2).sum(1))
            bound = x.astype(float) @ pivots[cells].astype(float).T + radii[None, :] * length[:, None]
            row, to = np.nonzero(bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= floors[None, :])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(cells[to].astype(np.int32))], ["vec_id", "v", "cell"])

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    sent = data.mapInArrow(send, "vec_id long, v array<bigint>, cell int").select("cell", chunk.alias("chunk"), F.lit(0).alias("side"), "vec_id", "v")
    asked = grouped.select("cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "vec_id", "v")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []  # the chunk at hand; its ids and vectors
        x = ids = None
        for b in slices(batches, 1 << 20):
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "chunk", "side")], 1)
            v, vec = matrix(b.column("v"), dim), b.column("vec_id").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            for i, j in zip(edge.tolist(), edge[1:].tolist()):
                if tuple(key[i, :2]) != at:
                    at, parts, x = tuple(key[i, :2]), [], None
                if key[i, 2] == 0:
                    parts.append((vec[i:j], v[i:j]))
                elif parts:
                    if x is None:
                        ids, x = (np.concatenate(c) for c in zip(*parts))
                    for n in range(i, j, 256):
                        q = slice(n, min(n + 256, j))
                        s = products(v[q], x)
                        row, col = best(s, ids, vec[q], k)
                        yield pa.RecordBatch.from_arrays([pa.array(vec[q][row]), pa.array(ids[col]), pa.array(s[row, col])], ["query_id", "vec_id", "score"])

    met = asked.unionByName(sent).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side")
    found = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
