"""Helpers that the operators of this subpackage share.

Lineage is cut by writing Parquet tables below ``spark.checkpoint.dir`` - the
folder that every executor can reach - never by ``localCheckpoint``.
"""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in local tests.
FALLBACK_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one where that is unset and there is one process only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors can reach")
    return (named or FALLBACK_DIR).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidebars/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    col = batch.column(column)
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    return [x or b"" for x in col.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most_bytes`` (one row at least): bounds a worker's memory."""
    for b in batches:
        rows = max(1, int(b.num_rows * most_bytes / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def connected_components(edges: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """Components of the graph whose edges are the rows (u, v) of ``edges``: each node with its least node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): O(log^2 n) rounds, each of them two
    aggregations and joins, with nothing on the driver but counts. A hub's rows are pre-aggregated before they are
    shuffled, and the table of minima is written before it is joined, so that the engine may split a hub's rows.
    Nodes without an edge to another node are not returned; nulls are dropped; an empty input gives no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = pairs if large else pairs.where("v < u")
        least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # Each kept neighbour points to the least node; in the small step so does the node itself.
        met = pairs.join(least, "u")
        out = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        edges = materialize(star(star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias(node), F.col("v").alias(root)).unionByName(
                edges.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
            )
        before = now


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads, and let go of shuffle files behind them."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        for folder in {f.rpartition("/")[0] for f in files}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for spark in {df.sparkSession for df in tables}:
        let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of all frames that nothing refers to any more.

    Two threads would keep the last frames in use: the listeners' holds the last event, with the query that ended, until
    there is another one (a job without tasks gives it); Py4J's tells the JVM only once a second what Python dropped.
    """
    gc.collect()
    spark.sparkContext._jsc.emptyRDD().count()
    queue, until = getattr(spark._jvm._gateway_client, "finalizer_deque", ()), time.monotonic() + 10
    while queue and time.monotonic() < until:
        time.sleep(0.05)
    time.sleep(0.1)  # the last events and messages have left their queues, but may be on their way
    spark._jvm.System.gc()
