"""An extension: bars of unbounded ticks. Late ticks within the watermark count, later ones do not; state is one row for each
open bucket and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.scalar import simple_return


def stream_bars(ticks: DataFrame, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """(asset, start, open, close, vol, ntr, change) of ticks (asset, ts TIMESTAMP, price), once a bucket is closed."""
    out = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"), F.sum("price").alias("vol"), F.count("*").alias("ntr")
    )
    return out.select("asset", F.col("w.start").alias("start"), "open", "close", "vol", "ntr", simple_return(F.col("open"), F.col("close")).alias("change"))


def stream_runs(ticks: DataFrame, gap: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Runs of ticks with no pause of ``gap``: (asset, start, end, n)."""
    out = ticks.withWatermark("ts", late).groupBy("asset", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("asset", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
