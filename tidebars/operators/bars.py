"""Bars: from ticks, snapshots and orders to regular buckets; returns and resampling. One shuffle on the bucket each, with
map-side partial aggregates, whatever number of ticks a bucket holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import num, seconds_of, simple_return, slot


def tick_bars(ticks: DataFrame, asset: str, price: str, order: list[str], seconds: int, ts: str = "ts", offset: int = 0, buy: Column | None = None) -> DataFrame:
    """(asset, slot, ts, open, close, vol, ntr, tbv, change, up): first and last price of each bucket by ``order``."""
    by = F.struct(*order)
    buy = F.lit(False) if buy is None else buy
    out = ticks.groupBy(F.col(asset).alias("asset"), slot(F.col(ts), seconds, offset).alias("slot")).agg(
        F.min_by(price, by).alias("open"), F.max_by(price, by).alias("close"), F.sum(price).alias("vol"),
        F.count("*").alias("ntr"), F.sum(F.when(buy, F.col(price)).otherwise(num(0))).alias("tbv"),
    )
    return out.select("*", (F.col("slot") * seconds + offset).alias("ts"), simple_return(F.col("open"), F.col("close")).alias("change"), (F.col("close") > F.col("open")).alias("up"))


def resample(bars: DataFrame, slots: int) -> DataFrame:
    """Coarser bars from bars: first open, last close."""
    out = bars.groupBy("asset", F.floor(F.col("slot") / slots).cast("long").alias("slot")).agg(
        F.min_by("open", "slot").alias("open"), F.max_by("close", "slot").alias("close"), F.sum("ntr").alias("ntr")
    )
    return out.withColumn("change", simple_return(F.col("open"), F.col("close")))


def compound(bars: DataFrame, slots: int) -> DataFrame:
    """Coarser returns prod(1 + r) - 1, multiplied in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "change")))  # at most `slots` values
    out = bars.groupBy("asset", F.floor(F.col("slot") / slots).cast("long").alias("slot2")).agg(ordered.alias("parts"))
    product = F.aggregate("parts", num(1), lambda a, x: a * (num(1) + x["change"]))
    return out.select("asset", F.col("slot2").alias("slot"), (product - num(1)).alias("change"))


def complete_bars(ticks: DataFrame, asset: str, price: str, order: list[str], seconds: int, least: int, edge: int, offset: int = 0) -> DataFrame:
    """Bars on a shifted grid, only those with at least ``least`` ticks and ticks within ``edge`` seconds of both ends."""
    at = seconds_of(F.col("ts"))
    rows = ticks.withColumn("_at", at - num(offset) - slot(F.col("ts"), seconds, offset) * num(seconds))
    by = F.struct(*order)
    out = rows.groupBy(F.col(asset).alias("asset"), slot(F.col("ts"), seconds, offset).alias("slot")).agg(
        F.min_by(price, by).alias("open"), F.max_by(price, by).alias("close"), F.count("*").alias("ntr"), F.min("_at").alias("lo"), F.max("_at").alias("hi")
    )
    return out.where((F.col("ntr") >= least) & (F.col("lo") <= edge) & (F.col("hi") >= seconds - edge)).drop("lo", "hi")


def snapshot_bars(rows: DataFrame, keys: list[str], level: str, levels: list, value: str, order: list[str]) -> DataFrame:
    """One row for each key with first, last, min and mean of ``value`` for each level, and the number of rows."""
    by = F.struct(*order)
    aggs = [F.count("*").alias("n")]
    for i, x in enumerate(levels):
        on = F.col(level) == F.lit(x)
        v, o = F.when(on, F.col(value)), F.when(on, by)
        aggs += [F.min_by(v, o).alias(f"l{i}_first"), F.max_by(v, o).alias(f"l{i}_last"), F.min(v).alias(f"l{i}_min"), F.avg(v).alias(f"l{i}_mean")]
    return rows.groupBy(*keys).agg(*aggs)


def forced_bars(orders: DataFrame, keys: list[str], side: str, sell, notional: Column) -> DataFrame:
    """Notional and count of forced sells and buys by key; exact repeats of a row count once."""
    rows = orders.distinct().withColumn("_v", notional)
    sells = F.col(side) == F.lit(sell)
    value = lambda on: F.sum(F.when(on, F.col("_v")).otherwise(num(0)))
    return rows.groupBy(*keys).agg(
        value(sells).alias("sell_notional"), F.count(F.when(sells, 1)).alias("sell_n"), value(~sells).alias("buy_notional"), F.count(F.when(~sells, 1)).alias("buy_n")
    )


def close_to_close(bars: DataFrame, price: str = "close") -> DataFrame:
    """Adds ret: price / previous price - 1, 0 on a series' first bar."""
    before = F.lag(price).over(W.partitionBy("asset").orderBy("slot"))
    return bars.withColumn("ret", F.coalesce(F.when(before != 0, F.col(price) / before - num(1)), num(0)))


def vwap_returns(bars: DataFrame) -> DataFrame:
    """Returns of quote volume by volume, the close where there is no volume."""
    return close_to_close(bars.withColumn("vwap", F.when(F.col("vol") > 0, F.col("qvol") / F.col("vol")).otherwise(F.col("close"))), "vwap")


def mid_bars(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """Bars of mid prices and the relative spread at the close, from bars of both sides; without bars dead on both."""
    b = bid.select("slot", *(F.col(c).alias(f"b_{c}") for c in ("open", "close", "high", "low")))
    a = ask.select("slot", *(F.col(c).alias(f"a_{c}") for c in ("open", "close", "high", "low")))
    both = b.join(a, "slot").where(~((F.col("b_high") == F.col("b_low")) & (F.col("a_high") == F.col("a_low"))))
    mid = lambda c: (F.col(f"b_{c}") + F.col(f"a_{c}")) / num(2)
    return both.select("slot", mid("open").alias("open"), mid("close").alias("close"), ((F.col("a_close") - F.col("b_close")) / mid("close")).alias("spread"))


def merge_sources(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in which a later source's row replaces an earlier one's."""
    if not parts:
        raise ValueError("no source")
    union = None
    for i, p in enumerate(parts):
        p = p.withColumn("_rank", F.lit(i))
        union = p if union is None else union.unionByName(p)
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_rank")))
    return union.withColumn("_n", last).where("_n = 1").drop("_n", "_rank")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def admitted(rows: DataFrame, asset: str, least: int) -> DataFrame:
    """Rows of assets with at least ``least`` rows."""
    return rows.join(rows.groupBy(asset).count().where(F.col("count") >= least).select(asset), asset, "left_semi")
