"""Joins that Spark SQL lacks, as compositions of those it has."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import num


def asof(left: DataFrame, right: DataFrame, ts: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds to ``left`` the last ``value`` of ``right`` at or before ``ts``; null before the first. Null values are passed over.

    Both sides are stacked and the value is carried forward: no range join. Without ``by`` each day is a window of its own, and
    what a day leaves is carried into the next by a window over one row a day.
    """
    by = by or []
    cols = left.columns
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    b = right.select(*by, ts, F.col(value).alias("_v"), F.lit(0).alias("_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    if by:
        w = W.partitionBy(*by).orderBy(ts, "_left").rowsBetween(W.unboundedPreceding, 0)
        return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").select(*cols, value)
    kind = dict(both.dtypes)[ts]
    day = F.to_date(ts) if kind in ("timestamp", "timestamp_ntz", "date") else F.floor(F.col(ts) / 86400)
    both = both.withColumn("_day", day)
    ends = both.groupBy("_day").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(ts))).alias("_end"))
    before = W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)  # one row a day
    carried = ends.select(F.col("_day").alias("_key"), F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    w = W.partitionBy("_day").orderBy(ts, "_left").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_left = 1").join(carried, F.col("_day").eqNullSafe(F.col("_key")), "left")
    return out.select(*cols, F.coalesce("_last", "_carried").alias(value))


def common_slots(series: DataFrame, key: str, slot: str, n: int) -> DataFrame:
    """Slots in which ``n`` different keys have a row."""
    return series.groupBy(slot).agg(F.count_distinct(key).alias("k")).where(F.col("k") == n).select(slot)


def exact_align(left: DataFrame, right: DataFrame, asset: str, slot: str) -> DataFrame:
    """(asset, matched, missing): how many of ``left``'s slots ``right`` has; a series aligns if none is missing."""
    r = right.select(asset, slot).distinct().withColumn("_hit", F.lit(1))
    return left.join(r, [asset, slot], "left").groupBy(asset).agg(F.count("_hit").alias("matched"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("missing"))


def test_folds(rows: DataFrame, train: int, test: int) -> DataFrame:
    """Adds fold to the rows (pos, n) that some fold tests: arithmetic in place of a range join. The last fold may be short."""
    return rows.where((F.col("pos") >= train) & (F.col("n") > train)).withColumn("fold", F.floor((F.col("pos") - train) / test).cast("int"))


def train_folds(rows: DataFrame, train: int, test: int) -> DataFrame:
    """Each row (pos, n) once for each fold that trains on it."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - (train - 1)) / test)).cast("int")
    hi = F.least(F.floor(F.col("pos") / test), F.ceil((F.col("n") - train) / test) - 1).cast("int")
    return rows.where((F.col("n") > train) & (lo <= hi)).withColumn("fold", F.explode(F.sequence(lo, hi)))


def shift_join(left: DataFrame, right: DataFrame, slot: str, k: int, size: int) -> DataFrame:
    """Joins slot s of ``left`` with slot s - k (modulo ``size``) of ``right``."""
    moved = right.withColumn(slot, F.pmod(F.col(slot) + k, F.lit(size)))
    return left.join(moved, slot)


def pair_correlations(rows: DataFrame, asset: str, slot: str, x: str, least: int, slots: int = 2048) -> DataFrame:
    """(a, b, n, rho) of all pairs of series with more than ``least`` slots in common.

    Blocks of ``slots`` consecutive slots become matrices, whose products are the sums of all pairs at once: what is shuffled
    are sums for each pair and block, not pairs for each slot. A block's matrix is slots times series. Values are taken less
    their series' mean, which the correlation does not see and the sums' precision does; null values are left out.
    """
    mean = rows.groupBy(asset).agg(F.avg(x).alias("_mean"))
    got = rows.where(F.col(x).isNotNull()).join(mean, asset)
    got = got.select(F.col(asset).alias("a"), F.col(slot).cast("long").alias("s"), (F.col(x) - F.col("_mean")).cast("double").alias("x"), F.floor(F.col(slot) / slots).alias("block"))
    kind = dict(got.dtypes)["a"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names, i = np.unique(g["a"].to_numpy(), return_inverse=True)
        rows_, j = np.unique(g["s"].to_numpy(), return_inverse=True)
        v, here = np.zeros((len(rows_), len(names))), np.zeros((len(rows_), len(names)))
        v[j, i], here[j, i] = g["x"].to_numpy(), 1.0
        p, q = np.triu_indices(len(names), 1)
        sums = {"n": here.T @ here, "sx": v.T @ here, "sy": here.T @ v, "sxx": (v * v).T @ here, "syy": here.T @ (v * v), "sxy": v.T @ v}
        out = pd.DataFrame({"a": names[p], "b": names[q]} | {k: m[p, q] for k, m in sums.items()})
        return out[out["n"] > 0]

    part = got.groupBy("block").applyInPandas(run, f"a {kind}, b {kind}, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = part.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    c = {k: F.col(k) for k in t.columns}
    cov = c["sxy"] - c["sx"] * c["sy"] / c["n"]
    spread = lambda k: c[f"s{k}{k}"] - c[f"s{k}"] * c[f"s{k}"] / c["n"]
    rho = F.when((spread("x") > 1e-24) & (spread("y") > 1e-24), cov / F.sqrt(spread("x") * spread("y")))
    return t.select("a", "b", c["n"].cast("long").alias("n"), rho.alias("rho")).where(F.col("n") > least)


def with_factor(rows: DataFrame, slot: str, x: str) -> DataFrame:
    """Adds factor, the mean of x over all series in the slot: aggregated before it is joined back."""
    return rows.join(rows.groupBy(slot).agg(F.avg(x).alias("factor")), slot)


def resampled(rows: DataFrame, draws: DataFrame, slot: str) -> DataFrame:
    """Rows as often as ``draws`` (b, slot) asks for: repeated draws become the weight w of one row."""
    return rows.join(draws.groupBy("b", slot).agg(F.count("*").alias("w")), slot)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def ordered_bucket(x: Column) -> Column:
    """A number that never falls as x grows: some 80,000 at most, finer about zero. Rows of equal x have equal numbers."""
    v = x.cast("double")
    return F.rint(F.signum(v) * F.log1p(F.abs(v) * num(1e6)) * num(512)).cast("int")


def quantile_edges(rows: DataFrame, x: str, cuts: list[float]) -> DataFrame:
    """One row with the array _edges: exact interpolated quantiles of the whole column, nulls left out.

    Values are counted, counts are added up by bucket of an order-keeping number, and only the few buckets that hold a wanted
    rank are looked into: no task holds the column's values.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("c")).withColumn("b", ordered_bucket(F.col("v")))
    w = W.orderBy("b")  # over buckets
    per = values.groupBy("b").agg(F.sum("c").alias("k"))
    per = per.select("b", (F.sum("k").over(w) - F.col("k")).alias("before"), "k", F.sum("k").over(W.partitionBy()).alias("n"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (num(q) * (F.col("n") - 1)).alias("h")) for i, q in enumerate(cuts)))
    ends = per.withColumn("w", F.explode(wanted)).select("b", "before", "k", "w.i", "w.h", F.explode(F.array(F.floor("w.h"), F.ceil("w.h"))).alias("r"))
    ends = ends.where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("k"))).distinct()
    inside = values.join(F.broadcast(ends.select("b", "before").distinct()), "b")  # two buckets a cut at most
    upto = F.col("before") + F.sum("c").over(W.partitionBy("b").orderBy("v"))
    inside = inside.select("b", "v", (upto - F.col("c")).alias("first"), upto.alias("last"))
    at = ends.join(inside, "b").where((F.col("r") >= F.col("first")) & (F.col("r") < F.col("last")))
    edge = at.groupBy("i").agg(F.min_by("v", "r").alias("lo"), F.max_by("v", "r").alias("hi"), F.min("r").alias("r"), F.first("h").alias("h"))
    edge = edge.select("i", (F.col("lo") + (F.col("h") - F.col("r")) * (F.col("hi") - F.col("lo"))).alias("e"))
    return edge.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("_edges"))


def ranked(rows: DataFrame, x: str, *ties: str) -> DataFrame:
    """Adds rank (from 1, by x, then ``ties``) and _n, the number of rows: a window for each bucket of an order-keeping number and
    one over buckets, none over all rows."""
    b = rows.withColumn("_b", ordered_bucket(F.col(x)))
    per = b.groupBy("_b").agg(F.count("*").alias("_k"))
    per = per.select(F.col("_b").alias("_key"), (F.sum("_k").over(W.orderBy("_b")) - F.col("_k")).alias("_before"), F.sum("_k").over(W.partitionBy()).alias("_n"))
    out = b.join(per, F.col("_b").eqNullSafe(F.col("_key"))).drop("_key")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("_b").orderBy(x, *ties)) + F.col("_before")).drop("_b", "_before")


def digitize(rows: DataFrame, x: str, cuts: list[float], by: list[str] | None = None) -> DataFrame:
    """Adds bin, the number of the quantile edges at or below x; edges are exact quantiles at ``cuts``, within ``by``."""
    by = by or []
    if by:
        joined = rows.join(rows.groupBy(*by).agg(F.percentile(x, F.array(*map(num, cuts))).alias("_edges")), by)
    else:
        joined = rows.crossJoin(F.broadcast(quantile_edges(rows, x, cuts)))  # one row
    return joined.withColumn("bin", F.size(F.filter("_edges", lambda e: F.col(x) >= e))).drop("_edges")


def spaced(rows: DataFrame, x: str, groups: int, *ties: str) -> DataFrame:
    """Adds grp: rows in order of x fall into ``groups`` parts cut at evenly spaced whole positions, rounded down."""
    at = ranked(rows, x, *ties)
    r, n = F.col("rank") - 1, F.col("_n")
    cut = F.array(*(F.floor(n * F.lit(k) / groups) for k in range(1, groups)))
    return at.withColumn("grp", F.size(F.filter(cut, lambda c: r >= c)) + 1).drop("rank", "_n")
