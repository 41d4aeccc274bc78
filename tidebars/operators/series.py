"""Window functions along a series. A series holds bars, whose number grows with calendar time and not with the ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import num


def along(asset: str = "asset", order: str = "slot") -> WindowSpec:
    return W.partitionBy(asset).orderBy(order)


def positioned(rows: DataFrame, asset: str = "asset", order: str = "slot") -> DataFrame:
    """Adds pos, the row's number in its series from 0, and n, the series' length."""
    return rows.withColumn("pos", F.row_number().over(along(asset, order)) - 1).withColumn("n", F.count("*").over(W.partitionBy(asset)))


def lags(x: Column, n: int, w: WindowSpec) -> list[Column]:
    """x one to n rows before."""
    return [F.lag(x, k).over(w) for k in range(1, n + 1)]


def kernel_field(x: Column, weights: list[float], w: WindowSpec) -> Column:
    """sum of weights[k-1] times x k rows before; terms before the series' start are 0."""
    total = num(0)
    for k, a in enumerate(weights, 1):
        total = total + num(a) * F.coalesce(F.lag(x, k).over(w), num(0))
    return total


def power_law(n: int, alpha: float) -> list[float]:
    return [k**-alpha for k in range(1, n + 1)]


def contiguous(order: str, n: int, w: WindowSpec) -> Column:
    """Whether the n rows before stand in the n slots before."""
    return F.coalesce(F.col(order) - F.lag(order, n).over(w) == n, F.lit(False))


def trailing(f, x: Column, n: int, w: WindowSpec, least: int = 1) -> Column:
    """``f`` of x over the n rows before, without the present one; null with fewer than ``least`` of them."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, f(x).over(frame))


def runs(rows: DataFrame, order: str, step: int, asset: str = "asset") -> DataFrame:
    """Adds run: rows whose ``order`` goes on by ``step`` share one; and run_n, its length."""
    w = along(asset, order)
    new = F.when(F.col(order) - F.lag(order).over(w) == step, 0).otherwise(1)
    out = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return out.withColumn("run_n", F.count("*").over(W.partitionBy(asset, "run")))


def autocorrelation(rows: DataFrame, x: str, most: int) -> DataFrame:
    """(asset, lag, rho): with the series' mean and its whole sum of squares, for lags 1 to ``most``."""
    mean = F.avg(x).over(W.partitionBy("asset"))
    d = rows.select("asset", "slot", (F.col(x) - mean).alias("d"))
    w = along()
    cols = [F.sum(F.col("d") * F.col(f"d{k}")).alias(f"s{k}") for k in range(1, most + 1)]
    d = d.select("asset", "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, most + 1)))
    sums = d.groupBy("asset").agg(F.sum(F.col("d") * F.col("d")).alias("s0"), *cols)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.when(F.col("s0") > 0, F.col(f"s{k}") / F.col("s0")).otherwise(num(0)).alias("rho")) for k in range(1, most + 1))))
    return sums.select("asset", pairs.alias("p")).select("asset", "p.*")


def markov_state(up: Column, m: int, w: WindowSpec) -> Column:
    """The last m labels as a string of 0 and 1, oldest first; null before there are m."""
    parts = [F.lag(up.cast("int"), k).over(w) for k in range(m, 0, -1)]
    ok = parts[0].isNotNull()
    return F.when(ok, F.concat(*(p.cast("string") for p in parts)))


def equity(rows: DataFrame, pnl: str, w: WindowSpec) -> DataFrame:
    """Adds equity, its running peak (at least 0) and the drawdown from it."""
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("equity", F.sum(pnl).over(upto))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(upto), num(0)))
    return out.withColumn("drawdown", F.col("peak") - F.col("equity"))


def dfa(rows: DataFrame, x: str, scales: list[int]) -> DataFrame:
    """(asset, scale, fluctuation): root mean square around a line in windows of each scale of the summed, centred series.

    One pass makes the profile; each scale's windows are fitted by sums, so only windows' sums are shuffled.
    """
    rows = positioned(rows)
    profile = F.sum(F.col(x) - F.avg(x).over(W.partitionBy("asset"))).over(along().rowsBetween(W.unboundedPreceding, 0))
    p = rows.select("asset", "pos", "n", profile.alias("y"))
    each = p.select("*", F.explode(F.array(*map(F.lit, scales))).alias("scale")).where("pos < floor(n / scale) * scale and floor(n / scale) >= 8")
    t = (F.col("pos") % F.col("scale")).cast("double")
    sums = each.withColumn("t", t).groupBy("asset", "scale", F.floor(F.col("pos") / F.col("scale")).alias("box")).agg(
        F.var_pop("y").alias("vy"), F.covar_pop("t", "y").alias("cty"), F.var_pop("t").alias("vt")
    )
    rest = F.greatest(F.col("vy") - F.try_divide(F.col("cty") * F.col("cty"), F.col("vt")), num(0))
    return sums.groupBy("asset", "scale").agg(F.sqrt(F.avg(rest)).alias("fluctuation"))


def hurst(fluctuations: DataFrame) -> DataFrame:
    """(asset, h): slope of log fluctuation on log scale."""
    good = fluctuations.where("fluctuation > 0")
    return good.groupBy("asset").agg(F.regr_slope(F.ln("fluctuation"), F.ln(F.col("scale").cast("double"))).alias("h"))
