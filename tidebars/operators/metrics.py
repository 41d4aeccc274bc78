"""Scores of probabilistic direction forecasts, over rows with columns y (0 or 1) and p, within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import log_loss, num


def auc(rows: DataFrame, by: list[str], ties: str = "average", order: str = "pos") -> DataFrame:
    """(by, n, auc) by the rank sum; null for a single class.

    ``average``: equal scores share their mean rank. It works on counts of distinct scores, so the shuffle carries one row for
    each score and task. ``ordinal``: equal scores rank by ``order``, as a stable sort ranks them.
    """
    if ties == "average":
        each = rows.groupBy(*by, "p").agg(F.count("*").alias("c"), F.sum("y").alias("c1"))
        below = F.sum("c").over(W.partitionBy(*by).orderBy("p").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")
        ranked = each.withColumn("r", below + (F.col("c") + num(1)) / num(2))
        sums = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("c1").alias("n1"), F.sum(F.col("c1") * F.col("r")).alias("s"))
    else:
        ranked = rows.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("p", order)))
        sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("n1"), F.sum(F.col("y") * F.col("r")).alias("s"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    area = F.when((n1 > 0) & (n1 < n), (F.col("s") - n1 * (n1 + 1) / 2) / (n1 * (n - n1)))
    return sums.select(*by, F.col("n").cast("long").alias("n"), area.alias("auc"))


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, edge over the majority, balanced accuracy, F1, MCC, log-loss, Brier score and base rate; p > 0.5 is a rise."""
    hit = F.col("p") > 0.5
    c = lambda cond: F.count(F.when(cond, 1)).cast("double")
    y = F.col("y") == 1
    sums = rows.groupBy(*by).agg(
        c(hit & y).alias("tp"), c(hit & ~y).alias("fp"), c(~hit & y).alias("fn"), c(~hit & ~y).alias("tn"), F.count("*").alias("n"),
        F.avg(log_loss(F.col("y").cast("double"), F.col("p"))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(num(0))
    base = (tp + fn) / F.col("n")
    accuracy = (tp + tn) / F.col("n")
    return sums.select(
        *by, "n", accuracy.alias("accuracy"), (accuracy - F.greatest(base, num(1) - base)).alias("edge"),
        ((div(tp, tp + fn) + div(tn, tn + fp)) / 2).alias("balanced"), div(num(2) * tp, num(2) * tp + fp + fn).alias("f1"),
        div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), "log_loss", "brier", base.alias("base_rate"),
    )


def reliability(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_p, mean_y) in equal-width bins of p: sums that also add up over resampled blocks."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))


def calibration(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """(by, slope, ece): cov(y, p) / var(p), and the mean absolute gap of the bins weighted by their size."""
    slope = rows.groupBy(*by).agg(F.try_divide(F.covar_pop("y", "p"), F.var_pop("p")).alias("slope"))
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")
    return slope.join(reliability(rows, by, bins).groupBy(*by).agg(gap.alias("ece")), by)


def selective(rows: DataFrame, by: list[str], taus: list[float], least: int = 50) -> DataFrame:
    """(by, tau, n_bets, coverage, accuracy, edge_bp): only forecasts with |p - 0.5| >= tau act; change is the bar's return."""
    each = rows.select(*by, "y", "p", "change", F.explode(F.array(*map(num, taus))).alias("tau"))
    on = F.abs(F.col("p") - num(0.5)) >= F.col("tau")
    side = F.when(F.col("p") > 0.5, num(1)).otherwise(num(-1))
    right = (F.col("p") > 0.5) == (F.col("y") == 1)
    out = each.groupBy(*by, "tau").agg(
        F.count(F.when(on, 1)).alias("n_bets"), F.avg(on.cast("double")).alias("coverage"),
        F.avg(F.when(on, right.cast("double"))).alias("accuracy"), (F.avg(F.when(on, side * F.col("change"))) * num(1e4)).alias("edge_bp"),
    )
    return out.where(F.col("n_bets") >= least)
