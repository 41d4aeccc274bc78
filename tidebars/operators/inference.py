"""Multiple testing, regressions and series statistics, as window functions and closed forms on sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import chi2_survival, corr, normal_cdf, num
from tidebars.operators.joins import ranked
from tidebars.operators.series import along, autocorrelation, kernel_field, positioned, power_law


def benjamini_hochberg(rows: DataFrame, p: str, key: str, q: float = 0.05) -> DataFrame:
    """Adds rank and rejected: the step-up rule, the largest rank with p <= q rank / n and all below it."""
    at = ranked(rows, p, key)
    last = at.agg(F.coalesce(F.max(F.when(F.col(p) <= num(q) * F.col("rank") / F.col("_n"), F.col("rank"))), F.lit(0)).alias("_last"))
    return at.crossJoin(F.broadcast(last)).withColumn("rejected", F.col("rank") <= F.col("_last")).drop("_n", "_last")  # one row


def conjunction(rows: DataFrame, p1: str, p2: str, replicates: int) -> DataFrame:
    """Adds p: the larger of both p-values, each floored at 1 / (replicates + 1)."""
    floor = num(1 / (replicates + 1))
    return rows.withColumn("p", F.greatest(F.col(p1), F.col(p2), floor))


def ljung_box(rows: DataFrame, x: str, lags: int = 12) -> DataFrame:
    """(asset, q, p): the portmanteau statistic of the first ``lags`` autocorrelations and its chi-square tail."""
    n = rows.groupBy("asset").agg(F.count("*").cast("double").alias("n"))
    rho = autocorrelation(rows, x, lags).join(n, "asset")
    q = rho.groupBy("asset").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("p", chi2_survival(F.col("q"), lags))


def kernel_correlation(rows: DataFrame, x: str, n: int = 12, alpha: float = 1.0) -> DataFrame:
    """(asset, r): correlation of the sign with the power-law sum of the n signs before; 0 if undefined."""
    s = rows.select("asset", "slot", F.signum(F.col(x).cast("double")).alias("s"))
    s = s.withColumn("f", kernel_field(F.col("s"), power_law(n, alpha), along()))
    s = positioned(s).where(F.col("pos") >= n)
    return s.groupBy("asset").agg(F.coalesce(corr("s", "f"), num(0)).alias("r"))


def variance_ratio(rows: DataFrame, x: str, q: int) -> DataFrame:
    """(asset, vr, z, p): Lo and MacKinlay's ratio of q-period to one-period variance with heteroskedastic z."""
    mean = F.avg(x).over(W.partitionBy("asset"))
    d = positioned(rows).select("asset", "slot", "pos", "n", (F.col(x) - mean).alias("d"))
    w = along()
    d = d.withColumn("sq", F.when(F.col("pos") >= q - 1, F.sum("d").over(w.rowsBetween(1 - q, 0))))
    d = d.select("*", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, q)))
    sq = F.col("d") * F.col("d")
    sums = d.groupBy("asset").agg(
        F.first("n").cast("double").alias("n"), F.sum(sq).alias("s1"), F.sum(F.col("sq") * F.col("sq")).alias("sq"),
        *(F.sum(sq * F.col(f"d{k}") * F.col(f"d{k}")).alias(f"t{k}") for k in range(1, q)),
    )
    n, s1 = F.col("n"), F.col("s1")
    m = num(q) * (n - q + 1) * (num(1) - F.try_divide(num(q), n))
    vr = F.try_divide(F.try_divide(F.col("sq"), m), F.try_divide(s1, n - 1))
    theta = num(0)
    for k in range(1, q):
        theta = theta + num((2 * (q - k) / q) ** 2) * F.try_divide(F.col(f"t{k}"), s1 * s1)
    z = F.try_divide(vr - 1, F.sqrt(theta))
    return sums.select("asset", vr.alias("vr"), z.alias("z")).withColumn("p", num(2) * (num(1) - normal_cdf(F.abs("z"))))


def ols(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by, n, slope, intercept, r2, se, t): a line with classic standard error."""
    s = rows.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    se = F.sqrt(F.greatest(F.try_divide(F.try_divide(F.col("syy") * (num(1) - F.col("r2")), (F.col("n") - 2).cast("double")), F.col("sxx")), num(0)))
    return s.withColumn("se", se).withColumn("t", F.try_divide(F.col("slope"), F.col("se"))).drop("sxx", "syy")


def ols_hc1(rows: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by, slope, se): a line with heteroskedasticity-robust (HC1) standard error; two passes of sums."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("b0"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.regr_count(y, x).cast("double").alias("n"))
    e = F.col(y) - F.col("b0") - F.col("slope") * F.col(x)
    d = F.col(x) - F.col("mx")
    meat = rows.join(fit, by).groupBy(*by, "slope", "sxx", "n").agg(F.sum(d * d * e * e).alias("m"))
    return meat.select(*by, "slope", F.sqrt(F.try_divide(F.col("m") * F.col("n"), F.col("n") - 2)).alias("_s"), "sxx").select(*by, "slope", F.try_divide(F.col("_s"), F.col("sxx")).alias("se"))


def ols_many(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """(by, term, b, se): least squares on several regressors and an intercept, with robust (HC1) errors.

    Two passes of sums; only they, a matrix for each group, meet the solver. A group without full rank has null coefficients.
    """
    terms = ["const", *xs]
    x = [num(1), *(F.col(c).cast("double") for c in xs)]
    k, pairs = len(x), [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = rows.groupBy(*by).agg(F.count("*").cast("double").alias("_n"), F.array(*(F.sum(x[i] * x[j]) for i, j in pairs)).alias("_xx"), F.array(*(F.sum(v * F.col(y)) for v in x)).alias("_xy"))
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def square(flat: list[float]) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, flat):
            m[i, j] = m[j, i] = v
        return m

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            out = []
            for xx, xy in zip(g["_xx"], g["_xy"]):
                m = square(xx)
                out.append(np.linalg.solve(m, np.array(xy)).tolist() if np.linalg.matrix_rank(m) == k else None)
            yield g.assign(_b=out)

    fit = sums.mapInPandas(solve, f"{keys}, _n double, _xx array<double>, _xy array<double>, _b array<double>")
    e = F.col(y) - sum((F.col("_b")[i] * v for i, v in enumerate(x)), num(0))
    meat = rows.join(fit.select(*by, "_b"), by).groupBy(*by).agg(F.array(*(F.sum(x[i] * x[j] * e * e) for i, j in pairs)).alias("_m"))

    def errors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            out = []
            for row in g.to_dict("records"):
                se = [None] * k
                if row["_b"] is not None and row["_n"] > k:
                    bread = np.linalg.inv(square(row["_xx"]))
                    se = np.sqrt(np.diag(bread @ square(row["_m"]) @ bread) * row["_n"] / (row["_n"] - k)).tolist()
                b = row["_b"] if row["_b"] is not None else [None] * k
                out += [{c: row[c] for c in by} | {"term": t, "b": v, "se": s} for t, v, s in zip(terms, b, se)]
            yield pd.DataFrame(out, columns=[*by, "term", "b", "se"])

    return fit.join(meat, by).mapInPandas(errors, f"{keys}, term string, b double, se double")


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho): correlation of average ranks."""

    def rank(c: str):
        w = W.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / num(2)

    return rows.withColumn("_x", rank(x)).withColumn("_y", rank(y)).groupBy(*by).agg(corr("_x", "_y").alias("rho"))


def factor_beta(rows: DataFrame, x: str, factor: str) -> DataFrame:
    """(asset, beta, resid_sd): slope on the factor fitted in the first half of each series, and the spread of what is left
    in the second half."""
    rows = positioned(rows).withColumn("train", F.col("pos") < F.floor(F.col("n") / 2))
    fit = rows.where("train").groupBy("asset").agg(F.try_divide(F.covar_samp(x, factor), F.var_pop(factor)).alias("beta"))
    rest = rows.where("not train").join(fit, "asset").withColumn("e", F.col(x) - F.col("beta") * F.col(factor))
    return rest.groupBy("asset", "beta").agg(F.stddev_pop("e").alias("resid_sd"))
