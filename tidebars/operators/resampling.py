"""Resampling inference that keeps dependence: blocks of slots drawn once for all series.

Draws are a small table (b, k, start) made on the driver from a seed, B x n / block rows: it depends on the calendar's length,
not on the data. Additive statistics join slot sums with the draws; rank statistics run as one grouped map for each series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def block_starts(spark: SparkSession, n: int, block: int, replicates: int, seed: int | None = None) -> DataFrame:
    """(b, k, start): ceil(n / block) starts in [0, n - block] for each replicate; without a seed by a fixed arithmetic rule."""
    per, span = -(-n // block), max(1, n - block + 1)
    if seed is None:
        grid = spark.range(replicates).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
        return grid.withColumn("start", ((F.col("b") * 7919 + F.col("k") * 104729) % span).cast("int"))
    draw = np.random.default_rng(seed).integers(0, span, (replicates, per))
    pdf = pd.DataFrame({"b": np.repeat(np.arange(replicates), per), "k": np.tile(np.arange(per), replicates), "start": draw.ravel()})
    return spark.createDataFrame(pdf, "b int, k int, start int")


def drawn_slots(starts: DataFrame, n: int, block: int) -> DataFrame:
    """(b, pos): the slots of each replicate's blocks, cut to n in all."""
    each = starts.select("b", "k", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i"))
    return each.where(F.col("k") * block + F.col("i") < n).select("b", (F.col("start") + F.col("i")).alias("pos"))


def weighted_auc(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """AUC of scores sorted upward with counts w; ties in sorted order."""
    n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
    if not n1 or not n0:
        return float("nan")
    zeros = np.cumsum(w * (1 - y))
    return float((w * y * zeros).sum() / (n1 * n0))


def joint_auc_bootstrap(scores: DataFrame, starts: list[list[int]], n: int, block: int, least: int = 1, multiplicity: bool = True) -> DataFrame:
    """(asset, b, auc), b = -1 for the sample itself: all series see the same drawn slots (scores: asset, slot, y, p).

    Scores are sorted once; a replicate is a vector of counts by slot. ``multiplicity`` False counts a slot once however
    often it is drawn. Starts are few (see the module) and travel with the function.
    """
    draws = np.array(starts, np.int64)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((g["slot"], g["p"]))
        slot, y, p = (g[c].to_numpy()[order] for c in ("slot", "y", "p"))
        rows = [(-1, weighted_auc(p, y, np.ones(len(y))))] if len(y) >= least else []
        for b, s in enumerate(draws):
            at = (s[:, None] + np.arange(block)).ravel()[:n]
            count = np.bincount(at, minlength=n)
            w = count[slot] if multiplicity else (count[slot] > 0).astype(int)
            if w.sum() >= least:
                rows.append((b, weighted_auc(p, y, w)))
        return pd.DataFrame({"asset": g["asset"].iloc[0], "b": [r[0] for r in rows], "auc": [r[1] for r in rows]})

    return scores.select("asset", "slot", "y", "p").groupBy("asset").applyInPandas(run, f"asset {dict(scores.dtypes)['asset']}, b int, auc double")


def interval(rows: DataFrame, by: list[str], x: str, level: float = 0.95) -> DataFrame:
    """(by, estimate, lo, hi, p): of replicates (b, x), b = -1 the estimate; p is the share at or below 0."""
    tail = (1 - level) / 2
    rep = F.when(F.col("b") >= 0, F.col(x))
    return rows.groupBy(*by).agg(
        F.max(F.when(F.col("b") < 0, F.col(x))).alias("estimate"), F.percentile(rep, F.lit(tail)).alias("lo"), F.percentile(rep, F.lit(1 - tail)).alias("hi"),
        F.avg(F.when(F.col("b") >= 0, (F.col(x) <= 0).cast("double"))).alias("p"),
    )


def iaaft(x: np.ndarray, seed: int, rounds: int = 100) -> np.ndarray:
    """A surrogate with the values of x and nearly its spectrum."""
    rng = np.random.default_rng(seed)
    ranked, target = np.sort(x), np.abs(np.fft.rfft(x))
    out = rng.permutation(x)
    for _ in range(rounds):
        phase = np.exp(1j * np.angle(np.fft.rfft(out)))
        out = ranked[np.argsort(np.argsort(np.fft.irfft(target * phase, len(x))))]
    return out


def surrogates(rows: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """(asset, pos, change) with the series shuffled, sign-randomised, reversed in time, or as an IAAFT surrogate.

    Seeds depend on the series' name by a stable hash, so results do not depend on the cluster.
    """
    import zlib

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        x = g["change"].to_numpy(float)
        own = seed + zlib.crc32(str(g["asset"].iloc[0]).encode())
        rng = np.random.default_rng(own)
        made = {"shuffle": lambda: rng.permutation(x), "signs": lambda: x * rng.choice([-1.0, 1.0], len(x)), "reverse": lambda: -x[::-1], "iaaft": lambda: iaaft(x, own)}[kind]()
        return pd.DataFrame({"asset": g["asset"], "pos": g["pos"], "change": made})

    return rows.select("asset", "pos", "change").groupBy("asset").applyInPandas(run, f"asset {dict(rows.dtypes)['asset']}, pos int, change double")


def glauber(spark: SparkSession, cells: list[tuple[str, float, float, float]], steps: int, seed: int = 1) -> DataFrame:
    """(asset, pos, change): +-1 chains in which P(up) = sigmoid(c + a field of the 12 spins before / k^alpha). Each cell
    (name, alpha, a, c) is sequential, so cells are the unit of work."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        name, alpha, a, c = g.iloc[0][["asset", "alpha", "a", "c"]]
        rng, w = np.random.default_rng(seed), np.arange(1, 13) ** -float(alpha)
        s = np.zeros(steps + 12)
        for t in range(12, steps + 12):
            s[t] = 1.0 if rng.random() < 1 / (1 + np.exp(-(c + a * (w @ s[t - 12 : t][::-1])))) else -1.0
        return pd.DataFrame({"asset": name, "pos": np.arange(steps, dtype=np.int32), "change": s[12:]})

    return spark.createDataFrame(cells, "asset string, alpha double, a double, c double").groupBy("asset").applyInPandas(run, "asset string, pos int, change double")
