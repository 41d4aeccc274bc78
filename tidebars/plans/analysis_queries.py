"""Aggregations, series functions, models, metrics, inference, resampling and trading."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import corr, log_loss, normal_cdf, num
from tidebars.operators import inference as I
from tidebars.operators import joins as J
from tidebars.operators import metrics as M
from tidebars.operators import models as D
from tidebars.operators import resampling as R
from tidebars.operators import series as S
from tidebars.operators import trading as X
from tidebars.plans.catalog import query
from tidebars.plans.inputs import DAYS, H, SCORED, bars, days, field_sql, scored

OVER = "OVER (PARTITION BY asset ORDER BY slot)"

# Aggregations.


@query("asset n:i mean:f med:f sd:f sd1:f lo:f hi:f q1:f q3:f", "SELECT asset, count(*) AS n, avg(change) AS mean, median(change) AS med, stddev_pop(change) AS sd, stddev_samp(change) AS sd1, min(change) AS lo, max(change) AS hi, quantile_cont(change, 0.25) AS q1, quantile_cont(change, 0.75) AS q3 FROM bars GROUP BY 1", H)
def class_summary(t):
    q = F.percentile("change", F.array(num(0.25), num(0.5), num(0.75)))
    s = bars(t).groupBy("asset").agg(F.count("*").alias("n"), F.avg("change").alias("mean"), q.alias("q"), F.stddev_pop("change").alias("sd"), F.stddev_samp("change").alias("sd1"), F.min("change").alias("lo"), F.max("change").alias("hi"))
    return s.select("*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))


def flips(t):
    """Valid transitions: neither this bar nor the next is flat, and there is an imbalance."""
    b = bars(t).withColumn("imb", num(2) * F.col("tbv") / F.col("vol") - num(1))
    b = b.withColumn("next", F.lead("change").over(S.along()))
    return b.where("change <> 0 and next <> 0 and vol > 0 and imb <> 0").withColumn("flip", (F.signum("change") != F.signum("next")).cast("double"))


FLIPS = f"{H}, flips AS (SELECT *, CASE WHEN sign(change) <> sign(next) THEN 1.0 ELSE 0.0 END AS flip FROM (SELECT *, 2 * tbv / vol - 1 AS imb, lead(change) {OVER} AS next FROM bars) AS f_ WHERE change <> 0 AND next <> 0 AND vol > 0 AND imb <> 0)"


@query("asset n:i rate:f se:f", "SELECT asset, count(*) AS n, avg(flip) AS rate, sqrt(avg(flip) * (1 - avg(flip)) / count(*)) AS se FROM flips GROUP BY 1", FLIPS)
def flip_rate_se(t):
    s = flips(t).groupBy("asset").agg(F.count("*").alias("n"), F.avg("flip").alias("rate"))
    return s.withColumn("se", F.sqrt(F.col("rate") * (num(1) - F.col("rate")) / F.col("n")))


_CUT5 = "[0.2, 0.4, 0.6, 0.8]"


@query("bin:i n:i rate:f", f"SELECT bin, count(*) AS n, avg(flip) AS rate FROM (SELECT flip, len(list_filter(e, lambda q: imb >= q)) AS bin FROM flips, (SELECT quantile_cont(imb, {_CUT5}) AS e FROM flips) AS x) AS y GROUP BY 1", FLIPS)
def quintile_flip(t):
    return J.digitize(flips(t), "imb", [0.2, 0.4, 0.6, 0.8]).groupBy("bin").agg(F.count("*").alias("n"), F.avg("flip").alias("rate"))


@query("asset bin:i n:i mean:f", "SELECT asset, bin, count(*) AS n, avg(change) AS mean FROM (SELECT b.asset, change, len(list_filter(e, lambda q: change >= q)) AS bin FROM bars b JOIN (SELECT asset, quantile_cont(change, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM bars GROUP BY 1) AS x ON x.asset = b.asset) AS y GROUP BY 1, 2 HAVING count(*) >= 20", H)
def decile_bins(t):
    return J.digitize(bars(t), "change", [i / 10 for i in range(1, 10)], ["asset"]).groupBy("asset", "bin").agg(F.count("*").alias("n"), F.avg("change").alias("mean")).where("n >= 20")


@query("g:i n:i lo:f hi:f", "SELECT g, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM (SELECT c_acctbal, ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS g FROM customer) AS x GROUP BY 1")
def ntile_groups(t):
    g = F.ntile(5).over(W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"))
    return t.customer.select("c_acctbal", g.alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


def auc_sql(src: str, by: str = "asset") -> str:
    return f"""SELECT {by}, sum(c) AS n, CASE WHEN sum(c1) > 0 AND sum(c1) < sum(c) THEN (sum(c1 * r) - sum(c1) * (sum(c1) + 1) / 2.0) / (sum(c1) * CAST(sum(c) - sum(c1) AS DOUBLE)) END AS auc FROM (
    SELECT *, sum(c) OVER (PARTITION BY {by} ORDER BY p) - c + (c + 1) / 2.0 AS r FROM (SELECT {by}, p, count(*) AS c, sum(y) AS c1 FROM {src} GROUP BY {by}, p) AS a1_) AS a2_ GROUP BY {by}"""


@query("bucket n:i auc:f", auc_sql("(SELECT y, p, CASE WHEN v <= e[1] THEN 'lo' WHEN v <= e[2] THEN 'mid' ELSE 'hi' END AS bucket FROM (SELECT *, abs(change) AS v FROM scored) s, (SELECT quantile_cont(abs(change), [0.3333333333333333, 0.6666666666666666]) AS e FROM scored) AS x) AS z", "bucket"), SCORED)
def tercile_auc(t):
    s = scored(t).withColumn("v", F.abs("change"))
    e = J.quantile_edges(s, "v", [1 / 3, 2 / 3]).withColumnRenamed("_edges", "e")
    s = s.crossJoin(F.broadcast(e)).withColumn("bucket", F.when(F.col("v") <= F.col("e")[0], "lo").when(F.col("v") <= F.col("e")[1], "mid").otherwise("hi"))
    return M.auc(s, ["bucket"])


@query("asset bin:i part:f", f"SELECT asset, bin, sum(d * l) / max(s) AS part FROM (SELECT asset, d, coalesce(lag(d) OVER (PARTITION BY asset ORDER BY slot), 0) AS l, bin, sum(d * d) OVER (PARTITION BY asset) AS s FROM (SELECT b.asset, slot, change - m AS d, len(list_filter(e, lambda q: abs(change) >= q)) AS bin FROM bars b JOIN (SELECT asset, avg(change) AS m, quantile_cont(abs(change), {_CUT5}) AS e FROM bars GROUP BY 1) AS a ON a.asset = b.asset) AS y) AS z GROUP BY 1, 2", H)
def rho1_decile_decomp(t):
    """The parts of the first autocorrelation by size of the move; they add up to it."""
    b = J.digitize(bars(t).withColumn("v", F.abs("change")), "v", [0.2, 0.4, 0.6, 0.8], ["asset"])
    b = b.withColumn("d", F.col("change") - F.avg("change").over(W.partitionBy("asset")))
    b = b.withColumn("l", F.coalesce(F.lag("d").over(S.along()), num(0))).withColumn("s", F.sum(F.col("d") * F.col("d")).over(W.partitionBy("asset")))
    return b.groupBy("asset", "bin").agg((F.sum(F.col("d") * F.col("l")) / F.max("s")).alias("part"))


@query("slot:i n:i y:i p:f pp:f py:f ll:f", "SELECT slot, count(*) AS n, sum(y) AS y, sum(p) AS p, sum(p * p) AS pp, sum(p * y) AS py, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll FROM scored GROUP BY 1", SCORED)
def slot_suff_stats(t):
    return scored(t).groupBy("slot").agg(
        F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("p") * F.col("y")).alias("py"), F.sum(log_loss(F.col("y").cast("double"), F.col("p"))).alias("ll"),
    )


@query("asset delta:f cells:i", "SELECT asset, sum(w * (ma - mb)) / sum(w) AS delta, count(*) AS cells FROM (SELECT *, 2.0 * na * nb / (na + nb) AS w FROM (SELECT asset, slot % 24 AS cell, count(CASE WHEN imb > 0 THEN 1 END) AS na, count(CASE WHEN imb <= 0 THEN 1 END) AS nb, avg(CASE WHEN imb > 0 THEN flip END) AS ma, avg(CASE WHEN imb <= 0 THEN flip END) AS mb FROM flips GROUP BY 1, 2) AS x WHERE na > 0 AND nb > 0) AS y GROUP BY 1", FLIPS)
def matched_delta(t):
    """Contrast of two arms within cells, weighted by the harmonic size of the cells."""
    a, b = F.col("imb") > 0, F.col("imb") <= 0
    cells = flips(t).groupBy("asset", (F.col("slot") % 24).alias("cell")).agg(F.count(F.when(a, 1)).alias("na"), F.count(F.when(b, 1)).alias("nb"), F.avg(F.when(a, F.col("flip"))).alias("ma"), F.avg(F.when(b, F.col("flip"))).alias("mb"))
    w = num(2) * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    cells = cells.where("na > 0 and nb > 0").withColumn("w", w)
    return cells.groupBy("asset").agg((F.sum(F.col("w") * (F.col("ma") - F.col("mb"))) / F.sum("w")).alias("delta"), F.count("*").alias("cells"))


@query("slot:i close:f k:i", "SELECT slot, median(close) AS close, count(*) AS k FROM bars GROUP BY 1", H)
def composite_median(t):
    return bars(t).groupBy("slot").agg(F.median("close").alias("close"), F.count("*").alias("k"))


@query("asset ratio:f", "SELECT asset, max(v) / min(v) AS ratio FROM (SELECT asset, slot % 24 AS h, var_pop(change) AS v FROM bars GROUP BY 1, 2 HAVING count(*) > 5 AND var_pop(change) > 0) AS x GROUP BY 1", H)
def hour_var_ratio(t):
    v = bars(t).groupBy("asset", (F.col("slot") % 24).alias("h")).agg(F.var_pop("change").alias("v"), F.count("*").alias("n")).where("n > 5 and v > 0")
    return v.groupBy("asset").agg((F.max("v") / F.min("v")).alias("ratio"))


@query("asset slot:i rest:f", "SELECT asset, b.slot, change - m AS rest FROM bars b JOIN (SELECT slot % 24 AS h, median(change) AS m FROM bars GROUP BY 1) AS x ON b.slot % 24 = x.h", H)
def slot_median_resid(t):
    b = bars(t).withColumn("h", F.col("slot") % 24)
    return b.join(b.groupBy("h").agg(F.median("change").alias("m")), "h").withColumn("rest", F.col("change") - F.col("m"))


@query("asset wins:i", "SELECT asset, count(*) AS wins FROM (SELECT arg_min(asset, CAST(abs(change) AS VARCHAR) || asset) AS asset FROM (SELECT slot, asset, round(abs(change), 6) AS change FROM bars WHERE abs(change) < 10 AND abs(change) >= 0.001) AS y GROUP BY slot) AS x GROUP BY 1", H)
def win_counts(t):
    b = bars(t).select("slot", "asset", F.round(F.abs("change"), 6).alias("v"), F.abs("change").alias("a")).where("a < 10 and a >= 0.001")
    best = b.groupBy("slot").agg(F.min_by("asset", F.struct("v", "asset")).alias("asset"))
    return best.groupBy("asset").agg(F.count("*").alias("wins"))


@query("bin:i n:i", "SELECT CAST(floor((c_acctbal + 1000) / 1000) AS BIGINT) AS bin, count(*) AS n FROM customer GROUP BY 1")
def histogram(t):
    return t.customer.groupBy(F.floor((F.col("c_acctbal") + 1000) / 1000).alias("bin")).agg(F.count("*").alias("n"))


@query("asset n:i up:i", "SELECT coalesce(asset, 'ALL') AS asset, count(*) AS n, sum(CASE WHEN up THEN 1 ELSE 0 END) AS up FROM bars GROUP BY ROLLUP (asset)", H)
def rollup_pooled(t):
    return bars(t).rollup("asset").agg(F.count("*").alias("n"), F.sum(F.col("up").cast("int")).alias("up")).withColumn("asset", F.coalesce("asset", F.lit("ALL")))


@query("asset role_mean:f z:f", "SELECT asset, m AS role_mean, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS z FROM (SELECT asset, avg(change) AS m FROM bars GROUP BY 1) AS x", H)
def family_z(t):
    m = bars(t).groupBy("asset").agg(F.avg("change").alias("role_mean"))
    u = m.agg(F.avg("role_mean").alias("u"), F.stddev_pop("role_mean").alias("s"))
    return m.crossJoin(F.broadcast(u)).withColumn("z", F.try_divide(F.col("role_mean") - F.col("u"), F.col("s")))


# Series functions.


@query("asset slot:i l1:f l2:f l3:f", f"SELECT asset, slot, lag(change, 1) {OVER} AS l1, lag(change, 2) {OVER} AS l2, lag(change, 3) {OVER} AS l3 FROM bars", H)
def lag_matrix(t):
    cols = S.lags(F.col("change"), 3, S.along())
    return bars(t).select("asset", "slot", *(c.alias(f"l{k}") for k, c in enumerate(cols, 1)))


@query("asset slot:i field:f", f"SELECT asset, slot, {field_sql('tanh(150 * change)')} AS field FROM bars", H)
def power_law_field(t):
    b = bars(t).withColumn("s", F.tanh(F.col("change") * num(150)))
    return b.withColumn("field", S.kernel_field(F.col("s"), S.power_law(12, 1.0), S.along()))


@query("asset slot:i field:f", f"SELECT asset, slot, {field_sql('change', 4)} AS field FROM bars QUALIFY slot - lag(slot, 4) {OVER} = 4", H)
def gap_aware_field(t):
    b = bars(t).withColumn("field", S.kernel_field(F.col("change"), S.power_law(4, 1.0), S.along()))
    return b.withColumn("ok", S.contiguous("slot", 4, S.along())).where("ok")


_FRAME = "OVER (PARTITION BY asset ORDER BY slot ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@query("asset slot:i mean_abs:f vol:f sd:f", f"SELECT asset, slot, CASE WHEN count(change) {_FRAME} >= 10 THEN avg(abs(change)) {_FRAME} END AS mean_abs, CASE WHEN count(change) {_FRAME} >= 10 THEN sqrt(avg(change * change) {_FRAME}) END AS vol, CASE WHEN count(change) {_FRAME} >= 10 THEN stddev_pop(change) {_FRAME} END AS sd FROM bars", H)
def trailing_stats(t):
    w, c = S.along(), F.col("change")
    return bars(t).select("asset", "slot", S.trailing(F.avg, F.abs(c), 24, w, 10).alias("mean_abs"), F.sqrt(S.trailing(F.avg, c * c, 24, w, 10)).alias("vol"), S.trailing(F.stddev_pop, c, 24, w, 10).alias("sd"))


_RUNS = f"{H}, runs AS (SELECT *, count(*) OVER (PARTITION BY asset, run) AS run_n FROM (SELECT *, sum(b) OVER (PARTITION BY asset ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN slot - lag(slot) {OVER} = 1 THEN 0 ELSE 1 END AS b FROM bars) AS r1_) AS r2_)"


@query("asset run:i n:i first:i", "SELECT asset, run, count(*) AS n, min(slot) AS first FROM runs WHERE run_n > 11 GROUP BY 1, 2", _RUNS)
def run_sessionize(t):
    return S.runs(bars(t), "slot", 1).where("run_n > 11").groupBy("asset", "run").agg(F.count("*").alias("n"), F.min("slot").alias("first"))


@query("asset k:i rho:f", " UNION ALL ".join(f"SELECT asset, {k} AS k, corr(change, l) AS rho FROM (SELECT asset, change, lag(vol, {k}) OVER (PARTITION BY asset, run ORDER BY slot) AS l FROM runs WHERE run_n > 11) AS x{k} GROUP BY asset" for k in (1, 2)), _RUNS)
def xcorr_runs(t):
    r = S.runs(bars(t), "slot", 1).where("run_n > 11")
    w = W.partitionBy("asset", "run").orderBy("slot")
    r = r.select("asset", "change", *(F.lag("vol", k).over(w).alias(f"v{k}") for k in (1, 2)))
    s = r.groupBy("asset").agg(*(corr("change", f"v{k}").alias(f"c{k}") for k in (1, 2)))
    return s.select("asset", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("rho")) for k in (1, 2)))).alias("p")).select("asset", "p.*")


_AC = f"{H}, cen AS (SELECT asset, slot, change - avg(change) OVER (PARTITION BY asset) AS d FROM bars), lagged AS (SELECT asset, d, k, lag(d, CAST(k AS INTEGER)) OVER (PARTITION BY asset, k ORDER BY slot) AS l FROM cen, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]) AS k) AS k_), ac AS (SELECT asset, k AS lag_, sum(d * l) / sum(d * d) AS rho, count(*) AS n FROM lagged GROUP BY 1, 2)"


@query("asset lag:i rho:f", "SELECT asset, lag_ AS lag, rho FROM ac", _AC)
def autocorr_k(t):
    return S.autocorrelation(bars(t), "change", 12)


@query("asset q:f p:f", "SELECT asset, q, exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24 + pow(q / 2, 5) / 120) AS p FROM (SELECT asset, max(n) * (max(n) + 2.0) * sum(rho * rho / (n - lag_)) AS q FROM ac GROUP BY 1) AS x", _AC)
def ljung_box(t):
    return I.ljung_box(bars(t), "change", 12)


_PNL = "CASE WHEN abs(p - 0.5) >= 0.02 THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE -1.0 END ELSE 0.0 END"
_EQ = f"{SCORED}, eq AS (SELECT *, greatest(max(equity) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) - equity AS drawdown FROM (SELECT *, sum(pnl) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT *, {_PNL} AS pnl FROM scored) AS e1_) AS e2_)"


@query("asset pos:i equity:f drawdown:f", "SELECT * FROM eq", _EQ)
def equity_drawdown(t):
    s = scored(t)
    return S.equity(s.withColumn("pnl", X.even_money(F.col("p"), F.col("y"), num(0.02))), "pnl", S.along(order="pos"))


@query("asset pos:i s4:f", "SELECT asset, pos, sum(change) OVER (PARTITION BY asset ORDER BY pos ROWS 3 PRECEDING) AS s4 FROM days QUALIFY pos >= 3", DAYS)
def overlap_qsum(t):
    return days(t).withColumn("s4", F.sum("change").over(S.along(order="pos").rowsBetween(-3, 0))).where("pos >= 3")


_DFA = ", prof AS (SELECT asset, pos, n, sum(change - m) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, avg(change) OVER (PARTITION BY asset) AS m FROM days) AS p1_), fluct AS (SELECT asset, s AS scale, sqrt(avg(greatest(vy - c * c / vt, 0))) AS fluctuation FROM (SELECT asset, s, floor(pos / s) AS box, var_pop(v) AS vy, covar_pop(pos % s, v) AS c, var_pop(pos % s) AS vt FROM prof, (SELECT unnest([8, 16, 32, 64, 128]) AS s) AS s_ WHERE pos < floor(n / s) * s AND floor(n / s) >= 8 GROUP BY 1, 2, 3) AS f1_ GROUP BY 1, 2)"
_SCALES = [8, 16, 32, 64, 128]


@query("asset scale:i fluctuation:f", "SELECT * FROM fluct", DAYS + _DFA)
def dfa1(t):
    return S.dfa(days(t).drop("pos", "n"), "change", _SCALES)


@query("asset h:f", "SELECT asset, regr_slope(ln(fluctuation), ln(scale)) AS h FROM fluct GROUP BY 1", DAYS + _DFA)
def dfa_hurst(t):
    return S.hurst(S.dfa(days(t).drop("pos", "n"), "change", _SCALES))


@query("asset pos:i ordinal:i average:f norm:f", "SELECT asset, pos, ordinal, r + (c - 1) / 2.0 AS average, (ordinal - 1.0) / (n - 1) AS norm FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p, pos) AS ordinal, rank() OVER (PARTITION BY asset ORDER BY p) AS r, count(*) OVER (PARTITION BY asset, p) AS c FROM scored) AS x", SCORED)
def rank_ordinal_avg(t):
    w = W.partitionBy("asset").orderBy("p")
    s = scored(t).withColumn("ordinal", F.row_number().over(W.partitionBy("asset").orderBy("p", "pos")))
    s = s.withColumn("average", F.rank().over(w) + (F.count("*").over(W.partitionBy("asset", "p")) - 1) / num(2))
    return s.withColumn("norm", (F.col("ordinal") - 1) / (F.col("n") - 1))


@query("asset state n:i up:i", "SELECT asset, state, count(*) AS n, sum(y) AS up FROM (SELECT asset, y, CAST(lag(y, 2) OVER (PARTITION BY asset ORDER BY pos) AS VARCHAR) || CAST(lag(y, 1) OVER (PARTITION BY asset ORDER BY pos) AS VARCHAR) AS state FROM days) AS x GROUP BY 1, 2", DAYS)
def markov_state(t):
    return days(t).withColumn("state", S.markov_state(F.col("y"), 2, S.along(order="pos"))).groupBy("asset", "state").agg(F.count("*").alias("n"), F.sum("y").alias("up"))


# Walk-forward models.

_TRAIN = "trained AS (SELECT asset, f AS fold, pos, y, state FROM states JOIN range(60) r(f) ON pos >= f * 120 AND pos < f * 120 + 720 AND f * 120 + 720 < n), tested AS (SELECT *, CAST(floor((pos - 720) / 120.0) AS BIGINT) AS fold FROM states WHERE pos >= 720)"


def _markov_ctes(m: int) -> str:
    state = " || ".join(f"CAST(lag(y, {k}) OVER (PARTITION BY asset ORDER BY pos) AS VARCHAR)" for k in range(m, 0, -1))
    return f"{DAYS}, states AS (SELECT *, {state} AS state FROM days), {_TRAIN}, base AS (SELECT asset, fold, avg(y) AS pb FROM trained GROUP BY 1, 2), fit AS (SELECT asset, fold, state, (sum(y) + 1.0) / (count(*) + 2) AS ps FROM trained WHERE state IS NOT NULL GROUP BY 1, 2, 3), wf AS (SELECT t.asset, t.pos, t.fold, t.y, coalesce(ps, pb) AS p FROM tested t JOIN base b ON t.asset = b.asset AND t.fold = b.fold LEFT JOIN fit f ON t.asset = f.asset AND t.fold = f.fold AND t.state = f.state)"


WF = "asset pos:i fold:i y:i p:f"


@query(WF, "SELECT t.asset, t.pos, t.fold, t.y, pb AS p FROM tested t JOIN base b ON t.asset = b.asset AND t.fold = b.fold", _markov_ctes(1))
def wf_base_rate(t):
    return D.base_rate(days(t), 720, 120)


@query(WF, "SELECT * FROM wf", _markov_ctes(1))
def wf_markov1(t):
    return D.markov(days(t), 720, 120, 1)


@query(WF, "SELECT * FROM wf", _markov_ctes(2))
def wf_markov2(t):
    return D.markov(days(t), 720, 120, 2)


_FIT = "asset pos:i fold:i y:i p:f"


@query(_FIT)
def wf_kernel_logit(t):
    return D.walk_forward(days(t), D.KernelLogit(), 720, 120)


@query(_FIT)
def wf_vol_standardised(t):
    return D.walk_forward(days(t), D.KernelLogit(scale=None), 720, 120)


@query(_FIT)
def wf_free_ar(t):
    return D.walk_forward(days(t), D.LagLogit(), 720, 120)


@query(_FIT)
def wf_ar1(t):
    return D.walk_forward(days(t), D.LagLogit(n_lags=1), 720, 120)


@query(_FIT)
def wf_l2_ar(t):
    return D.walk_forward(days(t), D.LagLogit(choose=D.RIDGES), 720, 120)


@query("model asset pos:i fold:i y:i p:f")
def subsumption(t):
    """Do signs say what flow imbalance says? Logits on the lags of signs, of the imbalance and of both, on 15-minute flow bars."""
    b = bars(t, 900).withColumn("imb", F.when(F.col("vol") > 0, num(2) * F.col("tbv") / F.col("vol") - num(1)))
    b = S.positioned(b.withColumn("sign", F.signum("change")).withColumn("y", F.col("up").cast("int")))
    return D.feature_logits(b, {"signs": ["sign"], "imb": ["imb"], "both": ["sign", "imb"]}, 720, 120)


@query("kernel asset n:i auc:f")
def kernel_family(t):
    """Power, exponential and flat kernels on one footing."""
    d, grid = days(t), tuple(round(0.1 * i, 1) for i in range(31))
    parts = [D.walk_forward(d, D.KernelLogit(kernel=k, grid=grid), 720, 120).select(F.lit(k).alias("kernel_"), "asset", "pos", "y", "p") for k in ("power", "exp", "flat")]
    return M.auc(J.union_all(parts).withColumnRenamed("kernel_", "kernel"), ["kernel", "asset"])


@query("model n_lags:i asset auc:f nll:f train_nll:f")
def lag_sweep(t):
    """Free, ridge and kernel logits of 2 to 48 lags: AUC and log-loss out of sample, and the mean log-loss in training."""
    d = days(t)
    kinds = {"free": lambda n: D.LagLogit(n), "l2": lambda n: D.LagLogit(n, choose=D.RIDGES), "kernel": lambda n: D.KernelLogit(n)}
    parts = [D.walk_forward(d, make(n), 720, 120).select(F.lit(kind).alias("model"), F.lit(n).alias("n_lags"), "asset", "pos", "fold", "y", "p", "train_nll") for kind, make in kinds.items() for n in (2, 4, 6, 8, 12, 16, 24, 36, 48)]
    each, by = J.union_all(parts), ["model", "n_lags", "asset"]
    folds = each.groupBy(*by, "fold").agg(F.sum(log_loss(F.col("y").cast("double"), F.col("p"))).alias("l"), F.count("*").alias("n"), F.first("train_nll").alias("t"))
    nll = folds.groupBy(*by).agg((F.sum("l") / F.sum("n")).alias("nll"), F.avg("t").alias("train_nll"))
    return M.auc(each.drop("fold", "train_nll"), by).join(nll, by)


@query("asset kernel:f a:f folds:i stable:f")
def implied_weights(t):
    """Mean kernel parameter and coupling over folds, and the share of folds with the coupling's modal sign."""
    f = D.walk_forward(days(t), D.KernelLogit(), 720, 120).groupBy("asset", "fold").agg(F.first("a").alias("a"), F.first("kernel").alias("kernel"))
    share = F.avg((F.col("a") > 0).cast("double"))
    return f.groupBy("asset").agg(F.avg("kernel").alias("kernel"), F.avg("a").alias("a"), F.count("*").alias("folds"), F.greatest(share, num(1) - share).alias("stable"))


# Metrics.


@query("asset n:i auc:f", auc_sql("scored"), SCORED)
def auc_avg_rank(t):
    return M.auc(scored(t), ["asset"])


@query("asset n:i auc:f", "SELECT asset, count(*) AS n, (sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(count(*) - sum(y) AS DOUBLE)) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY p, pos) AS r FROM scored) AS x GROUP BY 1", SCORED)
def auc_ordinal(t):
    return M.auc(scored(t), ["asset"], "ordinal")


@query("hour:i n:i auc:f", auc_sql("(SELECT y, p, slot % 24 AS hour FROM scored) AS z", "hour"), SCORED)
def auc_by_hour(t):
    return M.auc(scored(t).withColumn("hour", F.col("slot") % 24), ["hour"])


@query("auc:f", f"SELECT sum(n * auc) / sum(n) AS auc FROM ({auc_sql('(SELECT y, p, slot % 24 AS hour FROM scored) AS z', 'hour')}) AS w WHERE auc IS NOT NULL", SCORED)
def stratified_auc(t):
    return M.auc(scored(t).withColumn("hour", F.col("slot") % 24), ["hour"]).where("auc is not null").agg((F.sum(F.col("n") * F.col("auc")) / F.sum("n")).alias("auc"))


_CM = "SELECT asset, count(*) AS n, CAST(count(CASE WHEN p > 0.5 AND y = 1 THEN 1 END) AS DOUBLE) AS tp, CAST(count(CASE WHEN p > 0.5 AND y = 0 THEN 1 END) AS DOUBLE) AS fp, CAST(count(CASE WHEN p <= 0.5 AND y = 1 THEN 1 END) AS DOUBLE) AS fn, CAST(count(CASE WHEN p <= 0.5 AND y = 0 THEN 1 END) AS DOUBLE) AS tn, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1"


@query("asset n:i accuracy:f edge:f balanced:f f1:f mcc:f log_loss:f brier:f base_rate:f", f"SELECT asset, n, (tp + tn) / n AS accuracy, (tp + tn) / n - greatest((tp + fn) / n, 1 - (tp + fn) / n) AS edge, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced, 2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, log_loss, brier, (tp + fn) / n AS base_rate FROM ({_CM}) AS x", SCORED)
def confusion_metrics(t):
    return M.confusion(scored(t), ["asset"])


@query("asset skill:f", "SELECT asset, 1000 * (-(avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) - avg(-(y * ln(p) + (1 - y) * ln(1 - p)))) AS skill FROM scored GROUP BY 1", SCORED)
def skill_mnats(t):
    s = scored(t).groupBy("asset").agg(F.avg("y").alias("b"), F.avg(log_loss(F.col("y").cast("double"), F.col("p"))).alias("l"))
    return s.withColumn("skill", num(1000) * (log_loss(F.col("b"), F.col("b")) - F.col("l")))


@query("asset bin:i n:i mean_p:f mean_y:f", "SELECT asset, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM scored GROUP BY 1, 2", SCORED)
def calibration_bins(t):
    return M.reliability(scored(t), ["asset"])


@query("asset slope:f ece:f", "SELECT s.asset, slope, ece FROM (SELECT asset, covar_pop(y, p) / var_pop(p) AS slope FROM scored GROUP BY 1) s JOIN (SELECT asset, sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT asset, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1, 2) AS x GROUP BY 1) e ON s.asset = e.asset", SCORED)
def calibration_slope(t):
    return M.calibration(scored(t), ["asset"])


_TAUS = [0.0, 0.01, 0.02, 0.05, 0.1]


@query("asset tau:f n_bets:i coverage:f accuracy:f edge_bp:f", f"SELECT asset, tau, count(CASE WHEN b THEN 1 END) AS n_bets, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN b THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END END) AS accuracy, 10000 * avg(CASE WHEN b THEN CASE WHEN p > 0.5 THEN change ELSE -change END END) AS edge_bp FROM (SELECT *, abs(p - 0.5) >= tau AS b FROM scored, (SELECT unnest({_TAUS}) AS tau) AS t_) AS x GROUP BY 1, 2 HAVING count(CASE WHEN b THEN 1 END) >= 50", SCORED)
def selective_tau(t):
    return M.selective(scored(t), ["asset"], _TAUS)


# Inference.

_PV = "pv AS (SELECT c_custkey AS k, (c_custkey * 7919 % 10007 + 1) / 10008.0 * CASE WHEN c_custkey % 5 = 0 THEN 0.001 ELSE 1 END AS p FROM customer)"


def pvalues(t):
    p = (F.col("c_custkey") * 7919 % 10007 + 1) / num(10008) * F.when(F.col("c_custkey") % 5 == 0, num(0.001)).otherwise(num(1))
    return t.customer.select(F.col("c_custkey").alias("k"), p.alias("p"))


@query("k:i rank:i rejected", "SELECT k, r AS rank, r <= coalesce(max(CASE WHEN p <= 0.05 * r / n THEN r END) OVER (), 0) AS rejected FROM (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS n FROM pv) AS x", _PV)
def bh_fdr(t):
    return I.benjamini_hochberg(pvalues(t), "p", "k")


@query("k:i p:f", "SELECT k, greatest(p, 1 - p, 1 / 301.0) AS p FROM pv", _PV)
def iut_conj(t):
    return I.conjunction(pvalues(t).withColumnRenamed("p", "p1").withColumn("p2", num(1) - F.col("p1")), "p1", "p2", 300)


@query("asset r:f", f"SELECT asset, coalesce(nullif(corr(s, f), CAST('NaN' AS DOUBLE)), 0) AS r FROM (SELECT asset, pos, s, {field_sql('s')} AS f FROM (SELECT asset, slot, pos, CAST(sign(change) AS DOUBLE) AS s FROM days) AS x) AS y WHERE pos >= 12 GROUP BY 1", DAYS)
def kernel_R(t):
    return I.kernel_correlation(days(t).drop("pos", "n"), "change")


@query("asset vr:f z:f", "SELECT asset, vr, (vr - 1) / sqrt((t1 * 2.25 + t2 * 1.0 + t3 * 0.25) / (s1 * s1)) AS z FROM (SELECT *, sq / (4 * (n - 3) * (1 - 4.0 / n)) / (s1 / (n - 1)) AS vr FROM (SELECT asset, max(n) AS n, sum(d * d) AS s1, sum(CASE WHEN pos >= 3 THEN w * w END) AS sq, sum(d * d * d1 * d1) AS t1, sum(d * d * d2 * d2) AS t2, sum(d * d * d3 * d3) AS t3 FROM (SELECT asset, pos, n, d, sum(d) OVER (PARTITION BY asset ORDER BY pos ROWS 3 PRECEDING) AS w, lag(d, 1) OVER (PARTITION BY asset ORDER BY pos) AS d1, lag(d, 2) OVER (PARTITION BY asset ORDER BY pos) AS d2, lag(d, 3) OVER (PARTITION BY asset ORDER BY pos) AS d3 FROM (SELECT *, change - avg(change) OVER (PARTITION BY asset) AS d FROM days) AS a) AS b GROUP BY 1) AS c) AS e", DAYS)
def variance_ratio(t):
    return I.variance_ratio(days(t).drop("pos", "n"), "change", 4)


@query("asset n:i slope:f intercept:f r2:f se:f t:f", "SELECT *, slope / se AS t FROM (SELECT asset, n, slope, intercept, r2, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS se FROM (SELECT asset, regr_count(vol, ntr) AS n, regr_slope(vol, ntr) AS slope, regr_intercept(vol, ntr) AS intercept, regr_r2(vol, ntr) AS r2, regr_sxx(vol, ntr) AS sxx, regr_syy(vol, ntr) AS syy FROM bars GROUP BY 1) AS x) AS y", H)
def ols_slope(t):
    return I.ols(bars(t).withColumn("ntr", F.col("ntr").cast("double")), ["asset"], "vol", "ntr")


@query("asset slope:f se:f", "SELECT asset, slope, sqrt(sum(d * d * e * e) * n / (n - 2)) / sxx AS se FROM (SELECT b.asset, slope, sxx, n, ntr - mx AS d, vol - b0 - slope * ntr AS e FROM bars b JOIN (SELECT asset, regr_slope(vol, ntr) AS slope, regr_intercept(vol, ntr) AS b0, avg(ntr) AS mx, regr_sxx(vol, ntr) AS sxx, CAST(count(*) AS DOUBLE) AS n FROM bars GROUP BY 1) AS f ON f.asset = b.asset) AS x GROUP BY asset, slope, sxx, n", H)
def hc1_ols(t):
    return I.ols_hc1(bars(t).withColumn("ntr", F.col("ntr").cast("double")), ["asset"], "vol", "ntr")


@query("asset rho:f", "SELECT asset, corr(rx, ry) AS rho FROM (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY vol) + (count(*) OVER (PARTITION BY asset, vol) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY asset ORDER BY ntr) + (count(*) OVER (PARTITION BY asset, ntr) - 1) / 2.0 AS ry FROM bars) AS x GROUP BY 1", H)
def spearman(t):
    return I.spearman(bars(t), ["asset"], "vol", "ntr")


@query("asset beta:f resid_sd:f", "SELECT b.asset, beta, stddev_pop(change - beta * factor) AS resid_sd FROM fac b JOIN (SELECT asset, covar_samp(change, factor) / var_pop(factor) AS beta FROM fac WHERE pos < floor(n / 2.0) GROUP BY 1) AS f ON f.asset = b.asset WHERE pos >= floor(n / 2.0) GROUP BY 1, 2", f"{H}, fac AS (SELECT asset, change, avg(change) OVER (PARTITION BY slot) AS factor, row_number() {OVER} - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM bars)")
def factor_beta(t):
    return I.factor_beta(J.with_factor(bars(t), "slot", "change"), "change", "factor")


@query("did:f", "SELECT max(CASE WHEN c = 'A' THEN post - pre END) - max(CASE WHEN c = 'B' THEN post - pre END) AS did FROM (SELECT CASE WHEN asset IN ('click', 'view') THEN 'A' ELSE 'B' END AS c, avg(CASE WHEN slot >= 473200 THEN flip END) AS post, avg(CASE WHEN slot < 473200 THEN flip END) AS pre FROM flips GROUP BY 1) AS x", FLIPS)
def did(t):
    post = F.col("slot") >= 473200
    s = flips(t).groupBy(F.when(F.col("asset").isin("click", "view"), "A").otherwise("B").alias("c")).agg((F.avg(F.when(post, F.col("flip"))) - F.avg(F.when(~post, F.col("flip")))).alias("d"))
    return s.agg((F.max(F.when(F.col("c") == "A", F.col("d"))) - F.max(F.when(F.col("c") == "B", F.col("d")))).alias("did"))


@query("slope:f bins:i", f"SELECT regr_slope(m, bin) AS slope, count(*) AS bins FROM (SELECT bin, avg(flip) AS m FROM (SELECT flip, len(list_filter(e, lambda q: imb >= q)) AS bin FROM flips, (SELECT quantile_cont(imb, {_CUT5}) AS e FROM flips) AS x) AS y GROUP BY 1 HAVING count(*) > 30) AS z", FLIPS)
def dose_slope(t):
    m = J.digitize(flips(t), "imb", [0.2, 0.4, 0.6, 0.8]).groupBy("bin").agg(F.avg("flip").alias("m"), F.count("*").alias("n")).where("n > 30")
    return m.agg(F.regr_slope("m", F.col("bin").cast("double")).alias("slope"), F.count("*").alias("bins"))


@query("asset rho:f auc:f")
def linear_channel(t):
    """The AUC that a linear channel of the first autocorrelation implies: Phi(c |rho|), c = 2 sqrt(2 / pi)."""
    rho = S.autocorrelation(bars(t), "change", 1)
    return rho.withColumn("auc", normal_cdf(num(2 * (2 / np.pi) ** 0.5) * F.abs("rho")))


@query("asset zero_frac:f med_abs:f n_nz:i", "SELECT asset, avg(CASE WHEN change = 0 THEN 1.0 ELSE 0.0 END) AS zero_frac, median(abs(change)) AS med_abs, count(CASE WHEN change <> 0 THEN 1 END) AS n_nz FROM bars GROUP BY 1", H)
def microstructure(t):
    flat = F.col("change") == 0
    return bars(t).groupBy("asset").agg(F.avg(flat.cast("double")).alias("zero_frac"), F.median(F.abs("change")).alias("med_abs"), F.count(F.when(~flat, 1)).alias("n_nz"))


# Resampling.

_BASE = 473_352  # the first hour slot of the test month


def _on_grid(t):
    """All scored bars with slots counted from the first, and how many slots they span."""
    s = scored(t)
    base, last = s.agg(F.min("slot"), F.max("slot")).first()
    base = base or 0
    return s.select("asset", (F.col("slot") - base).cast("int").alias("slot"), "y", "p", "change"), (last or 0) - base + 1


def _length(d):
    """The positions of the longest series."""
    return (d.agg(F.max("pos")).first()[0] or 0) + 1


def _starts(n, block, reps, seed):
    return np.random.default_rng(seed).integers(0, max(1, n - block + 1), (reps, -(-n // block))).tolist()


_BOOT = f"{DAYS}, draws AS (SELECT b, (b * 7919 + k * 104729) % greatest(1, n - 49) + i AS pos FROM (SELECT max(n) AS n FROM days) AS n_, range(200) r(b), range(400) s(k), range(50) u(i) WHERE k * 50 + i < n), rep AS (SELECT b, asset, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) - 0.5 AS x FROM draws JOIN days ON draws.pos = days.pos GROUP BY 1, 2 UNION ALL SELECT -1, asset, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) - 0.5 FROM days GROUP BY 2)"


@query("asset estimate:f lo:f hi:f p:f", "SELECT asset, max(CASE WHEN b < 0 THEN x END) AS estimate, quantile_cont(CASE WHEN b >= 0 THEN x END, 0.025) AS lo, quantile_cont(CASE WHEN b >= 0 THEN x END, 0.975) AS hi, avg(CASE WHEN b >= 0 THEN CASE WHEN x <= 0 THEN 1.0 ELSE 0.0 END END) AS p FROM rep GROUP BY 1", _BOOT)
def block_boot_ci(t):
    """An additive statistic: sums by slot meet the draws, no row is copied."""
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), F.col("y").cast("double").alias("y"))
    n = _length(d)
    w = J.resampled(d, R.drawn_slots(R.block_starts(t.spark, n, 50, 200), n, 50), "pos")
    rep = w.groupBy("asset", "b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w") - num(0.5)).alias("x"))
    own = d.groupBy("asset").agg((F.avg("y") - num(0.5)).alias("x")).withColumn("b", F.lit(-1))
    return R.interval(rep.unionByName(own.select("asset", "b", "x")), ["asset"], "x")


def _gap(rows):
    cls = F.col("asset").isin("click", "view")
    return rows.groupBy("b").agg((F.avg(F.when(cls, F.col("auc"))) - F.avg(F.when(~cls, F.col("auc")))).alias("x")).withColumn("stat", F.lit("gap"))


BOOT = "stat estimate:f lo:f hi:f p:f"


@query(BOOT)
def joint_gap_boot(t):
    s, n = _on_grid(t)
    return R.interval(_gap(R.joint_auc_bootstrap(s, _starts(n, 48, 200, 7), n, 48)), ["stat"], "x")


@query(BOOT)
def nonflat_gap_boot(t):
    s, n = _on_grid(t)
    return R.interval(_gap(R.joint_auc_bootstrap(s.where("change <> 0"), _starts(n, 48, 200, 7), n, 48, multiplicity=False)), ["stat"], "x")


@query("asset estimate:f lo:f hi:f p:f")
def asset_auc_boot(t):
    s, n = _on_grid(t)
    rep = R.joint_auc_bootstrap(s, _starts(n, 24, 200, 5), n, 24)
    return R.interval(rep.withColumn("x", F.col("auc") - num(0.5)), ["asset"], "x")


@query("block:i estimate:f lo:f hi:f p:f")
def block_length_sensitivity(t):
    s, n = _on_grid(t)
    parts = [_gap(R.joint_auc_bootstrap(s, _starts(n, b, 100, 3), n, b)).withColumn("block", F.lit(b)) for b in (12, 24, 48)]
    return R.interval(J.union_all(parts), ["block"], "x")


@query(BOOT)
def paired_boot(t):
    """Two legs on their common slots and one draw."""
    s, n = _on_grid(t)
    both = J.common_slots(s.where("asset in ('click', 'view')"), "asset", "slot", 2)
    rep = R.joint_auc_bootstrap(s.where("asset in ('click', 'view')").join(both, "slot", "left_semi"), _starts(n, 48, 200, 11), n, 48)
    side = lambda a: F.max(F.when(F.col("asset") == a, F.col("auc")))
    return R.interval(rep.groupBy("b").agg((side("click") - side("view")).alias("x")).withColumn("stat", F.lit("click-view")), ["stat"], "x")


@query("asset lo:f hi:f runs:i", "SELECT asset, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, max(k) AS runs FROM (SELECT b, r.asset, sum(m) / sum(c) AS x, max(k) AS k FROM (SELECT b, asset, (b * 7919 + i * 104729) % k AS id, k FROM (SELECT asset, count(*) AS k FROM rr GROUP BY 1) AS n, range(100) q(b), range(1000) s(i) WHERE i < k) AS d JOIN (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY run) - 1 AS id, m, c FROM rr) AS r ON r.asset = d.asset AND r.id = d.id GROUP BY 1, 2) AS x GROUP BY 1", f"{_RUNS}, rr AS (SELECT asset, run, sum(change) AS m, count(*) AS c FROM runs GROUP BY 1, 2)")
def run_boot(t):
    """Whole runs are resampled: their sums are what is drawn."""
    rr = S.runs(bars(t), "slot", 1).groupBy("asset", "run").agg(F.sum("change").alias("m"), F.count("*").alias("c"))
    rr = rr.withColumn("id", F.row_number().over(W.partitionBy("asset").orderBy("run")) - 1).withColumn("k", F.count("*").over(W.partitionBy("asset")))
    draws = rr.select("asset", "k", F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    draws = draws.withColumn("id", (F.col("b") * 7919 + F.col("i") * 104729) % F.col("k"))
    x = draws.join(rr.select("asset", "id", "m", "c"), ["asset", "id"]).groupBy("asset", "b").agg((F.sum("m") / F.sum("c")).alias("x"), F.max("k").alias("k"))
    q = F.percentile("x", F.array(num(0.025), num(0.975)))
    return x.groupBy("asset").agg(q.alias("q"), F.max("k").alias("runs")).select("asset", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "runs")


@query("asset p:f n:i", "SELECT a.asset, (1 + sum(CASE WHEN x >= o THEN 1 ELSE 0 END)) / (1.0 + count(*)) AS p, count(*) AS n FROM (SELECT l.asset, s, avg(CASE WHEN l.y = r.y THEN 1.0 ELSE 0.0 END) AS x FROM days l JOIN (SELECT asset, y, s, (pos + s * 7 + 1) % n + 1 AS q FROM days, range(4, 30) g(s)) AS r ON l.asset = r.asset AND l.pos + 1 = r.q GROUP BY 1, 2) AS a JOIN (SELECT l.asset, avg(CASE WHEN l.y = r.y THEN 1.0 ELSE 0.0 END) AS o FROM days l JOIN (SELECT asset, y, (pos + 1) % n + 1 AS q FROM days) AS r ON l.asset = r.asset AND l.pos + 1 = r.q GROUP BY 1) AS b ON a.asset = b.asset GROUP BY 1", DAYS)
def circular_shift_null(t):
    """Whole-week shifts of the label against the one-day agreement: p = (1 + exceedances) / (1 + shifts)."""
    d = days(t).select("asset", "pos", "n", "y")
    r = d.select("asset", "n", F.col("pos").alias("q"), F.col("y").alias("z"), F.explode(F.sequence(F.lit(3), F.lit(29))).alias("s"))
    r = r.withColumn("pos", F.pmod(F.col("q") + F.when(F.col("s") == 3, 1).otherwise(F.col("s") * 7 + 1), F.col("n"))).drop("n")
    x = d.join(r, ["asset", "pos"]).groupBy("asset", "s").agg(F.avg((F.col("y") == F.col("z")).cast("double")).alias("x"))
    own = F.max(F.when(F.col("s") == 3, F.col("x"))).over(W.partitionBy("asset"))
    x = x.withColumn("o", own).where("s > 3")
    return x.groupBy("asset").agg(((F.sum((F.col("x") >= F.col("o")).cast("int")) + 1) / (F.count("*") + num(1))).alias("p"), F.count("*").alias("n"))


@query("p_gap:f n:i")
def exact_perm(t):
    """All reassignments of the series' mean returns to two labelled groups."""
    m = sorted((r["asset"], r["m"]) for r in bars(t).groupBy("asset").agg(F.avg("change").alias("m")).collect())
    values = [x for _, x in m]
    perms = t.spark.createDataFrame([(list(map(float, p)),) for p in itertools.permutations(values)], "v array<double>")
    gap = F.abs((F.col("v")[0] + F.col("v")[1]) / 2 - (F.col("v")[2] + F.col("v")[3] + F.col("v")[4]) / 3)
    own = abs((values[0] + values[1]) / 2 - sum(values[2:5]) / 3)
    return perms.agg(F.avg((gap >= own - 1e-12).cast("double")).alias("p_gap"), F.count("*").alias("n"))


@query("p:f n:i")
def group_perm(t):
    """Random relabelling of series: p = (1 + exceedances) / (1 + shuffles), in tasks of their own seeds."""
    m = [r["m"] for r in days(t).groupBy("asset").agg(F.avg("change").alias("m")).orderBy("asset").collect()]

    def run(parts):
        for pdf in parts:
            out = []
            for i in pdf["id"]:
                v = np.random.default_rng(int(i)).permutation(m)
                out.append(abs(v[:2].mean() - v[2:].mean()))
            yield pd.DataFrame({"x": out})

    own = abs(np.mean(m[:2]) - np.mean(m[2:]))
    x = t.spark.range(0, 2000, 1, 4).mapInPandas(run, "x double")
    return x.agg(((F.sum((F.col("x") >= own).cast("int")) + 1) / (F.count("*") + num(1))).alias("p"), F.count("*").alias("n"))


@query("rep:i asset auc:f")
def refit_boot(t):
    """The whole procedure in each replicate: blocks of days are drawn, the model is fitted anew."""
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), "change", "y")
    n = _length(d)
    draws = R.drawn_slots(R.block_starts(t.spark, n, 60, 200, seed=9), n, 60)
    draws = draws.withColumn("at", F.row_number().over(W.partitionBy("b").orderBy(F.monotonically_increasing_id())) - 1)
    rows = d.join(draws, "pos").select(F.concat_ws("/", F.col("b").cast("string"), "asset").alias("asset"), F.col("at").cast("int").alias("pos"), "change", "y")
    out = D.walk_forward(rows, D.KernelLogit(), 720, 120)
    a = M.auc(out, ["asset"])
    return a.select(F.split("asset", "/")[0].cast("int").alias("rep"), F.split("asset", "/")[1].alias("asset"), "auc")


@query("kind asset n:i sd:f")
def surrogates(t):
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), "change")
    parts = [R.surrogates(d, k).withColumn("kind", F.lit(k)) for k in ("shuffle", "signs", "reverse", "iaaft")]
    return J.union_all(parts).groupBy("kind", "asset").agg(F.count("*").alias("n"), F.stddev_pop("change").alias("sd"))


@query("asset n:i auc:f")
def null_walk_forward(t):
    """Shuffled series through the whole procedure: AUC near one half."""
    d = R.surrogates(days(t).select("asset", F.col("pos").cast("int").alias("pos"), "change"), "shuffle")
    d = d.withColumn("y", (F.col("change") > 0).cast("int"))
    return M.auc(D.walk_forward(d, D.KernelLogit(), 720, 120), ["asset"])


# Trading.


@query("asset n_bets:i total:f max_drawdown:f sharpe:f", "SELECT asset, count(CASE WHEN abs(p - 0.5) >= 0.02 THEN 1 END) AS n_bets, sum(pnl) AS total, max(drawdown) AS max_drawdown, CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END AS sharpe FROM eq GROUP BY 1", _EQ)
def even_money_pnl(t):
    return X.even_money_summary(scored(t), 0.02)


@query("asset tau:f n_bets:i pnl:f", f"SELECT asset, arg_min(tau, o) AS tau, arg_min(b2, o) AS n_bets, arg_min(p2, o) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(p1 / b1, 9) DESC, tau) AS o FROM (SELECT asset, tau, sum(CASE WHEN f THEN g ELSE 0 END) AS p1, sum(CASE WHEN f THEN b ELSE 0 END) AS b1, sum(CASE WHEN NOT f THEN g ELSE 0 END) AS p2, sum(CASE WHEN NOT f THEN b ELSE 0 END) AS b2 FROM (SELECT asset, tau, pos < floor(n / 2.0) AS f, CASE WHEN abs(p - 0.5) >= tau THEN 1 ELSE 0 END AS b, CASE WHEN abs(p - 0.5) >= tau THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE -1.0 END ELSE 0 END AS g FROM scored, (SELECT unnest({_TAUS}) AS tau) AS t_) AS x GROUP BY 1, 2) AS z WHERE b1 >= 20) AS w GROUP BY 1", SCORED)
def tau_select(t):
    return X.best_tau(scored(t), _TAUS)


_K = "SELECT asset, avg(st) AS stake, sum(CASE WHEN no THEN CASE WHEN y = 0 THEN st * bid / (1 - bid) ELSE -st END WHEN yes THEN CASE WHEN y = 1 THEN st * (1 - ask) / ask ELSE -st END ELSE 0 END) AS total{k} FROM (SELECT *, CASE WHEN no THEN least(greatest(0.25 * ((1 - p) - (1 - bid)) / bid, 0), 0.05) WHEN yes THEN least(greatest(0.25 * (p - ask) / (1 - ask), 0), 0.05) ELSE 0 END AS st FROM (SELECT *, p - ask > 0.01 AS yes, bid - p > 0.01 AS no FROM (SELECT *, 0.5 + {rho} * (ref - 0.5) + 0.01 AS ask, 0.5 + {rho} * (ref - 0.5) - 0.01 AS bid FROM (SELECT *, 0.5 + 0.0973 * (y - 0.5) AS ref FROM scored) AS k0_) AS k1_) AS k2_) AS k3_ GROUP BY asset"


def _kelly(t, rho):
    s = scored(t).withColumn("ref", num(0.5) + num(0.0973) * (F.col("y") - num(0.5)))
    return X.kelly(s, rho).groupBy("asset").agg(F.avg("stake").alias("stake"), F.sum("ret").alias("total"))


@query("asset stake:f total:f", _K.format(rho=0.5, k=""), SCORED)
def kelly_vs_market(t):
    return _kelly(t, 0.5)


@query("rho:f asset stake:f total:f", " UNION ALL ".join(f"SELECT CAST({r} AS DOUBLE) AS rho, * FROM ({_K.format(rho=r, k='')}) AS s{i}_" for i, r in enumerate((0.0, 0.5, 1.0))), SCORED)
def rho_sweep(t):
    return J.union_all([_kelly(t, r).withColumn("rho", num(r)) for r in (0.0, 0.5, 1.0)])


@query("asset n:i up:f rho1:f")
def glauber_sim(t):
    g = R.glauber(t.spark, [("flat", 0.0, -0.1, 0.0), ("steep", 2.0, -0.5, 0.0), ("none", 1.0, 0.0, 0.0)], 2000)
    rho = S.autocorrelation(g.withColumnRenamed("pos", "slot"), "change", 1)
    return g.groupBy("asset").agg(F.count("*").alias("n"), F.avg((F.col("change") > 0).cast("double")).alias("up")).join(rho.select("asset", F.col("rho").alias("rho1")), "asset")
