"""Composite studies: compositions of the primitives, one for each kind of question."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions import scalar as C
from tidebars.functions.scalar import num
from tidebars.operators import bars as B
from tidebars.operators import inference as I
from tidebars.operators import joins as J
from tidebars.operators import metrics as M
from tidebars.operators import models as D
from tidebars.operators import resampling as R
from tidebars.operators import series as S
from tidebars.plans.analysis_queries import _CUT5, FLIPS, _length, auc_sql, flips
from tidebars.plans.catalog import query
from tidebars.plans.inputs import DAYS, H, SCORED, bars, days, field_sql, scored


@query("asset pos:i fold:i y:i p:f")
def wf_l1_ar(t):
    return D.walk_forward(days(t), D.LassoLogit(), 720, 120)


@query("asset pos:i fold:i y:i p:f")
def wf_gbm(t):
    return D.walk_forward(days(t), D.Trees(), 720, 120)


@query("asset pos:i fold:i y:i p:f")
def wf_gbm_tuned(t):
    return D.walk_forward(days(t), D.Trees(choose=D.TREES), 720, 120)


@query("asset pos:i fold:i y:i p:f")
def wf_mlp(t):
    return D.walk_forward(days(t), D.Network(), 720, 120)


@query("asset pos:i fold:i y:i p:f")
def wf_mlp_tuned(t):
    return D.walk_forward(days(t), D.Network(choose=D.NETWORKS), 720, 120)


@query("asset n:i auc:f")
def gap_walk_forward(t):
    """Features one bar older: an AUC that bounces between neighbouring prices goes away."""
    d = days(t)
    moved = d.withColumn("change", F.coalesce(F.lag("change").over(S.along(order="pos")), num(0)))
    return M.auc(D.walk_forward(moved, D.KernelLogit(), 720, 120), ["asset"])


@query("asset n:i auc:f")
def horizon_walk_forward(t):
    """Compounded to coarser bars, then the same procedure."""
    h = B.compound(bars(t), 4).withColumn("y", (F.col("change") > 0).cast("int"))
    return M.auc(D.walk_forward(S.positioned(h), D.KernelLogit(), 100, 20), ["asset"])


@query("asset year:i n:i auc:f")
def year_auc(t):
    out = D.markov(days(t), 720, 120, 2).join(days(t).select("asset", "pos", "slot"), ["asset", "pos"])
    return M.auc(out.withColumn("year", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot").cast("int")))), ["asset", "year"])


@query("asset quarter r:f", f"SELECT asset, quarter, coalesce(nullif(corr(s, f), CAST('NaN' AS DOUBLE)), 0) AS r FROM (SELECT asset, pos, CAST(extract(year FROM d) AS VARCHAR) || 'Q' || CAST(extract(quarter FROM d) AS VARCHAR) AS quarter, s, {field_sql('s')} AS f FROM (SELECT asset, slot, pos, DATE '1970-01-01' + CAST(slot AS INTEGER) AS d, CAST(sign(change) AS DOUBLE) AS s FROM days) AS x) AS y WHERE pos >= 12 GROUP BY 1, 2", DAYS)
def quarter_stability(t):
    """The kernel correlation quarter by quarter; fields look back over the quarter's start."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot").cast("int"))
    d = days(t).withColumn("quarter", F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))).withColumn("s", F.signum("change"))
    d = d.withColumn("f", S.kernel_field(F.col("s"), S.power_law(12, 1.0), S.along())).where("pos >= 12")
    return d.groupBy("asset", "quarter").agg(F.coalesce(C.corr("s", "f"), num(0)).alias("r"))


@query("grp bin:i rate:f n:i", f"SELECT 'pooled' AS grp, bin, sum(n * rate) / sum(n) AS rate, sum(n) AS n FROM (SELECT asset, bin, count(*) AS n, avg(flip) AS rate FROM (SELECT asset, flip, len(list_filter(e, lambda q: imb >= q)) AS bin FROM flips, (SELECT quantile_cont(imb, {_CUT5}) AS e FROM flips) AS x) AS y GROUP BY 1, 2) AS z GROUP BY 2", FLIPS)
def weighted_dose(t):
    each = J.digitize(flips(t), "imb", [0.2, 0.4, 0.6, 0.8]).groupBy("asset", "bin").agg(F.count("*").alias("n"), F.avg("flip").alias("rate"))
    return each.groupBy("bin").agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("rate"), F.sum("n").alias("n")).withColumn("grp", F.lit("pooled"))


@query("delta:f cells:i", f"SELECT sum(n * (ma - mb)) / sum(n) AS delta, count(*) AS cells FROM (SELECT bin, count(*) AS n, avg(CASE WHEN imb > 0 THEN flip END) AS ma, avg(CASE WHEN imb <= 0 THEN flip END) AS mb FROM (SELECT imb, flip, len(list_filter(e, lambda q: abs(change) >= q)) AS bin FROM flips, (SELECT quantile_cont(abs(change), {_CUT5}) AS e FROM flips) AS x) AS y GROUP BY 1) AS z WHERE ma IS NOT NULL AND mb IS NOT NULL", FLIPS)
def size_matched_delta(t):
    f = J.digitize(flips(t).withColumn("v", F.abs("change")), "v", [0.2, 0.4, 0.6, 0.8])
    on = F.col("imb") > 0
    cells = f.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.when(on, F.col("flip"))).alias("ma"), F.avg(F.when(~on, F.col("flip"))).alias("mb")).where("ma is not null and mb is not null")
    return cells.agg((F.sum(F.col("n") * (F.col("ma") - F.col("mb"))) / F.sum("n")).alias("delta"), F.count("*").alias("cells"))


_POOL = f"{DAYS}, draws AS (SELECT b, a AS asset, (b * 7919 + k * 104729 + r * 31) % greatest(1, n - 49) + i AS pos FROM range(50) q(b), range(400) s(k), range(50) u(i), (SELECT asset AS a, n, row_number() OVER (ORDER BY asset) - 1 AS r FROM (SELECT DISTINCT asset, n FROM days) AS a0) AS a1 WHERE k * 50 + i < n)"


@query("lo:f hi:f", "SELECT quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM (SELECT b, avg(CAST(y AS DOUBLE)) AS x FROM draws JOIN days ON draws.asset = days.asset AND draws.pos = days.pos GROUP BY 1) AS z", _POOL)
def pooled_boot(t):
    """Blocks are drawn for each series by itself, the statistic is that of the union."""
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), F.col("n").cast("int").alias("n"), "y")
    rank = F.row_number().over(W.orderBy("asset")) - 1  # one row for each series
    names = d.select("asset", "n").distinct().withColumn("r", rank)
    grid = names.crossJoin(F.broadcast(t.spark.range(50).withColumnRenamed("id", "b")))
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 50).cast("int") - 1)))
    grid = grid.withColumn("start", (F.col("b") * 7919 + F.col("k") * 104729 + F.col("r") * 31) % F.greatest(F.lit(1), F.col("n") - 49))
    draws = grid.select("asset", "n", "b", "k", F.posexplode(F.sequence(F.col("start"), F.col("start") + 49)).alias("i", "pos"))
    draws = draws.where(F.col("k") * 50 + F.col("i") < F.col("n")).select("asset", "b", F.col("pos").cast("int").alias("pos"))
    d = d.drop("n")
    w = draws.groupBy("asset", "b", "pos").agg(F.count("*").alias("w"))
    x = d.join(w, ["asset", "pos"]).groupBy("b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("x"))
    return x.agg(F.percentile("x", F.array(num(0.025), num(0.975))).alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


@query("rep:i asset auc:f")
def refit_joint(t):
    """Blocks start at fractions of each series that all series share; each replicate is fitted anew."""
    d = days(t).select("asset", "pos", "n", "change", "y")
    grid = d.select("asset", "n").distinct().crossJoin(F.broadcast(t.spark.range(150).select(F.col("id").cast("int").alias("b"))))
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 60).cast("int") - 1)))
    fraction = (F.col("b") * 7919 + F.col("k") * 104729) % 997 / num(997)
    grid = grid.withColumn("start", F.floor(fraction * F.greatest(F.col("n") - 60, F.lit(0))))
    grid = grid.select("asset", "n", "b", "k", F.posexplode(F.sequence(F.col("start"), F.col("start") + 59)).alias("i", "pos"))
    grid = grid.where(F.col("k") * 60 + F.col("i") < F.col("n")).drop("n")
    rows = grid.join(d.drop("n"), ["asset", "pos"]).select(F.concat_ws("/", F.col("b").cast("string"), "asset").alias("asset"), (F.col("k") * 60 + F.col("i")).alias("pos"), "change", "y")
    a = M.auc(D.walk_forward(rows, D.KernelLogit(), 720, 120), ["asset"])
    return a.select(F.split("asset", "/")[0].cast("int").alias("rep"), F.split("asset", "/")[1].alias("asset"), "auc")


@query("asset sd:f power:f mde:f")
def power_mde(t):
    """Power against a gap of 0.02 and the smallest gap found with 99 % power, from the block bootstrap's spread."""
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), F.col("y").cast("double").alias("y"))
    n = _length(d)
    w = J.resampled(d, R.drawn_slots(R.block_starts(t.spark, n, 50, 100), n, 50), "pos")
    sd = w.groupBy("asset", "b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("x")).groupBy("asset").agg(F.stddev_samp("x").alias("sd"))
    z = NormalDist().inv_cdf
    return sd.withColumn("power", C.normal_cdf(num(0.02) / F.col("sd") - num(z(0.95)))).withColumn("mde", num(z(0.95) + z(0.99)) * F.col("sd"))


@query("k:i p:f", "SELECT n_nationkey AS k, 1 - x / sqrt(6 + x * x) * (1 + 0.5 * (6 / (6 + x * x)) + 0.375 * pow(6 / (6 + x * x), 2)) AS p FROM (SELECT n_nationkey, n_nationkey / 5.0 AS x FROM nation) AS y")
def student_t(t):
    return t.nation.select(F.col("n_nationkey").alias("k"), C.student_t_p(F.col("n_nationkey") / num(5), 6).alias("p"))


@query("p_name volume:f", "SELECT p_name, sum(l_extendedprice) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT LIKE '%BRASS' AND p_size > 5 GROUP BY p_partkey, p_name ORDER BY round(sum(l_extendedprice), 4) DESC, p_name LIMIT 50")
def ticker_ranking(t):
    """Ranking of what is left after suffix and exclusion rules by traded volume."""
    part = t.part.where("p_type not like '%BRASS' and p_size > 5").select("p_partkey", "p_name")
    v = t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_name").agg(F.sum("l_extendedprice").alias("volume"))
    return v.orderBy(F.round("volume", 4).desc(), "p_name").limit(50)


@query("asset n:i mean:f se:f", "SELECT asset, count(*) AS n, avg(change) AS mean, stddev_pop(change) / sqrt(count(*)) AS se FROM bars GROUP BY 1", H)
def horizon_decay(t):
    return bars(t).groupBy("asset").agg(F.count("*").alias("n"), F.avg("change").alias("mean"), (F.stddev_pop("change") / F.sqrt(F.count("*").cast("double"))).alias("se"))


_CUT10 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


@query("bin:i n:i mean_p:f mean_y:f se:f", f"SELECT bin, n, mp AS mean_p, my AS mean_y, sqrt(my * (1 - my) / n) AS se FROM (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM (SELECT p, y, len(list_filter(e, lambda q: p >= q)) AS bin FROM scored, (SELECT quantile_cont(p, {_CUT10}) AS e, max(p) AS top FROM scored) AS x WHERE p < top) AS z GROUP BY 1 HAVING count(*) > 30) AS w", SCORED)
def calibration_quantiles(t):
    """Quantile bins that are open on the right, so the largest score is in none."""
    s = scored(t)
    s = J.digitize(s, "p", [i / 10 for i in range(1, 10)]).crossJoin(F.broadcast(s.agg(F.max("p").alias("top")))).where("p < top")
    b = s.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y")).where("n > 30")
    return b.withColumn("se", F.sqrt(F.col("mean_y") * (num(1) - F.col("mean_y")) / F.col("n")))


@query("asset n:i auc:f", auc_sql("(SELECT * FROM scored WHERE change <> 0) AS z"), SCORED)
def nonflat_auc(t):
    return M.auc(scored(t).where("change <> 0"), ["asset"])


@query("composition:f decay:f total:f", "SELECT w1 - w0 AS composition, c1 - w1 AS decay, c1 - w0 AS total FROM (SELECT avg(CASE WHEN slot < 473200 THEN flip END) AS w0, avg(CASE WHEN slot < 473200 AND asset IN ('click', 'view', 'purchase') THEN flip END) AS w1, avg(CASE WHEN slot >= 473200 AND asset IN ('click', 'view', 'purchase') THEN flip END) AS c1 FROM flips) AS x", FLIPS)
def attenuation(t):
    """How a statistic's change splits into another set of series and the same series later."""
    early, known = F.col("slot") < 473200, F.col("asset").isin("click", "view", "purchase")
    part = lambda c: F.avg(F.when(c, F.col("flip")))
    s = flips(t).agg(part(early).alias("w0"), part(early & known).alias("w1"), part(~early & known).alias("c1"))
    return s.select((F.col("w1") - F.col("w0")).alias("composition"), (F.col("c1") - F.col("w1")).alias("decay"), (F.col("c1") - F.col("w0")).alias("total"))


@query("asset p:f rank:i rejected")
def fdr_study(t):
    """Scores, joint bootstrap, p-values, conjunction of two of them, and the step-up rule over all series."""
    from tidebars.plans.analysis_queries import _on_grid, _starts

    s, n = _on_grid(t)
    pv = lambda seed, name: R.interval(R.joint_auc_bootstrap(s, _starts(n, 24, 100, seed), n, 24).withColumn("x", F.col("auc") - num(0.5)), ["asset"], "x").select("asset", F.col("p").alias(name))
    both = pv(1, "p1").join(pv(2, "p2"), "asset")
    return I.benjamini_hochberg(I.conjunction(both, "p1", "p2", 100), "p", "asset")
