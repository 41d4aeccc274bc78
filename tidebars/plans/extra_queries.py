"""Transforms, joins and statistics that complete the studies: sessions, universes, matched rows, robustness and rosters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import corr, log_loss, num
from tidebars.operators import inference as I
from tidebars.operators import joins as J
from tidebars.operators import metrics as M
from tidebars.operators import models as D
from tidebars.operators import resampling as R
from tidebars.operators import series as S
from tidebars.plans.analysis_queries import _BOOT, FLIPS, _length, _markov_ctes, flips
from tidebars.plans.catalog import query
from tidebars.plans.inputs import DAYS, H, SCORED, bars, days, scored

#: Contract sizes of the series that are quoted in contracts.
CONTRACTS = {"click": 100.0, "error": 10.0}


@query("asset slot:i usd:f", "SELECT asset, slot, CASE WHEN asset = 'click' THEN ntr * 100.0 WHEN asset = 'error' THEN ntr * 10.0 ELSE vol * close END AS usd FROM bars", H)
def dollar_volume(t):
    """Contracts times their size, or volume times price where nothing is quoted in contracts."""
    sizes = t.spark.createDataFrame(list(CONTRACTS.items()), "asset string, size double")
    b = bars(t).join(F.broadcast(sizes), "asset", "left")  # one row a quoted series
    return b.withColumn("usd", F.when(F.col("size").isNotNull(), F.col("ntr") * F.col("size")).otherwise(F.col("vol") * F.col("close")))


@query("c_custkey:i l:f d:f", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS l, CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END AS d FROM customer")
def log_transforms(t):
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", F.ln(x).alias("l"), F.log10(x).alias("d"))


@query("o_orderkey:i day:i", "SELECT o_orderkey, CAST(epoch(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')) AS BIGINT) AS day FROM orders")
def date_parse(t):
    """Seconds of a day that is written as text."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd")).alias("day"))


@query("asset slot:i used:f swept:f", "SELECT asset, slot, CASE WHEN f > 0 AND l > 0 THEN ln(f / l) END AS used, CASE WHEN f > 0 AND lo > 0 THEN ln(f / lo) END AS swept FROM (SELECT event_type AS asset, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, arg_min(value, ts) AS f, arg_max(value, ts) AS l, min(value) AS lo FROM events GROUP BY 1, 2) AS x")
def sweep_consumption(t):
    """How much of the depth at the start is gone at the end, and at the lowest."""
    e = t.events.groupBy(F.col("event_type").alias("asset"), F.floor(F.unix_timestamp("ts") / 3600).alias("slot")).agg(F.min_by("value", "ts").alias("f"), F.max_by("value", "ts").alias("l"), F.min("value").alias("lo"))
    gone = lambda c: F.when((F.col("f") > 0) & (F.col(c) > 0), F.ln(F.col("f") / F.col(c)))
    return e.select("asset", "slot", gone("l").alias("used"), gone("lo").alias("swept"))


@query("asset second:i value:f", "SELECT event_type AS asset, CAST(floor(epoch(ts)) AS BIGINT) AS second, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_tick(t):
    """The last tick of each second, by its place in the files."""
    return t.events.groupBy(F.col("event_type").alias("asset"), F.unix_timestamp("ts").alias("second")).agg(F.max_by("value", "event_id").alias("value"))


@query("day n:i v:f", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1")
def day_cache_merge(t):
    """Each day is a part of its own: parts come together by name, a day without rows adds none."""
    parts = [t.events.where(F.col("event_type") == e) for e in ("click", "purchase", "signup", "view")]
    both = J.union_all([p.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value") for p in parts])
    return both.groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query("p_brand path", "SELECT p_brand, max(p_name) AS path FROM part GROUP BY 1")
def last_file(t):
    """The last of the sorted paths of each series."""
    return t.part.groupBy("p_brand").agg(F.max("p_name").alias("path"))


@query("quarter", "SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS VARCHAR) || 'Q' || CAST(extract(quarter FROM o_orderdate) AS VARCHAR) AS quarter FROM orders ORDER BY 1")
def sorted_distinct(t):
    return t.orders.select(F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter")).distinct().orderBy("quarter")


@query("grp:i n:i lo:f hi:f", "SELECT grp, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM (SELECT c_acctbal, 1 + len(list_filter([1, 2, 3, 4], lambda k: r >= floor(n * k / 5))) AS grp FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) AS x) AS y GROUP BY 1")
def spaced_groups(t):
    """Groups cut at evenly spaced places of the sorted list."""
    return J.spaced(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 5, "c_custkey").groupBy("grp").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("asset slot:i", "SELECT asset, slot FROM bars WHERE (slot // 24) % 7 <> 2 AND slot % 24 >= 14 AND slot % 24 < CASE WHEN (slot // 24) % 7 = 5 THEN 18 ELSE 21 END", H)
def half_days(t):
    """Sessions from a calendar of closing hours: days that close early, and days without a session."""
    week = t.spark.createDataFrame([(d, 18 if d == 5 else 21) for d in range(7) if d != 2], "weekday long, closes int")
    b = bars(t).withColumn("hour", F.col("slot") % 24).withColumn("weekday", F.floor(F.col("slot") / 24) % 7)
    return b.join(F.broadcast(week), "weekday").where((F.col("hour") >= 14) & (F.col("hour") < F.col("closes")))  # at most one row a day of the calendar


_LIQUID = "liquid AS (SELECT c_custkey, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < DATE '1998-04-01' GROUP BY 1), grouped AS (SELECT c_custkey, v, row_number() OVER (ORDER BY v, c_custkey) - 1 AS r, count(*) OVER () AS n FROM liquid), five AS (SELECT c_custkey, 1 + len(list_filter([1, 2, 3, 4], lambda k: r >= floor(n * k / 5))) AS grp FROM grouped)"


@query("grp:i n:i price:f", "SELECT grp, count(*) AS n, avg(o_totalprice) AS price FROM orders JOIN five ON o_custkey = c_custkey WHERE o_orderdate >= DATE '1998-04-01' GROUP BY 1", _LIQUID)
def exante_quintiles(t):
    """Groups by volume in the past, studied in the time after: nothing of what is studied decides who is in."""
    early = t.orders.where("o_orderdate < '1998-04-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v"))
    five = J.spaced(early, "v", 5, "c_custkey").select("c_custkey", "grp")
    later = t.orders.where("o_orderdate >= '1998-04-01'")
    return later.join(five, F.col("o_custkey") == F.col("c_custkey")).groupBy("grp").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))


@query("experiment:i asset change:f base:f", f"SELECT w.slot AS experiment, w.asset, w.change, u.change AS base FROM bars w JOIN (SELECT slot, arg_min(change, asset) AS change FROM bars WHERE asset IN ('click', 'error') GROUP BY 1) AS u ON w.slot = u.slot WHERE w.asset NOT IN ('click', 'error')", H)
def wrapper_underlying(t):
    """Each wrapper with the underlying of its experiment; the first where there are several."""
    b = bars(t)
    under = F.col("asset").isin("click", "error")
    first = b.where(under).groupBy("slot").agg(F.min_by("change", "asset").alias("base"))
    return b.where(~under).join(first, "slot").select(F.col("slot").alias("experiment"), "asset", "change", "base")


@query("asset control real:f fake:f", "SELECT l.asset, l.control, real, fake FROM (SELECT asset, CASE WHEN slot % 2 = 0 THEN 'even' ELSE 'odd' END AS control, avg(change) AS real FROM bars GROUP BY 1, 2) AS l JOIN (SELECT asset, CASE WHEN slot % 2 = 0 THEN 'even' ELSE 'odd' END AS control, avg(CASE WHEN slot % 3 = 0 THEN -change ELSE change END) AS fake FROM bars GROUP BY 1, 2) AS r ON l.asset = r.asset AND l.control = r.control", H)
def real_surrogate(t):
    """A statistic of the data beside that of a surrogate, for each series and control."""
    b = bars(t).withColumn("control", F.when(F.col("slot") % 2 == 0, "even").otherwise("odd"))
    fake = b.withColumn("change", F.when(F.col("slot") % 3 == 0, -F.col("change")).otherwise(F.col("change")))
    return b.groupBy("asset", "control").agg(F.avg("change").alias("real")).join(fake.groupBy("asset", "control").agg(F.avg("change").alias("fake")), ["asset", "control"])


_LL = "-(y * ln({0}) + (1 - y) * ln(1 - {0}))"


@query("asset n:i skill:f", f"SELECT w.asset, count(*) AS n, 1000 * avg({_LL.format('pb')} - ({_LL.format('w.p')})) AS skill FROM (SELECT w.*, b.pb FROM wf w JOIN base b ON w.asset = b.asset AND w.fold = b.fold) AS w GROUP BY 1", _markov_ctes(1))
def pairwise_loss(t):
    """Log-loss of the base rate less that of the chain, in thousandths: paired by row."""
    d = days(t)
    base = D.base_rate(d, 720, 120).select("asset", "pos", F.col("p").alias("pb"))
    both = D.markov(d, 720, 120, 1).join(base, ["asset", "pos"])
    y = F.col("y").cast("double")
    return both.groupBy("asset").agg(F.count("*").alias("n"), (num(1000) * F.avg(log_loss(y, F.col("pb")) - log_loss(y, F.col("p")))).alias("skill"))


_SIDE = "CASE WHEN p > 0.5 THEN 1 ELSE -1 END"


@query("asset tau:f coverage:f accuracy:f nonzero:f edge:f", f"SELECT asset, tau, avg(CASE WHEN abs(p - 0.5) >= tau THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN abs(p - 0.5) >= tau THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END END) AS accuracy, avg(CASE WHEN abs(p - 0.5) >= tau AND change <> 0 THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END END) AS nonzero, 10000 * avg(CASE WHEN abs(p - 0.5) >= tau THEN {_SIDE} * change END) AS edge FROM scored, (SELECT unnest([0.0, 0.05, 0.1, 0.15]) AS tau) AS g GROUP BY 1, 2 HAVING count(CASE WHEN abs(p - 0.5) >= tau THEN 1 END) >= 50", SCORED)
def selective_nonzero(t):
    """At each threshold: coverage, accuracy, accuracy on bars that moved, and the move in basis points on the side of the score."""
    s = scored(t).withColumn("tau", F.explode(F.array(*map(num, (0.0, 0.05, 0.1, 0.15)))))
    on, right = F.abs(F.col("p") - num(0.5)) >= F.col("tau"), ((F.col("p") > 0.5) == (F.col("y") == 1)).cast("double")
    side = F.when(F.col("p") > 0.5, num(1)).otherwise(num(-1)) * F.col("change")
    out = s.groupBy("asset", "tau").agg(F.avg(on.cast("double")).alias("coverage"), F.avg(F.when(on, right)).alias("accuracy"), F.avg(F.when(on & (F.col("change") != 0), right)).alias("nonzero"), (num(10000) * F.avg(F.when(on, side))).alias("edge"), F.count(F.when(on, 1)).alias("k"))
    return out.where("k >= 50")


@query("left_out r:f", "SELECT a.asset AS left_out, corr(b.m, b.sd) AS r FROM st a JOIN st b ON a.asset <> b.asset GROUP BY 1", f"{H}, st AS (SELECT asset, avg(vol) AS m, stddev_pop(change) AS sd FROM bars GROUP BY 1)")
def leave_one_out(t):
    """The correlation across series without each of them: totals less its own part."""
    st = bars(t).groupBy("asset").agg(F.avg("vol").alias("x"), F.stddev_pop("change").alias("y"))
    mid = st.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row; keeps the sums' precision
    st = st.crossJoin(F.broadcast(mid)).select("asset", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    parts = {"n": num(1), "sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "syy": F.col("y") * F.col("y"), "sxy": F.col("x") * F.col("y")}
    both = st.crossJoin(F.broadcast(st.agg(*(F.sum(e).alias(k) for k, e in parts.items()))))
    c = {k: F.col(k) - e for k, e in parts.items()}
    cov = c["sxy"] - c["sx"] * c["sy"] / c["n"]
    return both.select(F.col("asset").alias("left_out"), (cov / F.sqrt((c["sxx"] - c["sx"] * c["sx"] / c["n"]) * (c["syy"] - c["sy"] * c["sy"] / c["n"]))).alias("r"))


@query("stat:f n:i", "SELECT corr(m, f) AS stat, count(*) AS n FROM (SELECT asset, avg(abs(change)) AS m, avg(flip) AS f FROM flips GROUP BY 1) AS x", FLIPS)
def cross_correlation(t):
    """Pearson correlation of two statistics across series."""
    s = flips(t).groupBy("asset").agg(F.avg(F.abs("change")).alias("m"), F.avg("flip").alias("f"))
    return s.agg(corr("m", "f").alias("stat"), F.count("*").alias("n"))


_ROBUST = f"{FLIPS}, marked AS (SELECT *, CAST(floor(slot / 24) AS BIGINT) AS day, lag(imb) OVER (PARTITION BY asset ORDER BY slot) AS imb0 FROM flips), heavy AS (SELECT asset, arg_max(day, k * 100000 + day) AS top FROM (SELECT asset, day, count(*) AS k FROM marked GROUP BY 1, 2) AS x GROUP BY 1)"


@query("asset effect:f placebo:f big:f trimmed:f", "SELECT m.asset, avg(CASE WHEN imb > 0 THEN flip END) - avg(CASE WHEN imb <= 0 THEN flip END) AS effect, avg(CASE WHEN imb0 > 0 THEN flip END) - avg(CASE WHEN imb0 <= 0 THEN flip END) AS placebo, avg(CASE WHEN abs(imb) >= 0.2 AND imb > 0 THEN flip END) - avg(CASE WHEN abs(imb) >= 0.2 AND imb <= 0 THEN flip END) AS big, avg(CASE WHEN day <> top AND imb > 0 THEN flip END) - avg(CASE WHEN day <> top AND imb <= 0 THEN flip END) AS trimmed FROM marked m JOIN heavy h ON m.asset = h.asset GROUP BY 1", _ROBUST)
def placebo_trim(t):
    """An effect, the same of the bar before, of large values only, and without the busiest day."""
    m = flips(t).withColumn("day", F.floor(F.col("slot") / 24)).withColumn("imb0", F.lag("imb").over(S.along()))
    heavy = m.groupBy("asset", "day").agg(F.count("*").alias("k")).groupBy("asset").agg(F.max_by("day", F.struct("k", "day")).alias("top"))
    gap = lambda c, on: F.avg(F.when(on & (F.col(c) > 0), F.col("flip"))) - F.avg(F.when(on & (F.col(c) <= 0), F.col("flip")))
    every = F.lit(True)
    return m.join(heavy, "asset").groupBy("asset").agg(gap("imb", every).alias("effect"), gap("imb0", every).alias("placebo"), gap("imb", F.abs("imb") >= 0.2).alias("big"), gap("imb", F.col("day") != F.col("top")).alias("trimmed"))


_PNL = f"{SCORED}, pnl AS (SELECT asset, slot, {_SIDE} * change AS r FROM scored), eq AS (SELECT *, sum(r) OVER (PARTITION BY asset ORDER BY slot) AS e FROM pnl), dd AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY asset ORDER BY slot)) - e AS d FROM eq)"


@query("asset annual:f sharpe:f calmar:f factor:f bp:f", "SELECT asset, avg(r) * 8760 AS annual, avg(r) / stddev_pop(r) * sqrt(8760) AS sharpe, avg(r) * 8760 / nullif(max(d), 0) AS calmar, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 0) AS factor, 10000 * avg(r) AS bp FROM dd GROUP BY 1", _PNL)
def annualised(t):
    """Yearly return and Sharpe ratio of hourly bets, return by drawdown, gains by losses, expectancy in basis points."""
    side = F.when(F.col("p") > 0.5, num(1)).otherwise(num(-1))
    e = S.equity(scored(t).withColumn("r", side * F.col("change")), "r", S.along())
    part = lambda sign: F.sum(F.greatest(num(sign) * F.col("r"), num(0)))
    g = e.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"), F.max("drawdown").alias("d"), part(1).alias("up"), part(-1).alias("down"))
    year = num(8760)
    return g.select("asset", (F.col("m") * year).alias("annual"), F.try_divide(F.col("m") * F.sqrt(year), F.col("sd")).alias("sharpe"), F.try_divide(F.col("m") * year, F.col("d")).alias("calmar"), F.try_divide("up", "down").alias("factor"), (F.col("m") * 10000).alias("bp"))


@query("pair gap:f p:f", "SELECT 'HIGH-LOW' AS pair, max(CASE WHEN b < 0 THEN g END) AS gap, least(1, 2 * least(avg(CASE WHEN b >= 0 THEN CASE WHEN g <= 0 THEN 1.0 ELSE 0.0 END END), avg(CASE WHEN b >= 0 THEN CASE WHEN g >= 0 THEN 1.0 ELSE 0.0 END END))) AS p FROM (SELECT b, max(CASE WHEN asset = '2-HIGH' THEN x END) - max(CASE WHEN asset = '5-LOW' THEN x END) AS g FROM rep GROUP BY 1) AS z", _BOOT)
def paired_two_sided(t):
    """The gap of two series in the same replicates: twice the smaller tail."""
    d = days(t).where("asset in ('2-HIGH', '5-LOW')").select("asset", F.col("pos").cast("int").alias("pos"), F.col("y").cast("double").alias("y"))
    n = _length(days(t))
    w = J.resampled(d, R.drawn_slots(R.block_starts(t.spark, n, 50, 200), n, 50), "pos")
    rep = w.groupBy("asset", "b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("x")).unionByName(d.groupBy("asset").agg(F.avg("y").alias("x")).withColumn("b", F.lit(-1)).select("asset", "b", "x"))
    side = lambda a: F.max(F.when(F.col("asset") == a, F.col("x")))
    g = rep.groupBy("b").agg((side("2-HIGH") - side("5-LOW")).alias("g"))
    drawn, tail = F.col("b") >= 0, lambda c: F.avg(F.when(F.col("b") >= 0, c.cast("double")))
    out = g.agg(F.max(F.when(~drawn, F.col("g"))).alias("gap"), F.least(num(1), num(2) * F.least(tail(F.col("g") <= 0), tail(F.col("g") >= 0))).alias("p"))
    return out.withColumn("pair", F.lit("HIGH-LOW"))


_RULE = f"{DAYS}, sized AS (SELECT n, CAST(ceil(pow(n, 1 / 3.0)) AS BIGINT) AS k FROM (SELECT max(n) AS n FROM days) AS n_), draws AS (SELECT b, (b * 7919 + j * 104729) % greatest(1, n - k + 1) + i AS pos FROM sized, range(100) r(b), range(2000) s(j), range(60) u(i) WHERE i < k AND j * k + i < n), moments AS (SELECT b, asset, avg(change) AS m, avg(change * change) AS q FROM draws JOIN days ON draws.pos = days.pos GROUP BY 1, 2)"


@query("asset mean_lo:f mean_hi:f sd_lo:f sd_hi:f", "SELECT asset, quantile_cont(m, 0.025) AS mean_lo, quantile_cont(m, 0.975) AS mean_hi, quantile_cont(sqrt(greatest(q - m * m, 0)), 0.025) AS sd_lo, quantile_cont(sqrt(greatest(q - m * m, 0)), 0.975) AS sd_hi FROM moments GROUP BY 1", _RULE)
def rule_length_boot(t):
    """Intervals of the mean and the spread by blocks whose length follows from the data: the cube root of the number of slots."""
    d = days(t).select("asset", F.col("pos").cast("int").alias("pos"), "change")
    n = _length(d)
    block = next(k for k in range(1, n + 2) if k**3 >= n)
    w = J.resampled(d, R.drawn_slots(R.block_starts(t.spark, n, block, 100), n, block), "pos")
    m = w.groupBy("asset", "b").agg((F.sum(F.col("w") * F.col("change")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("change") * F.col("change")) / F.sum("w")).alias("q"))
    m = m.withColumn("sd", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), num(0))))
    cuts = F.array(num(0.025), num(0.975))
    x = m.groupBy("asset").agg(F.percentile("m", cuts).alias("a"), F.percentile("sd", cuts).alias("c"))
    return x.select("asset", F.col("a")[0].alias("mean_lo"), F.col("a")[1].alias("mean_hi"), F.col("c")[0].alias("sd_lo"), F.col("c")[1].alias("sd_hi"))


@query("asset term b:f se:f")
def ols_many(t):
    """Several regressors with robust (HC1) errors: the next flip on imbalance, size of the move and logarithm of the volume."""
    f = flips(t).withColumn("size", F.abs("change")).withColumn("lv", F.ln("vol"))
    return I.ols_many(f, ["asset"], "flip", ["imb", "size", "lv"])


#: The default models, by the name under which their scores are reported.
ROSTER = {
    "kernel": D.KernelLogit(), "free": D.LagLogit(), "l1": D.LassoLogit(), "l2": D.LagLogit(choose=D.RIDGES),
}


def roster(t):
    """(model, asset, pos, fold, y, p, train_nll) of all default models on the daily bars; the relational ones have no train_nll."""
    d = days(t)
    parts = [D.walk_forward(d, m, 720, 120).select(F.lit(name).alias("model"), "asset", "pos", "fold", "y", "p", "train_nll") for name, m in ROSTER.items()]
    flat = [("markov1", D.markov(d, 720, 120, 1)), ("markov2", D.markov(d, 720, 120, 2)), ("base", D.base_rate(d, 720, 120))]
    return J.union_all(parts + [x.select(F.lit(name).alias("model"), "asset", "pos", "fold", "y", "p", F.lit(None).cast("double").alias("train_nll")) for name, x in flat])


@query("model asset n:i loss:f brier:f accuracy:f auc:f")
def run_roster(t):
    """The main study: every default model walked forward on every series, with its scores."""
    r = roster(t)
    y, p = F.col("y").cast("double"), F.col("p")
    s = r.groupBy("model", "asset").agg(F.count("*").alias("n"), F.avg(log_loss(y, p)).alias("loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(((p > 0.5) == (y == 1)).cast("double")).alias("accuracy"))
    return s.join(M.auc(r.drop("fold", "train_nll"), ["model", "asset"]).drop("n"), ["model", "asset"])


@query("model train:f test:f gap:f")
def overfit_gap(t):
    """Mean log-loss in training windows beside that out of sample, trees and networks included."""
    d = days(t)
    models = {k: ROSTER[k] for k in ("kernel", "free")} | {"gbm": D.Trees(), "mlp": D.Network()}
    r = J.union_all([D.walk_forward(d, m, 720, 120).select(F.lit(name).alias("model"), "asset", "fold", "y", "p", "train_nll") for name, m in models.items()])
    f = r.groupBy("model", "asset", "fold").agg(F.sum(log_loss(F.col("y").cast("double"), F.col("p"))).alias("l"), F.count("*").alias("n"), F.first("train_nll").alias("t"))
    g = f.groupBy("model").agg(F.avg("t").alias("train"), (F.sum("l") / F.sum("n")).alias("test"))
    return g.withColumn("gap", F.col("test") - F.col("train"))


@query("asset lag:i w:f")
def implied_by_lag(t):
    """The mean weight that the kernel gives to each of the twelve lags."""
    f = D.walk_forward(days(t), D.KernelLogit(), 720, 120).groupBy("asset", "fold").agg(F.first("a").alias("a"), F.first("kernel").alias("kernel"))
    each = f.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return each.groupBy("asset", "lag").agg(F.avg(F.col("a") * F.pow(F.col("lag").cast("double"), -F.col("kernel"))).alias("w"))
