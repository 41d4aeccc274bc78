"""Bars, filters, scalar functions, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions import scalar as S
from tidebars.functions.scalar import num
from tidebars.operators import bars as B
from tidebars.operators import joins as J
from tidebars.operators.series import along, positioned
from tidebars.plans.catalog import query
from tidebars.plans.inputs import DAYS, H, bars, bars_sql, days

OHLC = "asset slot:i open:f close:f vol:f ntr:i change:f up"


@query(OHLC, "SELECT * FROM bars", bars_sql(900))
def bars_15m(t):
    return bars(t, 900)


@query(OHLC, "SELECT * FROM bars", bars_sql(900, offset=450))
def bars_offset_grid(t):
    return bars(t, 900, 450)


@query("asset slot:i open:f close:f ntr:i change:f", "SELECT *, CASE WHEN open <> 0 THEN (close - open) / open ELSE 0 END AS change FROM (SELECT asset, CAST(floor(slot / 4.0) AS BIGINT) AS slot, arg_min(open, slot) AS open, arg_max(close, slot) AS close, sum(ntr) AS ntr FROM bars GROUP BY 1, 2) AS x", bars_sql(900))
def bars_1h_first_last(t):
    return B.resample(bars(t, 900), 4)


@query("asset slot:i change:f", "SELECT asset, CAST(floor(slot / 4.0) AS BIGINT) AS slot, product(1 + change) - 1 AS change FROM bars GROUP BY 1, 2", bars_sql(900))
def bars_compound_1h(t):
    return B.compound(bars(t, 900), 4)


@query("asset slot:i open:f close:f ntr:i", "SELECT * FROM (SELECT event_type AS asset, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, arg_min(value, ts) AS open, arg_max(value, ts) AS close, count(*) AS ntr, min(epoch(ts) - floor(epoch(ts) / 3600) * 3600) AS lo, max(epoch(ts) - floor(epoch(ts) / 3600) * 3600) AS hi FROM events GROUP BY 1, 2) AS x WHERE ntr >= 3 AND lo <= 900 AND hi >= 2700")
def bars_complete(t):
    return B.complete_bars(t.events, "event_type", "value", ["ts"], 3600, 3, 900)


@query("slot:i asset open:f", "SELECT slot, asset, open FROM (SELECT *, row_number() OVER (PARTITION BY asset, slot ORDER BY r DESC) AS k FROM (SELECT slot, asset, open, 0 AS r FROM bars UNION ALL SELECT slot, asset, close, 1 FROM bars WHERE slot % 3 = 0) AS u) AS x WHERE k = 1", H)
def bars_dedup_merge(t):
    b = bars(t)
    late = b.where("slot % 3 = 0").select("slot", "asset", F.col("close").alias("open"))
    return B.merge_sources([b.select("slot", "asset", "open"), late], ["asset", "slot"])


@query("slot:i sell_notional:f sell_n:i buy_notional:f buy_n:i", "SELECT slot, sum(CASE WHEN s THEN v ELSE 0 END) AS sell_notional, count(CASE WHEN s THEN 1 END) AS sell_n, sum(CASE WHEN NOT s THEN v ELSE 0 END) AS buy_notional, count(CASE WHEN NOT s THEN 1 END) AS buy_n FROM (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS slot, l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v, l_returnflag = 'R' AS s FROM lineitem) AS x GROUP BY 1")
def bars_side_sum(t):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = t.lineitem.select(day.alias("slot"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return B.forced_bars(rows, ["slot"], "l_returnflag", "R", F.col("l_quantity") * F.col("l_extendedprice"))


_LEVEL = "{f}(CASE WHEN event_type = '{e}' THEN {x} END) AS l{i}_{n}"
_SNAP = ", ".join(
    f"arg_min(CASE WHEN event_type = '{e}' THEN value END, CASE WHEN event_type = '{e}' THEN ts END) AS l{i}_first, arg_max(CASE WHEN event_type = '{e}' THEN value END, CASE WHEN event_type = '{e}' THEN ts END) AS l{i}_last, min(CASE WHEN event_type = '{e}' THEN value END) AS l{i}_min, avg(CASE WHEN event_type = '{e}' THEN value END) AS l{i}_mean"
    for i, e in enumerate(("click", "purchase"))
)


@query("slot:i n:i l0_first:f l0_last:f l0_min:f l0_mean:f l1_first:f l1_last:f l1_min:f l1_mean:f", f"SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS n, {_SNAP} FROM events GROUP BY 1")
def bars_snapshot(t):
    return B.snapshot_bars(t.events.withColumn("slot", S.slot(F.col("ts"), 3600)), ["slot"], "event_type", ["click", "purchase"], "value", ["ts"])


@query("asset slot:i ret:f", "SELECT asset, slot, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY slot) - 1, 0) AS ret FROM bars", H)
def ret_close_close(t):
    return B.close_to_close(bars(t))


@query("asset slot:i ret:f", "SELECT asset, slot, coalesce(w / lag(w) OVER (PARTITION BY asset ORDER BY slot) - 1, 0) AS ret FROM (SELECT *, CASE WHEN ntr > 1 THEN vol / ntr ELSE close END AS w FROM bars) AS x", H)
def ret_vwap(t):
    return B.vwap_returns(bars(t).withColumn("qvol", F.col("vol")).withColumn("vol", F.when(F.col("ntr") > 1, F.col("ntr")).otherwise(0)))


@query("slot:i open:f close:f spread:f", "SELECT b.slot, (b.open + a.open) / 2 AS open, (b.close + a.close) / 2 AS close, (a.close - b.close) / ((b.close + a.close) / 2) AS spread FROM bars b JOIN bars a ON b.slot = a.slot AND b.asset = 'click' AND a.asset = 'view' WHERE NOT (b.ntr = 1 AND a.ntr = 1)", H)
def mid_bars(t):
    b = bars(t).withColumn("high", F.when(F.col("ntr") > 1, num(1)).otherwise(num(0))).withColumn("low", num(0))
    return B.mid_bars(b.where("asset = 'click'"), b.where("asset = 'view'"))


@query("event_id:i minute:i", "SELECT event_id, minute FROM (SELECT event_id, extract(isodow FROM l) AS d, extract(hour FROM l) * 60 + extract(minute FROM l) AS minute FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events) AS y) AS x WHERE d < 6 AND minute >= 570 AND minute < 960")
def rth_filter(t):
    local = F.from_utc_timestamp(F.col("ts"), "America/New_York")  # the test month has no change of the clock
    rows = t.events.select("event_id", (F.hour(local) * 60 + F.minute(local)).alias("minute"), F.weekday(local).alias("d"))
    return rows.where("d < 5 and minute >= 570 and minute < 960")


@query("event_id:i", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def span_filter(t):
    return t.events.where("ts >= '2024-01-05' and ts < '2024-01-10'")


@query("asset slot:i change:f", "SELECT * FROM bars WHERE change <> 0", H)
def nonflat_filter(t):
    return bars(t).where("change <> 0")


@query("asset period n:i up_share:f", "SELECT asset, CASE WHEN slot < 473000 THEN 'pre' WHEN slot < 473200 THEN 'zero' ELSE 'post' END AS period, count(*) AS n, avg(CASE WHEN up THEN 1.0 ELSE 0.0 END) AS up_share FROM bars GROUP BY 1, 2", H)
def period_bucket(t):
    period = F.when(F.col("slot") < 473000, "pre").when(F.col("slot") < 473200, "zero").otherwise("post")
    return bars(t).groupBy("asset", period.alias("period")).agg(F.count("*").alias("n"), F.avg(F.col("up").cast("double")).alias("up_share"))


@query("quarter hour:i n:i", "SELECT CAST(extract(year FROM ts) AS VARCHAR) || 'Q' || CAST(extract(quarter FROM ts) AS VARCHAR) AS quarter, extract(hour FROM ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def year_quarter_hour(t):
    q = F.concat(F.year("ts").cast("string"), F.lit("Q"), F.quarter("ts").cast("string"))
    return t.events.groupBy(q.alias("quarter"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query("cls n:i", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS cls, count(*) AS n FROM events GROUP BY 1")
def class_assign(t):
    return t.events.groupBy(F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("cls")).agg(F.count("*").alias("n"))


@query("asset half:i n:i mean:f", "SELECT asset, CASE WHEN pos < floor(n / 2.0) THEN 0 ELSE 1 END AS half, count(*) AS n, avg(change) AS mean FROM days GROUP BY 1, 2", DAYS)
def split_half(t):
    return days(t).groupBy("asset", F.when(F.col("pos") < F.floor(F.col("n") / 2), 0).otherwise(1).alias("half")).agg(F.count("*").alias("n"), F.avg("change").alias("mean"))


@query("asset slot:i gapped:f", "SELECT asset, slot, coalesce(lag(change) OVER (PARTITION BY asset ORDER BY slot), 0) AS gapped FROM bars", H)
def one_bar_gap(t):
    return bars(t).withColumn("gapped", F.coalesce(F.lag("change").over(along()), num(0)))


@query("asset pos:i change:f up", "SELECT asset, n - 1 - pos AS pos, -change AS change, -change > 0 AS up FROM days", DAYS)
def time_reverse(t):
    return days(t).select("asset", (F.col("n") - 1 - F.col("pos")).alias("pos"), (-F.col("change")).alias("change"), (F.col("change") < 0).alias("up"))


@query("asset slot:i spin:f sign:i", "SELECT asset, slot, tanh(150 * change) AS spin, sign(change) AS sign FROM bars", H)
def spin_tanh(t):
    return bars(t).select("asset", "slot", S.spin(F.col("change")).alias("spin"), S.spin(F.col("change"), 0).alias("sign"))


@query("asset slot:i imb:f size:f", "SELECT asset, slot, CASE WHEN vol > 0 THEN 2 * tbv / vol - 1 END AS imb, vol / ntr AS size FROM bars", H)
def imbalance(t):
    return bars(t).select("asset", "slot", S.imbalance(F.col("tbv"), F.col("vol")).alias("imb"), S.ratio(F.col("vol"), F.col("ntr")).alias("size"))


@query("asset slot:i side:f aligned:f", "SELECT asset, slot, CASE WHEN change > 0 THEN vol WHEN change < 0 THEN tbv END AS side, CASE WHEN change > 0 THEN tbv WHEN change < 0 THEN vol - tbv ELSE 0 END AS aligned FROM bars", H)
def move_side(t):
    c = F.col
    return bars(t).select("asset", "slot", S.move_side(c("change"), c("vol"), c("tbv")).alias("side"), S.alignment(c("change"), c("tbv"), c("vol") - c("tbv")).alias("aligned"))


@query("asset slot:i used:f impact:f", "SELECT asset, slot, CASE WHEN open > 0 AND close > 0 THEN ln(open / close) END AS used, CASE WHEN vol > 0 THEN abs(change) / vol END AS impact FROM bars", H)
def log_consumption(t):
    return bars(t).select("asset", "slot", S.consumption(F.col("open"), F.col("close")).alias("used"), S.ratio(F.abs("change"), F.col("vol")).alias("impact"))


@query("slot:i basis:f", "SELECT a.slot, a.close / b.close - 1 AS basis FROM bars a LEFT JOIN bars b ON a.slot = b.slot AND b.asset = 'view' WHERE a.asset = 'click'", H)
def basis(t):
    b = bars(t)
    return b.where("asset = 'click'").select("slot", "close").join(b.where("asset = 'view'").select("slot", F.col("close").alias("spot")), "slot", "left").withColumn("basis", F.col("close") / F.col("spot") - 1)


@query("asset n:i block:i", "SELECT asset, count(*) AS n, greatest(64, round_even(384 * pow(count(*) / 33217.0, 1 / 3.0), 0)) AS block FROM days GROUP BY 1", DAYS)
def block_len_rule(t):
    return days(t).groupBy("asset").agg(F.count("*").cast("double").alias("n")).withColumn("block", S.block_length(F.col("n")))


@query("name norm n:i", "SELECT r_name AS name, replace(lower(r_name), '.', '-') AS norm, length(r_name) AS n FROM region")
def symbol_normalise(t):
    return t.region.select(F.col("r_name").alias("name"), S.symbol(F.col("r_name")).alias("norm"), F.length("r_name").alias("n"))


@query("k:i n:i", "SELECT CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_scalar(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("x:i p:f", "SELECT lag AS x, exp(-lag / 2.0) * (1 + lag / 2.0 + pow(lag / 2.0, 2) / 2 + pow(lag / 2.0, 3) / 6 + pow(lag / 2.0, 4) / 24 + pow(lag / 2.0, 5) / 120) AS p FROM (SELECT n_nationkey AS lag FROM nation) AS x")
def chi2_tail(t):
    return t.nation.select(F.col("n_nationkey").alias("x")).withColumn("p", S.chi2_survival(F.col("x").cast("double"), 12))


@query("segment n:i total:f", "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


_TWO = "SELECT a.slot, a.close, b.close AS other, coalesce(b.vol, 0) AS vol FROM bars a LEFT JOIN bars b ON a.slot = b.slot AND b.asset = 'error' WHERE a.asset = 'view'"


@query("slot:i close:f other:f vol:f", _TWO, H)
def join_left_nan_zero(t):
    b = bars(t)
    other = b.where("asset = 'error'").select("slot", F.col("close").alias("other"), "vol")
    return b.where("asset = 'view'").select("slot", "close").join(other, "slot", "left").fillna(0.0, ["vol"])


@query("event_id:i rate:f", "SELECT v.event_id, e.value AS rate FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON v.ts >= e.ts")
def asof_backward(t):
    e = t.events
    return J.asof(e.where("event_type = 'view'").select("event_id", "ts"), e.where("event_type = 'error'").select("ts", F.col("value").alias("rate")), "ts", "rate")


@query("event_id:i rate:f", "SELECT v.event_id, e.value AS rate FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON v.user_id = e.user_id AND v.ts >= e.ts")
def asof_by_key(t):
    e = t.events
    return J.asof(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'error'").select("user_id", "ts", F.col("value").alias("rate")), "ts", "rate", ["user_id"])


@query("slot:i a:f b:f", "SELECT a.slot, a.change AS a, b.change AS b FROM bars a JOIN bars b ON a.slot = b.slot AND a.asset = 'click' AND b.asset = 'view'", H)
def intersect_legs(t):
    b = bars(t)
    return b.where("asset = 'click'").select("slot", F.col("change").alias("a")).join(b.where("asset = 'view'").select("slot", F.col("change").alias("b")), "slot")


@query("slot:i", "SELECT slot FROM bars GROUP BY 1 HAVING count(DISTINCT asset) = 5", H)
def nway_intersect(t):
    return J.common_slots(bars(t), "asset", "slot", 5)


@query("asset matched:i missing:i", "SELECT a.asset, count(b.slot) AS matched, count(*) - count(b.slot) AS missing FROM bars a LEFT JOIN (SELECT asset, slot FROM bars WHERE ntr > 1) b ON a.asset = b.asset AND a.slot = b.slot GROUP BY 1", H)
def align_audit(t):
    b = bars(t)
    return J.exact_align(b, b.where("ntr > 1"), "asset", "slot")


_DRAWS = "draws AS (SELECT b, (b * 7919 + k * 104729) % greatest(1, n - 99) + i AS pos FROM (SELECT max(n) AS n FROM days) AS n_, range(5) r(b), range(200) s(k), range(100) u(i) WHERE k * 100 + i < n)"


@query("b:i asset n:i mean:f", "SELECT b, asset, count(*) AS n, avg(change) AS mean FROM draws JOIN days ON draws.pos = days.pos GROUP BY 1, 2", f"{DAYS}, {_DRAWS}")
def slot_multiset_join(t):
    from tidebars.operators.resampling import block_starts, drawn_slots

    n = days(t).agg(F.coalesce(F.max("n"), F.lit(0)).cast("int")).first()[0]
    draws = drawn_slots(block_starts(t.spark, n, 100, 5), n, 100)
    w = J.resampled(days(t).select("asset", F.col("pos").cast("int").alias("pos"), "change"), draws, "pos")
    return w.groupBy("b", "asset").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("change")) / F.sum("w")).alias("mean"))


@query("asset fold:i n:i lo:i hi:i", "SELECT asset, CAST(floor((pos - 720) / 120.0) AS BIGINT) AS fold, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM days WHERE pos >= 720 GROUP BY 1, 2", DAYS)
def fold_range_join(t):
    return J.test_folds(days(t), 720, 120).groupBy("asset", "fold").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query("asset fold:i n:i rate:f", "SELECT asset, f AS fold, count(*) AS n, avg(y) AS rate FROM days JOIN range(40) r(f) ON pos >= f * 120 AND pos < f * 120 + 720 AND f * 120 + 720 < n GROUP BY 1, 2", DAYS)
def fold_train_join(t):
    return J.train_folds(days(t), 720, 120).groupBy("asset", "fold").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))


@query("asset k:i hit:f", "SELECT a.asset, 24 AS k, avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END) AS hit FROM days a JOIN (SELECT asset, y, (pos + 24) % n + 1 AS q FROM days) AS b ON a.asset = b.asset AND a.pos + 1 = b.q GROUP BY 1", DAYS)
def shift_self_join(t):
    d = days(t)
    moved = d.select("asset", F.pmod(F.col("pos") + 24, F.col("n")).alias("pos"), F.col("y").alias("z"))
    return d.join(moved, ["asset", "pos"]).groupBy("asset").agg(F.lit(24).alias("k"), F.avg((F.col("y") == F.col("z")).cast("double")).alias("hit")).select("asset", F.lit(24).alias("k"), "hit")


@query("a b n:i rho:f", "SELECT l.asset AS a, r.asset AS b, count(*) AS n, corr(l.change, r.change) AS rho FROM bars l JOIN bars r ON l.slot = r.slot AND l.asset < r.asset GROUP BY 1, 2 HAVING count(*) > 100", H)
def pairwise_corr(t):
    return J.pair_correlations(bars(t), "asset", "slot", "change", 100)


@query("rho:f n_eff:f", "SELECT avg(rho) AS rho, 5 / (1 + 4 * avg(rho)) AS n_eff FROM (SELECT corr(l.change, r.change) AS rho FROM bars l JOIN bars r ON l.slot = r.slot AND l.asset < r.asset GROUP BY l.asset, r.asset HAVING count(*) > 100) AS x", H)
def effective_number(t):
    return J.pair_correlations(bars(t), "asset", "slot", "change", 100).agg(F.avg("rho").alias("rho")).withColumn("n_eff", num(5) / (num(1) + num(4) * F.col("rho")))


@query("n:i total:f", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_universe(t):
    return t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("c_custkey:i", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_late(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("asset slot:i factor:f rest:f", "SELECT asset, slot, avg(change) OVER (PARTITION BY slot) AS factor, change - avg(change) OVER (PARTITION BY slot) AS rest FROM bars", H)
def factor_join(t):
    return J.with_factor(bars(t), "slot", "change").withColumn("rest", F.col("change") - F.col("factor"))


@query("asset n:i", "SELECT asset, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 300", H)
def admission(t):
    return B.admitted(bars(t), "asset", 300).groupBy("asset").agg(F.count("*").alias("n"))


@query("user_id:i event_id:i value:f", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events) AS x WHERE k = 1")
def first_seen(t):
    return B.first_seen(t.events, ["user_id"], ["ts"])


@query("c_custkey:i total:f", "SELECT o_custkey AS c_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 ORDER BY round(sum(o_totalprice), 4) DESC, 1 LIMIT 100")
def top_n(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return s.orderBy(F.round("total", 4).desc(), "c_custkey").limit(100)


@query("k:i c_custkey:i", "SELECT DISTINCT k, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) AS x WHERE k IN (SELECT CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT) FROM range(10) r(i))")
def quantile_pick(t):
    at = J.ranked(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").withColumn("k", F.col("rank") - 1)
    picks = F.array(*(F.rint(F.lit(i) * (F.col("_n") - 1) / num(9)).cast("long") for i in range(10)))
    return at.where(F.array_contains(picks, F.col("k")))


@query("slot:i k:i", "SELECT slot, count(*) AS k FROM (SELECT slot FROM bars WHERE asset = 'click' UNION ALL SELECT slot FROM bars WHERE asset = 'view') AS x GROUP BY 1", H)
def union_legs(t):
    b = bars(t)
    return J.union_all([b.where("asset = 'click'").select("slot"), b.where("asset = 'view'").select("slot")]).groupBy("slot").agg(F.count("*").alias("k"))


@query("slot:i", "SELECT slot FROM bars WHERE asset = 'click' INTERSECT SELECT slot FROM bars WHERE asset = 'error'", H)
def intersect_ts(t):
    b = bars(t)
    return b.where("asset = 'click'").select("slot").intersect(b.where("asset = 'error'").select("slot"))


@query("slot:i", "SELECT slot FROM bars WHERE asset = 'click' EXCEPT SELECT slot FROM bars WHERE asset = 'error'", H)
def except_ts(t):
    b = bars(t)
    return b.where("asset = 'click'").select("slot").subtract(b.where("asset = 'error'").select("slot"))


@query("asset first:i n:i", "SELECT asset, min(slot) AS first, count(DISTINCT slot) AS n FROM bars GROUP BY 1", H)
def distinct_counts(t):
    return positioned(bars(t)).groupBy("asset").agg(F.min("slot").alias("first"), F.count_distinct("slot").alias("n"))
