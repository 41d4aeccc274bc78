"""Properties of models, metrics, inference, sources and streaming on small made-up inputs."""

import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidebars.functions.scalar import normal_cdf
from tidebars.operators import inference as I
from tidebars.operators import joins as J
from tidebars.operators import metrics as M
from tidebars.operators import models as D
from tidebars.operators import resampling as R
from tidebars.operators import series as S
from tidebars.operators import trading as X
from tidebars.sources import files, paged
from tidebars.streaming.bars import stream_bars


def series(spark, values, asset="a"):
    rows = [(asset, i, float(v), int(v > 0)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset string, pos int, change double, y int")


def test_auc_with_ties_is_the_pairwise_definition(spark):
    rng = np.random.default_rng(0)
    p, y = rng.integers(0, 6, 200) / 6, rng.integers(0, 2, 200)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "p": p, "y": y, "pos": range(200)}))
    assert abs(M.auc(df, ["g"]).first()["auc"] - np.mean(pairs)) < 1e-12
    assert M.auc(df.where("y = 1"), ["g"]).first()["auc"] is None


def test_kernel_logit_finds_planted_reversal_and_no_noise(spark):
    rng = np.random.default_rng(1)
    w, s = np.arange(1, 13) ** -1.0, np.zeros(3012)
    for t in range(12, len(s)):
        s[t] = 1 if rng.random() < 1 / (1 + np.exp(0.6 * (w @ s[t - 12 : t][::-1]))) else -1
    out = D.walk_forward(series(spark, s[12:]), D.KernelLogit(grid=(0.0, 0.5, 1.0, 1.5)), 1000, 500)
    assert M.auc(out, ["asset"]).first()["auc"] > 0.55
    assert out.agg(F.max("a")).first()[0] < 0
    noise = D.walk_forward(series(spark, rng.choice([-1.0, 1.0], 3000)), D.KernelLogit(grid=(0.0, 1.0)), 1000, 500)
    assert abs(M.auc(noise, ["asset"]).first()["auc"] - 0.5) < 0.04


def test_fold_bounds_agree_with_arithmetic_folds(spark):
    for n in (721, 1000, 1680):
        rows = spark.range(n).select(F.lit("a").alias("asset"), F.col("id").cast("int").alias("pos"), F.lit(n).alias("n"))
        got = {r["fold"]: (r["lo"], r["hi"] + 1) for r in J.test_folds(rows, 720, 120).groupBy("fold").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
        assert got == {i: f[2:] for i, f in enumerate(D.fold_bounds(n, 720, 120))}
        tr = {r["fold"]: (r["lo"], r["hi"] + 1) for r in J.train_folds(rows, 720, 120).groupBy("fold").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
        assert tr == {i: f[:2] for i, f in enumerate(D.fold_bounds(n, 720, 120))}


def test_single_class_window_falls_back_to_the_base_rate(spark):
    out = D.walk_forward(series(spark, [1.0] * 60), D.KernelLogit(), 30, 10)
    assert {r["p"] for r in out.collect()} == {1.0}


def test_benjamini_hochberg_is_the_step_up_rule(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(40), rng.random(10) * 0.005])
    order = np.sort(p)
    k = max((i + 1 for i in range(50) if order[i] <= 0.05 * (i + 1) / 50), default=0)
    got = I.benjamini_hochberg(spark.createDataFrame(pd.DataFrame({"p": p, "k": range(50)})), "p", "k")
    assert got.where("rejected").count() == k > 0


def test_identical_legs_have_no_gap(spark):
    rng = np.random.default_rng(3)
    base = pd.DataFrame({"slot": range(300), "y": rng.integers(0, 2, 300), "p": rng.random(300)})
    df = spark.createDataFrame(pd.concat([base.assign(asset="a"), base.assign(asset="b")]))
    starts = np.random.default_rng(0).integers(0, 271, (20, 10)).tolist()
    rep = R.joint_auc_bootstrap(df, starts, 300, 30).groupBy("b").agg((F.max("auc") - F.min("auc")).alias("x"))
    assert rep.count() == 21 and rep.agg(F.max("x")).first()[0] == 0


def test_weighted_auc_is_that_of_the_multiset():
    rng = np.random.default_rng(4)
    p, y, w = np.sort(rng.random(50)), rng.integers(0, 2, 50), rng.integers(0, 4, 50)
    q, z = np.repeat(p, w), np.repeat(y, w)
    pairs = [(a > b) for a in q[z == 1] for b in q[z == 0]]
    assert abs(R.weighted_auc(p, y, w) - np.mean(pairs)) < 1e-12


def test_noise_has_hurst_one_half_and_variance_ratio_one(spark):
    x = series(spark, np.random.default_rng(5).normal(size=6000)).withColumn("slot", F.col("pos").cast("long")).drop("pos")
    h = S.hurst(S.dfa(x, "change", [8, 16, 32, 64, 128, 256])).first()["h"]
    assert abs(h - 0.5) < 0.08
    assert abs(I.variance_ratio(x, "change", 4).first()["vr"] - 1) < 0.1


def test_normal_cdf(spark):
    from statistics import NormalDist

    xs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 2e-7 for r in got)


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1,), (5,), (9,)], "ts int")
    right = spark.createDataFrame([(2, 0.1), (5, 0.2)], "ts int, rate double")
    assert [r["rate"] for r in J.asof(left, right, "ts", "rate").orderBy("ts").collect()] == [None, 0.2, 0.2]


def test_kelly_no_replaces_yes(spark):
    df = spark.createDataFrame([(0.5, 0.9, 1), (0.5, 0.1, 0), (0.5, 0.5, 1)], "ref double, p double, y int")
    got = X.kelly(df, 1.0).orderBy("p").collect()
    assert got[0]["stake"] > 0 and got[0]["ret"] > 0 and got[1]["stake"] == 0 and got[2]["ret"] > 0


def test_surrogates_keep_values(spark):
    x = np.random.default_rng(6).normal(size=256)
    for kind in ("shuffle", "iaaft", "reverse", "signs"):
        got = sorted(abs(r["change"]) for r in R.surrogates(series(spark, x), kind).collect())
        assert np.allclose(got, np.sort(np.abs(x)))


def test_empty_and_null_bars(spark):
    empty = series(spark, [])
    assert D.markov(S.positioned(empty.withColumnRenamed("pos", "slot")), 10, 5, 1).count() == 0
    assert M.auc(empty.withColumn("p", F.lit(0.5)), ["asset"]).count() == 0


def test_json_bars_merge_and_universe(spark, tmp_path):
    bar = lambda t, c: {"timestamp": t, "datetime": f"2025-01-0{t} 00:00:00", "up": True, "change": c}
    (tmp_path / "btc-15m.json").write_text(json.dumps([bar(2, 0.2), bar(1, None)]))
    (tmp_path / "u.txt").write_text("# names\nBTC BRK.B\n")
    rows = files.json_bars(spark, str(tmp_path / "*-15m.json"))
    assert {(r["asset"], r["timestamp"], r["change"]) for r in rows.collect()} == {("btc", 1, 0.0), ("btc", 2, 0.2)}
    late = rows.where("timestamp = 2").withColumn("change", F.lit(9.0))
    assert sorted(r["change"] for r in files.merged_bars([rows, late]).collect()) == [0.0, 9.0]
    assert files.span(rows, "2025-01-02", "2025-01-02").count() == 1
    assert [r["symbol"] for r in files.universe(spark, str(tmp_path / "u.txt")).collect()] == ["btc", "brk-b"]
    table = files.report_markdown(spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0)], "k string, c string, v double"), "k", "c", "v")
    assert "**2.0000**" in table


def test_zip_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "time,side\n1,BUY\n2,SELL\n")
    got = files.zip_csv(spark, str(tmp_path / "*.zip"), "time LONG, side STRING").orderBy("line").collect()
    assert [(r["time"], r["side"], r["line"]) for r in got] == [(1, "BUY", 0), (2, "SELL", 1)]


def test_paged_source(spark):
    def fetch(symbol, cursor, limit):
        return [(i, float(i)) for i in range(cursor, min(cursor + limit, 25))]

    got = paged.read_paged(spark, "ticks_test", fetch, ["a", "b"], "ts LONG, price DOUBLE", 0, 10)
    assert got.count() == 50


def test_stream_bars(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, 60), ("a", 2.0, 120), ("a", 3.0, 7200), ("a", 1.0, 99999)], "asset string, price double, s long").select("asset", "price", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("asset string, price double, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_bars(ticks).writeStream.format("memory").queryName("stream_bars_t").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["start"].timestamp(): (r["open"], r["close"], r["ntr"]) for r in spark.table("stream_bars_t").collect()}
    assert (1.0, 2.0, 2) in got.values()


def test_resampling_covers_whole_series(spark, monkeypatch):
    """Draws reach all days and all slots, not a first part of them."""
    from tidebars.plans import QUERIES, analysis_queries, study_queries
    from tidebars.plans.inputs import days

    folder, seen = "/root/testdata/sf0.01", {}
    real = analysis_queries.D.walk_forward

    def spy(rows, *args, **more):
        seen["rows"] = rows
        return real(rows, *args, **more)

    class T:
        orders = spark.read.parquet(f"{folder}/orders.parquet")

    d = days(T).select("asset", "pos", "y").toPandas()
    size = d.groupby("asset").size()
    n = int(size.max())
    assert n > 1200
    monkeypatch.setattr(analysis_queries.D, "walk_forward", spy)
    for name in ("refit_boot", "refit_joint"):
        QUERIES[name](spark, folder)
        rows = seen["rows"].groupBy("asset").count().collect()
        assert len(rows) == {"refit_boot": 200, "refit_joint": 150}[name] * len(size)
        assert all(r["count"] > 1200 and abs(r["count"] - size[r["asset"].split("/")[1]]) <= (0 if name == "refit_joint" else n - size.min()) for r in rows)
    got = {r["asset"]: r["sd"] for r in QUERIES["power_mde"](spark, folder).collect()}
    slots = [[(b * 7919 + k * 104729) % (n - 49) + i for k in range(-(-n // 50)) for i in range(50) if k * 50 + i < n] for b in range(100)]
    for asset, g in d.groupby("asset"):
        y = dict(zip(g["pos"], g["y"]))
        means = [np.mean([y[p] for p in s if p in y]) for s in slots]
        assert abs(got[asset] - np.std(means, ddof=1)) < 1e-6
    long = spark.range(900).selectExpr("'a' as asset", "id + 5 as slot", "1 as y", "0.5D as p", "0D as change")
    monkeypatch.setattr(analysis_queries, "scored", lambda t: long)
    s, n = analysis_queries._on_grid(None)
    assert s.count() == n == 900


def test_subsumption_fits_signs_imbalance_and_both(spark):
    """Three models on shared whole folds; where only the imbalance tells, the fits with it find that."""
    rng = np.random.default_rng(4)
    n, imb = 900, np.random.default_rng(3).uniform(-1, 1, 900)
    y = (rng.random(n) < 1 / (1 + np.exp(-4 * np.roll(imb, 1)))).astype(int)
    rows = pd.DataFrame({"asset": "a", "pos": np.arange(n), "y": y, "sign": rng.choice([-1.0, 1.0], n), "imb": imb})
    got = D.feature_logits(spark.createDataFrame(rows), {"signs": ["sign"], "imb": ["imb"], "both": ["sign", "imb"]}, 400, 120).toPandas()
    assert all((g["pos"].min(), g["pos"].max(), len(g)) == (412, 891, 480) for _, g in got.groupby("model"))
    auc = {m: R.weighted_auc(*(g.sort_values("p")[c].to_numpy() for c in ("p", "y")), np.ones(len(g))) for m, g in got.groupby("model")}
    assert auc["imb"] > 0.8 and auc["both"] > 0.8 and abs(auc["signs"] - 0.5) < 0.1
    from tidebars.plans import QUERIES

    out = QUERIES["subsumption"](spark, "/root/testdata/sf0.01")
    assert {r["model"] for r in out.select("model").distinct().collect()} == {"signs", "imb", "both"}


def test_studies_fit_whole_grids(spark, monkeypatch):
    """The composite studies choose from the default grids, not from a few of their values."""
    from tidebars.plans import QUERIES

    seen, real = [], D.walk_forward
    monkeypatch.setattr(D, "walk_forward", lambda rows, model, *a, **k: (seen.append(model), real(rows, model, *a, **k))[1])
    for name in ("gap_walk_forward", "horizon_walk_forward", "null_walk_forward", "wf_l1_ar", "lag_sweep"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert all(m.grid == D.KernelLogit().grid for m in seen if isinstance(m, D.KernelLogit))
    assert [m.choose for m in seen if isinstance(m, D.LassoLogit)] == [D.LassoLogit().choose]
    assert len(seen) == 4 + 27 and max(m.n_lags for m in seen) == 48
