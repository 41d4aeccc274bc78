"""Models against independent fits in NumPy, and joins, ranks and sums against loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebars.operators import inference as I
from tidebars.operators import joins as J
from tidebars.operators import models as D
from tidebars.sources import venues


def made_up(n=260, seed=0):
    rng = np.random.default_rng(seed)
    change = rng.normal(0, 0.01, n)
    for t in range(1, n):
        change[t] -= 0.4 * change[t - 1]
    return change, (change > 0).astype(float)


def lags_of(change, n, at):
    return np.array([change[t - k] for t in at for k in range(1, n + 1)]).reshape(len(at), n)


def penalised(x, y, c):
    """Minimum of c sum(log-loss) + |w|^2 / 2 with a free intercept, by damped Newton steps on the whole."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(x.shape[1]), 0)
    loss = lambda w: c * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (ridge * w * w).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(c * (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge) + 1e-12 * np.eye(len(w)), c * z.T @ (p - y) + ridge * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


@pytest.mark.parametrize("c", [1e8, 0.5])
def test_lag_logit_is_the_penalised_fit_of_standardised_returns(c):
    change, y = made_up()
    folds = D.fold_bounds(len(y), 150, 50)
    got = D.LagLogit(4, (c,)).fit_predict(change, y, folds)
    for (lo, hi, start, stop), (p, _) in zip(folds, got):
        known = range(max(lo, 4), hi)
        x = lags_of(change, 4, known)
        m, s = x.mean(0), x.std(0)
        w = penalised((x - m) / s, y[list(known)], c)
        z = (lags_of(change, 4, range(start, stop)) - m) / s
        assert np.abs(p - 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))).max() < 1e-6


def test_ridge_is_chosen_by_the_last_fifth():
    change, y = made_up(seed=3)
    (lo, hi, start, stop), = D.fold_bounds(200, 180, 20)
    (_, params), = D.LagLogit(4, D.RIDGES).fit_predict(change[:200], y[:200], [(lo, hi, start, stop)])
    cut = 4 + int(0.8 * (hi - 4))
    x, v = lags_of(change, 4, range(4, cut)), lags_of(change, 4, range(cut, hi))
    m, s = x.mean(0), x.std(0)
    losses = []
    for c in D.RIDGES:
        w = penalised((x - m) / s, y[4:cut], c)
        p = 1 / (1 + np.exp(-((v - m) / s @ w[:-1] + w[-1])))
        losses.append(-(y[cut:hi] * np.log(p) + (1 - y[cut:hi]) * np.log(1 - p)).mean())
    assert params["kernel"] == D.RIDGES[int(np.argmin(losses))]


def test_lasso_meets_its_conditions():
    change, y = made_up(seed=1)
    x = lags_of(change, 5, range(5, 200))
    x = (x - x.mean(0)) / x.std(0)
    for c in (0.05, 0.3, 2.0):
        predict, _ = D.LassoLogit(5).fit(x, y[5:200], c)
        z = np.column_stack([np.ones(len(x)), x])
        base = predict(np.zeros((1, 5)))[0]
        logit = lambda p: np.log(p / (1 - p))
        w = np.append(logit(base), [logit(predict(e[None])[0]) - logit(base) for e in np.eye(5)])
        pull = z.T @ (y[5:200] - predict(x))
        on = np.abs(w) > 1e-7
        assert np.allclose(pull[on], np.sign(w[on]) / c, atol=1e-3 / c) and (np.abs(pull[~on]) <= 1 / c + 1e-6).all()


def test_a_tree_takes_the_best_split():
    rng = np.random.default_rng(2)
    x, g = rng.integers(0, 6, (60, 3)).astype(float), rng.normal(size=60)
    g += (x[:, 1] > 2) * 2
    tree = D._tree(x, np.argsort(x, axis=0, kind="stable"), g, np.full(60, 0.25), np.ones(60, bool), 1)
    best = max((sum(len(s) * s.mean() ** 2 for s in (g[x[:, f] <= v], g[x[:, f] > v])), f, v) for f in range(3) for v in np.unique(x[:, f])[:-1])
    below = x[:, best[1]] <= best[2]
    want = np.where(below, g[below].sum() / (0.25 * below.sum()), g[~below].sum() / (0.25 * (~below).sum()))
    assert np.allclose(D._apply(tree, x), want)


def test_trees_and_network_learn_a_conjunction():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > -0.3)).astype(float)
    for model, setting in ((D.Trees(4), (150, 3, 0.1)), (D.Network(4, passes=400), ((32, 16), 1e-4))):
        predict, _ = model.fit(x[:2000], y[:2000], setting)
        assert ((predict(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.85


def test_forecasts_do_not_depend_on_how_folds_are_grouped(spark, monkeypatch):
    change, y = made_up(400, 7)
    rows = spark.createDataFrame(pd.DataFrame({"asset": "a", "pos": np.arange(400), "change": change, "y": y.astype(int)}))
    for model in (D.LagLogit(6), D.KernelLogit(6, grid=(0.0, 1.0)), D.Trees(3, ((5, 2, 0.1),))):
        out = []
        for n in (1, 4, 100):
            monkeypatch.setattr(D, "FOLDS", n)
            out.append(D.walk_forward(rows, model, 100, 30).toPandas().sort_values("pos")[["pos", "fold", "p", "train_nll"]].to_numpy())
        direct = np.concatenate([p for p, _ in model.fit_predict(change, y, D.fold_bounds(400, 100, 30))])
        assert np.allclose(out[0], out[1]) and np.allclose(out[0], out[2]) and np.allclose(out[0][:, 2], direct)
    assert D.walk_forward(rows.limit(0), D.LagLogit(), 100, 30).count() == 0


def test_quantiles_and_ranks_without_one_task(spark):
    rng = np.random.default_rng(1)
    for x in (rng.normal(0, 1e-4, 500), np.round(rng.normal(0, 3, 400)), np.array([5.0]), np.concatenate([rng.normal(1e6, 1, 200), [-1e9, 0.0, 0.0]])):
        df = spark.createDataFrame([*((float(v), i) for i, v in enumerate(x)), (None, -1)], "x double, i long")
        got = J.quantile_edges(df, "x", [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]).first()[0]
        assert np.allclose(got, np.quantile(x, [0, 0.1, 1 / 3, 0.5, 0.99, 1]), rtol=1e-12, atol=1e-15)
        at = {r["i"]: (r["rank"], r["_n"]) for r in J.ranked(df.where("x is not null"), "x", "i").collect()}
        assert at == {int(i): (k + 1, len(x)) for k, i in enumerate(np.lexsort((np.arange(len(x)), x)))}
    q = np.sort(rng.uniform(0, 1, 300) ** 4)
    df = spark.createDataFrame([(float(p), i) for i, p in enumerate(rng.permutation(q))], "p double, k int")
    got = I.benjamini_hochberg(df, "p", "k", 0.2).toPandas().sort_values("p")
    last = max((i + 1 for i in range(300) if q[i] <= 0.2 * (i + 1) / 300), default=0)
    assert got.rejected.tolist() == [i < last for i in range(300)] and last > 0


def test_asof_carries_over_days(spark):
    rng = np.random.default_rng(3)
    left = [(i, int(t)) for i, t in enumerate(rng.integers(0, 20 * 86400, 200))]
    right = [(int(t), float(v)) for v, t in enumerate(rng.choice(np.arange(3 * 86400, 9 * 86400), 25, replace=False))]
    got = J.asof(spark.createDataFrame(left, "i int, ts long"), spark.createDataFrame(right, "ts long, v double"), "ts", "v").collect()
    want = {i: max(((s, v) for s, v in right if s <= t), default=(0, None))[1] for i, t in left}
    assert {r["i"]: r["v"] for r in got} == want
    assert J.asof(spark.createDataFrame(left, "i int, ts long"), spark.createDataFrame([], "ts long, v double"), "ts", "v").where("v is not null").count() == 0


def test_pair_correlations_are_of_common_slots(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=300)
    data = {a: {int(s): float(base[s] * k + rng.normal() + 100) for s in rng.choice(300, 200, replace=False)} for k, a in enumerate("abcd")}
    df = spark.createDataFrame([(a, s, v) for a, d in data.items() for s, v in d.items()] + [("a", 900, None)], "asset string, slot long, x double")
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in J.pair_correlations(df, "asset", "slot", "x", 100, slots=64).collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")):
        both = sorted(set(data[a]) & set(data[b]))
        assert got[a, b][0] == len(both) and abs(got[a, b][1] - np.corrcoef([data[a][s] for s in both], [data[b][s] for s in both])[0, 1]) < 1e-9


def test_ols_on_several_regressors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ [2.0, -0.5] + rng.normal(size=200) * (1 + np.abs(x[:, 0]))
    rows = [("g", *map(float, r), float(v)) for r, v in zip(x, y)] + [("flat", 1.0, 2.0, float(i)) for i in range(5)]
    got = {(r["g"], r["term"]): r for r in I.ols_many(spark.createDataFrame(rows, "g string, a double, b double, y double"), ["g"], "y", ["a", "b"]).collect()}
    z = np.column_stack([np.ones(200), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    bread, e = np.linalg.inv(z.T @ z), y - z @ b
    se = np.sqrt(np.diag(bread @ (z * (e * e)[:, None]).T @ z @ bread) * 200 / 197)
    for i, term in enumerate(("const", "a", "b")):
        assert abs(got["g", term]["b"] - b[i]) < 1e-9 and abs(got["g", term]["se"] - se[i]) < 1e-9 and got["flat", term]["b"] is None


def test_venues_give_one_shape(spark):
    raw = {
        "binance": [("X", ["60000", "1", "4", "0.5", "2", "9", "more"])], "coinbase": [("X", ["60", "0.5", "4", "1", "2", "9"]), ("Y", [None, "1"]), ("Z", ["60"])],
        "okx": [("X", ["60000", "1", "4", "0.5", "2", "9"])], "bybit": [("X", ["60000", "1", "4", "0.5", "2", "nine"])],
    }
    got = venues.all_candles({v: spark.createDataFrame(r, "symbol string, candle array<string>") for v, r in raw.items()}).collect()
    assert len(got) == 5 and all(tuple(r)[2:7] == (60, 1.0, 4.0, 0.5, 2.0) for r in got if r["symbol"] == "X")
    assert {r["venue"]: r["volume"] for r in got if r["symbol"] == "X"} == {"binance": 9.0, "coinbase": 9.0, "okx": 9.0, "bybit": None}
    assert venues.batches(["a", "b", "a", "c"], 2) == [["a", "b"], ["c"]]
    few = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "symbol string, x int")
    assert {r["symbol"] for r in venues.long_enough(few, 2).select(F.col("symbol")).collect()} == {"a"}
