"""Walk-forward direction models.

The base-rate and Markov models are relational. The others are a grouped map of a few folds of one series; candidates of a
kernel are fitted together by vectorised Newton steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.functions.scalar import num
from tidebars.operators.joins import test_folds, train_folds
from tidebars.operators.series import along, markov_state


def base_rate(rows: DataFrame, train: int, test: int) -> DataFrame:
    """(asset, pos, fold, y, p): the training share of rises for each tested row of (asset, pos, n, y)."""
    fit = train_folds(rows, train, test).groupBy("asset", "fold").agg(F.avg(F.col("y").cast("double")).alias("p"))
    return test_folds(rows, train, test).join(fit, ["asset", "fold"]).select("asset", "pos", "fold", "y", "p")


def markov(rows: DataFrame, train: int, test: int, order: int) -> DataFrame:
    """(asset, pos, fold, y, p): Laplace-smoothed share of rises after the last ``order`` labels; the base rate for a state
    that training has not seen."""
    rows = rows.withColumn("state", markov_state(F.col("y"), order, along(order="pos")))
    known = train_folds(rows, train, test)
    fit = known.where("state is not null").groupBy("asset", "fold", "state").agg(((F.sum("y") + num(1)) / (F.count("*") + num(2))).alias("ps"))
    base = known.groupBy("asset", "fold").agg(F.avg(F.col("y").cast("double")).alias("pb"))
    out = test_folds(rows, train, test).join(base, ["asset", "fold"]).join(fit, ["asset", "fold", "state"], "left")
    return out.select("asset", "pos", "fold", "y", F.coalesce("ps", "pb").alias("p"))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, free: np.ndarray, steps: int = 25) -> np.ndarray:
    """Logistic coefficients of designs x (candidates, rows, columns); ``free`` columns carry no penalty."""
    k, n, d = x.shape
    w = np.zeros((k, d))
    penalty = ridge * np.where(free, 0.0, 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("knd,kd->kn", x, w), -60, 60)))
        grad = np.einsum("knd,kn->kd", x, y[None] - p) - penalty * w
        hess = np.einsum("knd,kn,kne->kde", x, p * (1 - p), x) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad[..., None])[..., 0]
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _nll(x: np.ndarray, w: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(1 / (1 + np.exp(-np.clip(np.einsum("knd,kd->kn", x, w), -60, 60))), 1e-15, 1 - 1e-15)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(1)


def lag_matrix(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of the n values before, 0 before the start."""
    out = np.zeros((len(x), n))
    for k in range(1, n + 1):
        out[k:, k - 1] = x[:-k]
    return out


KERNELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "power": lambda grid, n: np.arange(1, n + 1)[None] ** -grid[:, None],
    "exp": lambda grid, n: np.exp(-grid[:, None] * np.arange(n)[None]),
    "flat": lambda grid, n: np.ones((1, n)),
}


@dataclass(frozen=True)
class KernelLogit:
    """P(rise) = sigmoid(c + a field): soft spins weighed by a kernel of one parameter, chosen by log-loss on the last fifth of
    each training window (the first best wins), then refitted on the whole of it. ``scale`` None: 0.45 / training spread."""

    n_lags: int = 12
    kernel: str = "power"
    grid: tuple[float, ...] = tuple(round(0.1 * i, 1) for i in range(31))
    scale: float | None = 150.0

    def fit_predict(self, change: np.ndarray, y: np.ndarray, folds: list[tuple[int, int, int, int]]) -> list[tuple[np.ndarray, dict]]:
        weights = KERNELS[self.kernel](np.array(self.grid if self.n_lags > 1 else self.grid[:1]), self.n_lags)
        out = []
        for lo, hi, start, stop in folds:
            scale = self.scale if self.scale is not None else 0.45 / max(change[lo:hi].std(), 1e-12)
            fields = lag_matrix(np.tanh(scale * change), self.n_lags) @ weights.T
            x = np.stack([np.ones_like(fields), fields], 2).transpose(1, 0, 2)
            cut = lo + round(0.8 * (hi - lo))
            if len(np.unique(y[lo:hi])) < 2:
                out.append((np.full(stop - start, y[lo:hi].mean()), {}))
                continue
            free = np.array([True, False])
            best = 0
            if len(x) > 1 and len(np.unique(y[lo:cut])) == 2:
                best = int(_nll(x[:, cut:hi], _newton(x[:, lo:cut], y[lo:cut], 1e-8, free), y[cut:hi]).argmin())
            w = _newton(x[best : best + 1, lo:hi], y[lo:hi], 1e-8, free)[0]
            p = 1 / (1 + np.exp(-np.clip(x[best, start:stop] @ w, -60, 60)))
            known = 1 / (1 + np.exp(-np.clip(x[best, lo:hi] @ w, -60, 60)))
            out.append((p, {"c": w[0], "a": w[1], "kernel": float(self.grid[best]), "train_nll": _loss(known, y[lo:hi])}))
        return out


class _OnLags:
    """A model on standardised lags of the returns themselves: trained on the rows of a window that have all their lags, its
    setting chosen by log-loss on the window's last fifth, then fitted again on the whole of it."""

    n_lags: int
    choose: tuple

    def fit(self, x: np.ndarray, y: np.ndarray, setting) -> tuple[Callable[[np.ndarray], np.ndarray], dict]:
        raise NotImplementedError

    def fit_predict(self, change: np.ndarray, y: np.ndarray, folds: list[tuple[int, int, int, int]]) -> list[tuple[np.ndarray, dict]]:
        raw, out = lag_matrix(change, self.n_lags), []

        def scaled(lo: int, hi: int) -> np.ndarray:
            m, s = raw[lo:hi].mean(0), raw[lo:hi].std(0)
            return (raw - m) / np.where(s > 0, s, 1)

        for lo, hi, start, stop in folds:
            lo = max(lo, self.n_lags)
            if len(np.unique(y[lo:hi])) < 2:
                out.append((np.full(stop - start, y[lo:hi].mean() if hi > lo else 0.5), {}))
                continue
            setting, cut = self.choose[0], lo + int(0.8 * (hi - lo))
            if len(self.choose) > 1 and len(np.unique(y[lo:cut])) == 2:
                x = scaled(lo, cut)
                losses = [_loss(self.fit(x[lo:cut], y[lo:cut], c)[0](x[cut:hi]), y[cut:hi]) for c in self.choose]
                setting = self.choose[int(np.argmin(losses))]
            x = scaled(lo, hi)
            predict, params = self.fit(x[lo:hi], y[lo:hi], setting)
            out.append((predict(x[start:stop]), params | {"train_nll": _loss(predict(x[lo:hi]), y[lo:hi])}))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass(frozen=True)
class LagLogit(_OnLags):
    """Logit with a ridge 1 / c on all but the intercept; the default is as good as free."""

    n_lags: int = 12
    choose: tuple[float, ...] = (1e8,)

    def fit(self, x, y, setting):
        x = np.column_stack([np.ones(len(x)), x])
        w = _newton(x[None], y, 1 / setting, np.arange(x.shape[1]) == 0)[0]
        return lambda z: _sigmoid(w[0] + z @ w[1:]), {"c": w[0], "a": w[1], "kernel": setting}


@dataclass(frozen=True)
class LassoLogit(_OnLags):
    """Logit with an L1 penalty 1 / c on all coefficients, the intercept included, by accelerated proximal steps."""

    n_lags: int = 12
    choose: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)
    steps: int = 2000

    def fit(self, x, y, setting):
        x = np.column_stack([np.ones(len(x)), x])
        rate = 4 / max(np.linalg.norm(x, 2) ** 2, 1e-12)
        w = z = np.zeros(x.shape[1])
        k = 1.0
        for _ in range(self.steps):
            v = z - rate * (x.T @ (_sigmoid(x @ z) - y))
            new = np.sign(v) * np.maximum(np.abs(v) - rate / setting, 0)
            after = (1 + np.sqrt(1 + 4 * k * k)) / 2
            z, w, k, moved = new + (k - 1) / after * (new - w), new, after, np.abs(new - w).max()
            if moved < 1e-9:
                break
        return lambda r: _sigmoid(w[0] + r @ w[1:]), {"c": w[0], "a": w[1], "kernel": setting}


def _tree(x: np.ndarray, order: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> list | float:
    """Regression tree on the gradient, least squares splits, Newton leaves; ``order``: rows by each feature."""
    g = grad[rows]
    leaf = float(g.sum() / max(hess[rows].sum(), 1e-12)) if rows.any() else 0.0
    n = int(rows.sum())
    if depth == 0 or n < 2:
        return leaf
    total, size = g.sum(), np.arange(1, n)
    o = order.T[rows[order.T]].reshape(x.shape[1], n)  # the node's rows by each feature
    v, left = x[o, np.arange(x.shape[1])[:, None]], np.cumsum(grad[o], 1)[:, :-1]
    gain = np.where(v[:, 1:] > v[:, :-1], left**2 / size + (total - left) ** 2 / (n - size) - total**2 / n, -1.0)
    f, k = divmod(int(gain.argmax()), n - 1)
    best = (float(gain[f, k]), f, float((v[f, k] + v[f, k + 1]) / 2))
    if best[0] <= 1e-12:
        return leaf
    below = rows & (x[:, best[1]] <= best[2])
    return [best[1], best[2], _tree(x, order, grad, hess, below, depth - 1), _tree(x, order, grad, hess, rows & ~below, depth - 1)]


def _apply(tree: list | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


@dataclass(frozen=True)
class Trees(_OnLags):
    """Gradient-boosted trees on log-loss. A setting: (trees, depth, learning rate); each tree sees 0.7 of the rows."""

    n_lags: int = 12
    choose: tuple[tuple[int, int, float], ...] = ((80, 3, 0.05),)
    seed: int = 1

    def fit(self, x, y, setting):
        trees, depth, rate = setting
        rng, order = np.random.default_rng(self.seed), np.argsort(x, axis=0, kind="stable")
        base = float(np.log(y.mean() / (1 - y.mean())))
        z, made = np.full(len(y), base), []
        for _ in range(trees):
            p = _sigmoid(z)
            rows = np.zeros(len(y), bool)
            rows[rng.permutation(len(y))[: max(1, int(0.7 * len(y)))]] = True
            made.append(_tree(x, order, y - p, p * (1 - p), rows, depth))
            z = z + rate * _apply(made[-1], x)
        return lambda r: _sigmoid(base + rate * sum((_apply(t, r) for t in made), np.zeros(len(r)))), {}


@dataclass(frozen=True)
class Network(_OnLags):
    """Rectified layers under a logistic output, by Adam in batches of 200; a tenth of the rows tells when to stop (ten passes
    without gain in accuracy). A setting: (sizes of the hidden layers, L2 penalty)."""

    n_lags: int = 12
    choose: tuple[tuple[tuple[int, ...], float], ...] = (((32, 16), 1e-3),)
    seed: int = 1
    passes: int = 300

    def fit(self, x, y, setting):
        hidden, penalty = setting
        rng = np.random.default_rng(self.seed)
        sizes = [x.shape[1], *hidden, 1]
        bound = [np.sqrt((6 if b > 1 else 2) / (a + b)) for a, b in zip(sizes, sizes[1:])]
        w = [rng.uniform(-r, r, (a, b)) for r, a, b in zip(bound, sizes, sizes[1:])] + [rng.uniform(-r, r, b) for r, b in zip(bound, sizes[1:])]
        deep = len(sizes) - 1

        def forward(r: np.ndarray) -> list[np.ndarray]:
            out = [r]
            for k in range(deep):
                z = out[-1] @ w[k] + w[deep + k]
                out.append(np.maximum(z, 0) if k < deep - 1 else _sigmoid(z))
            return out

        mixed = rng.permutation(len(y))
        held, used = mixed[: max(1, len(y) // 10)], mixed[max(1, len(y) // 10) :]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        best, kept, waited, t = -1.0, [p.copy() for p in w], 0, 0
        for _ in range(self.passes if len(used) else 0):
            rng.shuffle(used)
            for at in range(0, len(used), 200):
                rows = used[at : at + 200]
                out = forward(x[rows])
                grad: list = [None] * len(w)
                d = (out[-1][:, 0] - y[rows])[:, None] / len(rows)
                for k in reversed(range(deep)):
                    grad[k], grad[deep + k] = out[k].T @ d + penalty * w[k] / len(rows), d.sum(0)
                    d = (d @ w[k].T) * (out[k] > 0) if k else d
                t += 1
                for k, g in enumerate(grad):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.001 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            right = float(((forward(x[held])[-1][:, 0] > 0.5) == (y[held] > 0.5)).mean())
            waited = 0 if right > best + 1e-4 else waited + 1
            if right > best:
                best, kept = right, [p.copy() for p in w]
            if waited >= 10:
                break
        w = kept
        return lambda r: forward(r)[-1][:, 0], {}


#: The settings that the tuned learners choose from.
RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
TREES = tuple((n, d, r) for n in (50, 150) for d in (2, 3) for r in (0.02, 0.05))
NETWORKS = tuple((h, a) for h in ((16,), (32, 16)) for a in (1e-4, 1e-2, 1.0))


def fold_bounds(n: int, train: int, test: int, partial: bool = True) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to) of each fold; the last may be short if ``partial``."""
    out, at = [], 0
    while at + train < n and (partial or at + train + test <= n):
        out.append((at, at + train, at + train, min(at + train + test, n)))
        at += test
    return out


#: Folds that one group of ``walk_forward`` fits.
FOLDS = 4
_OUT = ["asset", "pos", "fold", "y", "p", "c", "a", "kernel", "train_nll"]


def walk_forward(rows: DataFrame, model, train: int, test: int, partial: bool = True) -> DataFrame:
    """(asset, pos, fold, y, p, c, a, kernel, train_nll): forecasts of ``model`` for the tested rows of (asset, pos, change, y).

    A group is FOLDS folds of one series, with the rows that they and the lags before them need, so long series and few
    series spread as well. Series too short for a fold give no rows.
    """
    back, step = model.n_lags, FOLDS * test
    n = F.count("*").over(W.partitionBy("asset"))
    cols = rows.select("asset", F.col("pos").cast("int").alias("pos"), "change", F.col("y").cast("int").alias("y"), n.cast("int").alias("n"))
    # Group g has the folds from g FOLDS on: its rows are those from g step - back to (g + 1) step + train - 1.
    lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - (step + train - 1)) / step)).cast("int")
    hi = F.least(F.floor((F.col("pos") + back) / step), F.ceil((F.col("n") - train) / step) - 1).cast("int")
    dealt = cols.where((F.col("n") > train) & (lo <= hi)).withColumn("part", F.explode(F.sequence(lo, hi)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        y, change, at = g["y"].to_numpy(float), g["change"].to_numpy(float), int(g["pos"].iloc[0])
        first, last = int(g["part"].iloc[0]) * FOLDS, int(g["part"].iloc[0]) * FOLDS + FOLDS
        folds = [(f, tuple(i - at for i in fold)) for f, fold in enumerate(fold_bounds(int(g["n"].iloc[0]), train, test, partial)) if first <= f < last]
        parts = []
        for (f, (_, _, start, stop)), (p, params) in zip(folds, model.fit_predict(change, y, [fold for _, fold in folds])):
            part = {"asset": g["asset"].iloc[start:stop], "pos": g["pos"].iloc[start:stop], "fold": f, "y": y[start:stop].astype(int), "p": p}
            parts.append(pd.DataFrame(part | {c: np.nan if params.get(c) is None or isinstance(params[c], tuple) else float(params[c]) for c in _OUT[5:]}))
        return pd.concat(parts)[_OUT] if parts else pd.DataFrame(columns=_OUT)

    return dealt.groupBy("asset", "part").applyInPandas(run, f"asset {dict(rows.dtypes)['asset']}, pos int, fold int, y int, p double, c double, a double, kernel double, train_nll double")


def feature_logits(rows: DataFrame, sets: dict[str, list[str]], train: int, test: int, n_lags: int = 12, ridge: float = 1.0) -> DataFrame:
    """(model, asset, pos, fold, y, p): walk-forward logits on the lags of each of ``sets``' columns, one model a set.

    All models of a series share its folds, which start at the first row with a whole lag window; whole folds only. Lags are
    as they are, the intercept is free, nulls count as 0. rows: asset, pos, y and the columns.
    """
    names = sorted({c for cs in sets.values() for c in cs})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        y = g["y"].to_numpy(float)
        lagged = {c: lag_matrix(g[c].fillna(0.0).to_numpy(float), n_lags) for c in names}
        parts = []
        for model, cols in sets.items():
            x = np.column_stack([np.ones(len(g)), *(lagged[c] for c in cols)])[None]
            free = np.arange(x.shape[2]) == 0
            for f, (lo, hi, start, stop) in enumerate(fold_bounds(len(g) - n_lags, train, test, partial=False)):
                lo, hi, start, stop = (i + n_lags for i in (lo, hi, start, stop))
                if len(np.unique(y[lo:hi])) < 2:
                    p = np.full(stop - start, y[lo:hi].mean())
                else:
                    w = _newton(x[:, lo:hi], y[lo:hi], ridge, free)[0]
                    p = 1 / (1 + np.exp(-np.clip(x[0, start:stop] @ w, -60, 60)))
                parts.append(pd.DataFrame({"model": model, "asset": g["asset"].iloc[start:stop], "pos": g["pos"].iloc[start:stop], "fold": f, "y": y[start:stop].astype(int), "p": p}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["model", "asset", "pos", "fold", "y", "p"])

    cols = rows.select("asset", F.col("pos").cast("int").alias("pos"), F.col("y").cast("int").alias("y"), *(F.col(c).cast("double").alias(c) for c in names))
    return cols.groupBy("asset").applyInPandas(run, f"model string, asset {dict(rows.dtypes)['asset']}, pos int, fold int, y int, p double")
