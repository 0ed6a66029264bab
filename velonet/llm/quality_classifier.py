"""Operator 1, quality classifier: sparse rule ensemble over text statistics.

Small boosted trees propose rules (the path to every node is a conjunction of comparisons), a lasso logistic regression
keeps a few of them, and the kept rules are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, text_stats

FEATURES = text_stats.RATIOS
#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 20_000
TREES, DEPTH, SHRINK, CUTS, SEED = 30, 3, 0.3, 24, 11
THRESHOLD = 0.3

#: A rule: comparisons (feature, is_greater, threshold) that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float


def _split(x: np.ndarray, r: np.ndarray, cuts: list[np.ndarray], features: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) by squared error of the residuals r."""
    best = (1e-9, -1, 0.0)
    total, n = r.sum(), len(r)
    for f in features.tolist():
        if not len(cuts[f]):
            continue
        side = np.searchsorted(cuts[f], x[:, f], "left")  # number of cuts below the value
        count = np.bincount(side, minlength=len(cuts[f]) + 1)
        sums = np.bincount(side, weights=r, minlength=len(cuts[f]) + 1)
        nl, sl = np.cumsum(count)[:-1], np.cumsum(sums)[:-1]
        ok = (nl >= 10) & (n - nl >= 10)
        if not ok.any():
            continue
        gain = np.where(ok, sl**2 / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1) - total**2 / n, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float(cuts[f][k]))
    return best


def _grow(x, r, cuts, rng, rows, path: Rule, depth: int, rules: list[Rule], value: np.ndarray) -> None:
    """Grow one tree; every node but the root leaves its path in ``rules``, every leaf its mean in ``value``."""
    if path:
        rules.append(path)
    if depth and len(rows) >= 20:
        features = rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False)
        gain, f, t = _split(x[rows], r[rows], cuts, features)
        if f >= 0:
            right = x[rows, f] > t
            _grow(x, r, cuts, rng, rows[~right], (*path, (f, False, t)), depth - 1, rules, value)
            _grow(x, r, cuts, rng, rows[right], (*path, (f, True, t)), depth - 1, rules, value)
            return
    value[rows] = r[rows].mean() if len(rows) else 0.0


def propose(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules from TREES boosted trees, each grown on all rows with a random choice of features."""
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    margin, rules = np.zeros(len(x)), []
    for _ in range(TREES):
        r = y - 1 / (1 + np.exp(-margin))
        value = np.zeros(len(x))
        _grow(x, r, cuts, rng, np.arange(len(x)), (), DEPTH, rules, value)
        margin += SHRINK * 4 * value
    return list(dict.fromkeys(rules))


def holds(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    for k, rule in enumerate(rules):
        for f, greater, t in rule:
            out[:, k] *= (x[:, f] > t) if greater else (x[:, f] <= t)
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty (not on the intercept, the last weight), by accelerated proximal steps."""
    a = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    u = np.ones(a.shape[1])
    for _ in range(12):  # largest eigenvalue of a'a bounds the curvature
        u = a.T @ (a @ u)
        u /= np.linalg.norm(u)
    step = 4 * len(a) / float(np.linalg.norm(a @ u) ** 2 * 1.05 + 1e-12)
    shrink = np.full(a.shape[1], penalty * step)
    shrink[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        new = v - step * (a.T @ (p - y)) / len(a)
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The penalty is chosen on a fifth of the rows; without rows of both classes the model is a constant."""
    if len(y) == 0 or y.min() == y.max() or len(y) < 50:
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model((), (), float(np.log(p / (1 - p))))
    rules = propose(x, y)
    z = holds(x, rules)
    own = np.arange(len(y)) % 5 != 0
    best, w = (np.inf, 0.0), None
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005):
        w = lasso(z[own], y[own], penalty, w, 150)
        m = z[~own] @ w[:-1] + w[-1]
        loss = float(np.mean(np.logaddexp(0, m) - y[~own] * m))
        best = min(best, (loss, penalty))
    w = lasso(z, y, best[1])
    kept = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Model(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(w[-1]))


def compiled(model: Model) -> Column:
    """The model as a column over the statistics."""
    margin = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        cond = None
        for f, greater, t in rule:
            c = F.col(FEATURES[f]) > t if greater else F.col(FEATURES[f]) <= t
            cond = c if cond is None else cond & c
        margin = margin + F.when(cond, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows; rows set aside by held_out() never enter."""
    rows = text_stats.sample(docs, labels, most)
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Null and empty texts have statistics of 0 and a score like others; null ids are not held out; repeated rows stay; an
    empty table gives no rows; further columns are ignored. No shuffle.
    """
    seen = text_stats.measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = seen.select("doc_id", common.held_out().alias("held_out"), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
