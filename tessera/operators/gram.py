"""Validation of linear models from one aggregate.

Least squares and ridge need no more of their rows than counts, means and
co-moments. One grouped aggregate gives these for every fold (and size step);
the moments of any training set are those of its groups put together, a model is
a small system solved on the driver, and its squared-error scores on any set of
rows follow from that set's moments again. So every fold, training size and
penalty comes out of a single scan, whatever their number; only a mean absolute
error needs the rows once more, all folds in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col


@dataclass
class Moments:
    """Rows, means and centred sums of products of the features and, last, the label."""

    n: float
    mean: np.ndarray
    co: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        if not self.n or not other.n:
            return self if self.n else other
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.co + other.co + np.outer(d, d) * (self.n * other.n / n))


def moments(df: DataFrame, features: list[str], label: str, by: list[str]) -> dict[tuple, Moments]:
    """Moments of every group of ``by``, over rows without a missing feature or label, in one scan."""
    cols = [col(c).cast("double") for c in [*features, label]]
    complete = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in cols])
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = df.where(complete).groupBy(*[col(b).alias(f"g{i}") for i, b in enumerate(by)]).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).alias("co")).collect()
    out = {}
    for r in rows:
        co = np.zeros((k, k))
        for (i, j), v in zip(pairs, r["co"]):
            co[i, j] = co[j, i] = v * r["n"]
        out[tuple(r[f"g{i}"] for i in range(len(by)))] = Moments(r["n"], np.array(r["mean"]), co)
    return out


def together(parts) -> Moments:
    parts = list(parts)
    if not parts:
        raise ValueError("no complete rows to fit or score")
    return reduce(lambda a, b: a + b, parts)


@dataclass
class Linear:
    """A linear model: prediction = intercept + coef · x."""

    coef: np.ndarray
    intercept: float


def solve(m: Moments, alpha: float = 0.0) -> Linear:
    """Ridge with an unpenalised intercept (``alpha`` 0: least squares, the shortest solution if several)."""
    a = m.co[:-1, :-1] + alpha * np.eye(len(m.mean) - 1)
    coef = np.linalg.lstsq(a, m.co[:-1, -1], rcond=None)[0]
    return Linear(coef, float(m.mean[-1] - coef @ m.mean[:-1]))


def scores(m: Moments, f: Linear) -> dict[str, float]:
    """Squared-error scores of a model on the rows of ``m``."""
    offset = m.mean[-1] - f.intercept - f.coef @ m.mean[:-1]
    sse = m.co[-1, -1] - 2 * f.coef @ m.co[:-1, -1] + f.coef @ m.co[:-1, :-1] @ f.coef + m.n * offset ** 2
    sse, sst = max(float(sse), 0.0), float(m.co[-1, -1])
    mse = sse / m.n
    r2 = 1 - sse / sst if sst else float(sse == 0)
    return {"r2": r2, "mse": mse, "rmse": mse ** 0.5, "neg_mse": -mse, "neg_rmse": -(mse ** 0.5)}


def held_out(groups: dict[tuple, Moments], alphas: list[float]) -> list[tuple]:
    """(fold, alpha, scores on the fold, model fitted on all other folds); the fold is a group's first key."""
    folds = sorted({g[0] for g in groups})
    out = []
    for k in folds:
        train, test = together(m for g, m in groups.items() if g[0] != k), together(m for g, m in groups.items() if g[0] == k)
        for a in alphas:
            f = solve(train, a)
            out.append((k, a, scores(test, f), f))
    return out


def mean_absolute_errors(df: DataFrame, features: list[str], label: str, fold: str, models: dict) -> dict:
    """Mean absolute error of every fold under its own model ({fold: Linear}), all folds in one scan."""
    values = [col(c).cast("double") for c in features]
    y = col(label).cast("double")
    error = F.lit(None).cast("double")
    for k, f in models.items():
        pred = reduce(lambda a, b: a + b, [F.lit(float(c)) * x for c, x in zip(f.coef, values)], F.lit(f.intercept))
        error = F.when(col(fold) == k, F.abs(y - pred)).otherwise(error)
    rows = df.groupBy(col(fold).alias("k")).agg(F.avg(F.nanvl(error, F.lit(None))).alias("e")).collect()
    return {r["k"]: r["e"] for r in rows if r["k"] in models}


def sizes_curve(groups: dict[tuple, Moments], alpha: float, steps: int, metric: str) -> list[tuple]:
    """(step, fold, train score, held-out score) where a group is (fold, first size step that holds it)."""
    out = []
    for step in range(steps):
        for k in sorted({g[0] for g in groups}):
            train = [m for (fold, first), m in groups.items() if fold != k and first <= step]
            train, test = together(train), together(m for (fold, _), m in groups.items() if fold == k)
            f = solve(train, alpha)
            out.append((step, k, scores(train, f)[metric], scores(test, f)[metric]))
    return out
