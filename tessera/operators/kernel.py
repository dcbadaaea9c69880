"""Support vectors with a Gaussian kernel (T6): classes with probabilities, and values.

The kernel is approximated by random Fourier features (Rahimi and Recht 2007):
``cos(w . x + b)`` for ``n_features`` directions drawn once from a seed, so that a
linear machine over them is a kernel machine over the features. Training is a few
dozen passes, each one aggregate: tasks turn their rows into kernel features and
return sums of bounded size, never the features themselves.

* Classes: squared hinge loss, one class against the rest (two classes: one
  machine); values: squared epsilon-insensitive loss. Both are solved by Newton
  steps on the rows beyond the margin, the sums being a Gram matrix and a vector.
* Probabilities: a sigmoid of each machine's score, fitted by Newton steps over
  sums (Platt's method with its corrected targets), on folds of the rows the
  machine was not fitted on; for several classes, scaled to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col


@dataclass
class Settings:
    """``C`` is the weight of the loss, ``gamma`` the kernel's width ("scale": 1 / (features x variance)), as usual."""

    C: float = 1.0
    gamma: float | str = "scale"
    epsilon: float = 0.1
    n_features: int = 256
    max_iter: int = 40
    tol: float = 1e-5
    folds: int = 3
    seed: int = 42


@dataclass
class Machine:
    """A fitted machine: a column of ``weights`` and, for classes, a sigmoid (a, b) for each score."""

    features: list[str]
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    classes: list | None = None
    sigmoids: list | None = None

    def map(self, x: np.ndarray) -> np.ndarray:
        """Kernel features of rows, and a constant."""
        z = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.directions + self.phase)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        p = np.stack([_sigmoid(-(a * scores[:, i] + b)) for i, (a, b) in enumerate(self.sigmoids)], axis=1)
        if len(self.classes) == 2:
            return np.concatenate([1 - p, p], axis=1)
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def _sums(rows: DataFrame, d: int, part) -> dict:
    """Sum over all rows of ``part(x, y, fold) -> {name: array}``: one pass, arrays of fixed shape put together in tasks."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            cols = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns]
            for name, v in part(np.stack(cols[:d], axis=1), cols[d], cols[d + 1].astype(int)).items():
                total[name] = total[name] + v if name in total else np.array(v, dtype=float)
        if total:
            yield pa.RecordBatch.from_pydict({"name": list(total), "v": [v.tobytes() for v in total.values()], "shape": [list(v.shape) for v in total.values()]})

    def merge(batches):
        total: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                v = np.frombuffer(r["v"]).reshape(r["shape"])
                total[r["name"]] = total[r["name"]] + v if r["name"] in total else v
        if total:
            yield pa.RecordBatch.from_pydict({"name": list(total), "v": [v.tobytes() for v in total.values()], "shape": [list(v.shape) for v in total.values()]})

    schema = "name string, v binary, shape array<bigint>"
    parts = rows.mapInArrow(run, schema).repartition("name").mapInArrow(merge, schema).collect()
    return {r["name"]: np.frombuffer(r["v"]).reshape(r["shape"]) for r in parts}


def _newton(rows: DataFrame, machine: Machine, targets, loss, s: Settings, skip: int | None = None) -> np.ndarray:
    """Weights, a column for each target, minimising |w|^2 / 2 + C x sum of squared losses over rows not in fold ``skip``.

    ``loss(score, target)`` gives the residual (0 inside the margin). All targets
    share a pass; a step that does not lower the objective is halved.
    """
    d, m, k = len(machine.features), len(machine.phase) + 1, targets(np.zeros(1)).shape[1]
    ridge = np.ones(m)
    ridge[-1] = 1e-8  # the constant is not penalised
    w, step, best = np.zeros((m, k)), np.zeros((m, k)), np.full(k, np.inf)
    share, done = np.ones(k), np.zeros(k, bool)
    for _ in range(s.max_iter):
        at = w + share * step

        def part(x, y, fold):
            keep = np.isfinite(x).all(axis=1) & np.isfinite(y) & (fold != skip if skip is not None else True)
            z, t = machine.map(x[keep]), targets(y[keep])
            out = {}
            residual = loss(z @ at, t)
            for c in np.flatnonzero(~done):
                own = residual[:, c] != 0
                zz, rr = z[own], residual[own, c]
                out[f"{c}"] = np.concatenate([zz.T @ zz, (zz.T @ rr)[:, None], np.full((m, 1), (rr * rr).sum())], axis=1)
            return out

        got = _sums(rows, d, part)
        for c in np.flatnonzero(~done):
            g = got.get(f"{c}", np.zeros((m, m + 2)))
            value = 0.5 * (ridge * at[:, c] ** 2).sum() + s.C * g[0, -1]
            if value > best[c] + 1e-12 and share[c] > 1e-4:
                share[c] /= 2
                continue
            gained = best[c] - value
            w[:, c], best[c], share[c] = at[:, c], value, 1.0
            gradient = ridge * w[:, c] + 2 * s.C * g[:, m]
            step[:, c] = -np.linalg.solve(np.diag(ridge) + 2 * s.C * g[:, :m], gradient)
            done[c] = gained <= s.tol * max(value, 1e-12) or -gradient @ step[:, c] <= s.tol * max(value, 1e-12)
        if done.all():
            break
    return w


def _platt(rows: DataFrame, machines: list[Machine], targets, s: Settings, k: int) -> list[tuple[float, float]]:
    """Sigmoid of every score: Newton steps on held-out scores, fold f scored by machine f."""
    d = len(machines[0].features)

    def held(x, y, fold):
        keep = np.isfinite(x).all(axis=1) & np.isfinite(y)
        x, y, fold = x[keep], y[keep], fold[keep]
        score = np.zeros((len(x), k))
        for f, machine in enumerate(machines):
            score[fold == f] = machine.scores(x[fold == f])
        return score, targets(y) > 0

    counts = _sums(rows, d, lambda x, y, fold: {"n": np.stack([(t := held(x, y, fold)[1]).sum(axis=0), (~t).sum(axis=0)])}).get("n", np.zeros((2, k)))
    high, low = (counts[0] + 1) / (counts[0] + 2), 1 / (counts[1] + 2)
    a, b = np.full(k, -1.0), np.log((counts[1] + 1) / (counts[0] + 1))
    best, da, db, share = np.full(k, np.inf), np.zeros(k), np.zeros(k), np.ones(k)
    for _ in range(s.max_iter):
        ta, tb = a + share * da, b + share * db

        def part(x, y, fold):
            score, positive = held(x, y, fold)
            t = np.where(positive, high, low)
            u = np.clip(ta * score + tb, -500, 500)
            p = _sigmoid(-u)
            h, g = p * (1 - p), t - p
            loss = t * u + np.logaddexp(0, -u)
            return {"s": np.stack([(score * score * h).sum(axis=0), (score * h).sum(axis=0), h.sum(axis=0), (score * g).sum(axis=0), g.sum(axis=0), loss.sum(axis=0)])}

        got = _sums(rows, d, part).get("s", np.zeros((6, k)))
        moved = False
        for c in range(k):
            haa, hab, hbb, ga, gb, value = got[:, c]
            if value > best[c] + 1e-12 and share[c] > 1e-6:
                share[c] /= 2
                moved = True
                continue
            moved = moved or best[c] - value > 1e-9 * max(abs(value), 1.0)
            a[c], b[c], best[c], share[c] = ta[c], tb[c], value, 1.0
            det = (haa + 1e-9) * (hbb + 1e-9) - hab * hab
            da[c], db[c] = -((hbb + 1e-9) * ga - hab * gb) / det, -((haa + 1e-9) * gb - hab * ga) / det
        if not moved:
            break
    return list(zip(a.tolist(), b.tolist()))


def fit(df: DataFrame, features: list[str], label: str, classes: list | None = None, settings: Settings | None = None) -> Machine:
    """Fit a machine on values, or on ``classes`` when given; rows with a missing feature or label are left out."""
    s, d = settings or Settings(), len(features)
    values = [col(f).cast("double") for f in features]
    if classes is None:
        y = col(label).cast("double")
    else:
        y = F.lit(None).cast("double")
        for i, name in enumerate(classes):
            y = F.when(col(label).cast("string") == str(name), F.lit(float(i))).otherwise(y)
    fold = F.pmod(F.xxhash64(*values), F.lit(s.folds)).cast("double")  # equal rows share a fold
    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], y.alias("y"), fold.alias("fold")).persist()
    try:
        gamma = s.gamma
        if gamma == "scale":  # the variance of all feature values taken together
            r = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.avg(v * v).alias(f"q{i}") for i, v in enumerate(values)]).first()
            mean = np.mean([r[f"m{i}"] or 0.0 for i in range(d)])
            spread = np.mean([r[f"q{i}"] or 0.0 for i in range(d)]) - mean ** 2
            gamma = 1 / (d * spread) if spread > 0 else 1.0
        rng = np.random.default_rng(s.seed)
        directions = rng.normal(size=(d, s.n_features)) * np.sqrt(2 * gamma)
        phase = rng.uniform(0, 2 * np.pi, s.n_features)
        if classes is None:
            machine = Machine(features, directions, phase, np.zeros((s.n_features + 1, 1)))

            def miss(score, t):
                r = score - t
                return np.sign(r) * np.maximum(np.abs(r) - s.epsilon, 0)

            machine.weights = _newton(rows, machine, lambda y: y[:, None], miss, s)
            return machine
        k = 1 if len(classes) == 2 else len(classes)
        targets = (lambda y: np.where(y == 1, 1.0, -1.0)[:, None]) if k == 1 else (lambda y: np.where(y[:, None] == np.arange(k), 1.0, -1.0))

        def hinge(score, t):
            return -t * np.maximum(1 - t * score, 0)

        blank = Machine(features, directions, phase, np.zeros((s.n_features + 1, k)), classes)
        machines = [Machine(features, directions, phase, _newton(rows, blank, targets, hinge, s, f), classes) for f in range(s.folds)]
        return Machine(features, directions, phase, _newton(rows, blank, targets, hinge, s), classes, _platt(rows, machines, targets, s, k))
    finally:
        rows.unpersist()


def predict(model: Machine, df: DataFrame, keep: list[str], digits: int = 4) -> DataFrame:
    """``__prediction__`` (the class of the best score, or the value) and, for classes, ``prob_<class>``; null where a feature is missing."""
    m = df.sparkSession.sparkContext.broadcast(model)
    d = len(model.features)
    rows = df.select(F.struct(*[col(c) for c in keep]).alias("keep"), *[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)])

    def run(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), dtype=float) for i in range(d)], axis=1)
            ok = np.isfinite(x).all(axis=1)
            score = m.value.scores(np.where(ok[:, None], x, 0.0))
            if model.classes is None:
                best, extra = score[:, 0], score
            else:
                best = (score[:, 0] > 0).astype(float) if score.shape[1] == 1 else score.argmax(axis=1).astype(float)
                extra = m.value.probabilities(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64(), mask=~ok), pa.array([list(e) if o else None for e, o in zip(extra, ok)], pa.list_(pa.float64()))],
                                             names=["keep", "best", "p"])

    scored = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, best double, p array<double>")
    kept = [F.col(f"keep.`{c}`").alias(c) for c in keep]
    if model.classes is None:
        return scored.select(*kept, F.col("best").alias("__prediction__"))
    names = F.array(*[F.lit(str(c)) for c in model.classes])
    return scored.select(*kept, F.when(F.col("best").isNotNull(), F.get(names, F.col("best").cast("int"))).alias("__prediction__"),
                         *[F.bround(F.get("p", F.lit(i)), digits).alias(f"prob_{c}") for i, c in enumerate(model.classes)])
