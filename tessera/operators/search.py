"""Model-guided search of a design space.

The objective is learnt while it is searched: a Bayesian linear regression over
random Fourier features (a Gaussian process with a Gaussian kernel in a bounded
number of numbers) is fitted to all points scored so far, from one aggregate.
Candidates are drawn anew each round by ``spark.range`` over the cluster; tasks
compute their mean, spread and expected improvement and keep a few each. From the
short list a batch is chosen one by one: each chosen point lowers the spread of
the others near it, so that a batch does not crowd together. The batch is scored
in one call and joins the known points. Everything follows from the seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .design import sample_uniform
from .kernel import Machine


@dataclass
class Settings:
    """``n_start`` uniform points, then ``rounds`` batches of ``batch`` points out of ``candidates`` each."""

    n_start: int = 20
    rounds: int = 6
    batch: int = 5
    candidates: int = 20_000
    n_features: int = 200
    width: float = 0.35
    noise: float = 1e-3
    shortlist: int = 400
    seed: int = 42


def _posterior(x: np.ndarray, y: np.ndarray, space: Machine, s: Settings) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and covariance of the weights, and the centre and scale of the objective."""
    centre, scale = float(y.mean()), float(y.std()) or 1.0
    z = space.map(x)[:, :-1]
    cov = np.linalg.inv(z.T @ z / s.noise + np.eye(z.shape[1]))
    return cov @ z.T @ ((y - centre) / scale) / s.noise, cov, centre, scale


def _improvement(mean: np.ndarray, spread: np.ndarray, best: float) -> np.ndarray:
    """Expected improvement over ``best`` of normal values."""
    u = (mean - best) / np.maximum(spread, 1e-12)
    density = np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
    share = 0.5 * (1 + np.vectorize(math.erf)(u / math.sqrt(2)))
    return (mean - best) * share + spread * density


def choose_batch(z: np.ndarray, mean: np.ndarray, cov: np.ndarray, best: float, n: int, noise: float) -> list[int]:
    """``n`` rows of ``z`` one by one, each with the greatest expected improvement after those before it have been seen."""
    chosen, cov = [], cov.copy()
    for _ in range(min(n, len(z))):
        spread = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, cov, z), 0))
        gain = _improvement(mean, spread, best)
        gain[chosen] = -np.inf
        i = int(gain.argmax())
        chosen.append(i)
        v = cov @ z[i]
        cov -= np.outer(v, v) / (noise + z[i] @ v)  # what seeing the point would do to the spread
    return chosen


def guided_search(spark: SparkSession, bounds: dict[str, tuple], score: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> DataFrame:
    """(id, round, features..., objective_score) of every scored point; larger scores are better.

    ``score`` takes a table (id, features...) and returns it with
    ``objective_score``. Points without a finite score are known but not learnt
    from. Features whose bounds are equal stay constant.
    """
    s, names = settings or Settings(), list(bounds)
    low = np.array([bounds[c][0] for c in names], float)
    span = np.array([max(bounds[c][1] - bounds[c][0], 1e-12) for c in names], float)
    rng = np.random.default_rng(s.seed)
    space = Machine(names, rng.normal(size=(len(names), s.n_features)) / s.width, rng.uniform(0, 2 * np.pi, s.n_features), np.zeros((0, 1)))
    known: list[tuple] = []

    def ask(points: DataFrame, step: int) -> None:  # a batch: bounded by the settings
        for r in sorted(score(points).select("id", *names, "objective_score").collect(), key=lambda r: r["id"]):
            known.append((len(known), step, *(float(r[c]) for c in names), None if r["objective_score"] is None else float(r["objective_score"])))

    ask(sample_uniform(spark, bounds, s.n_start, s.seed), 0)
    for step in range(1, s.rounds + 1):
        scored = [r for r in known if r[-1] is not None and math.isfinite(r[-1])]
        if not scored:
            break
        x, y = (np.array([r[2:-1] for r in scored]) - low) / span, np.array([r[-1] for r in scored])
        w, cov, centre, scale = _posterior(x, y, space, s)
        best = (y.max() - centre) / scale

        def run(batches, w=w, cov=cov, best=best):
            for batch in batches:
                points = np.stack([np.asarray(c, float) for c in batch.columns[1:]], axis=1)
                z = space.map((points - low) / span)[:, :-1]
                gain = _improvement(z @ w, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, cov, z), 0)), best)
                top = np.argsort(-gain, kind="stable")[:s.shortlist]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(top)), pa.array(gain[top]), *(c.take(pa.array(top)) for c in batch.columns[1:])],
                                                 names=["id", "gain", *names])

        drawn = sample_uniform(spark, bounds, s.candidates, s.seed + step)
        few = drawn.mapInArrow(run, "id bigint, gain double, " + ", ".join(f"`{c}` double" for c in names)).orderBy(F.desc("gain"), "id").limit(s.shortlist).collect()
        points = np.array([[r[c] for c in names] for r in few], float)
        z = space.map((points - low) / span)[:, :-1]
        picked = points[choose_batch(z, z @ w, cov, best, s.batch, s.noise)]
        ask(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(picked)], "id bigint, " + ", ".join(f"`{c}` double" for c in names)), step)
    return spark.createDataFrame(known, "id bigint, round int, " + ", ".join(f"`{c}` double" for c in names) + ", objective_score double")
