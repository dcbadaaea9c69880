"""Guided search against uniform points; local trend against a brute-force fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search as S
from tessera.operators import trend as L
from tessera.operators.design import sample_uniform

BOUNDS = {"a": (-2.0, 3.0), "b": (10.0, 20.0), "c": (0.0, 1.0)}


def objective(df):
    bump = F.exp(-F.pow((F.col("a") - 1.7) / 0.8, 2) - F.pow((F.col("b") - 12.5) / 2, 2) - F.pow((F.col("c") - 0.8) / 0.3, 2))
    return df.withColumn("objective_score", 5 * bump + 0.3 * F.sin("a"))


def test_guided_search_beats_uniform_points(spark):
    got = [S.guided_search(spark, BOUNDS, objective, S.Settings(seed=k)) for k in (1, 2)]
    for k, out in zip((1, 2), got):
        rows = out.collect()
        assert len(rows) == 50 and [r.round for r in rows].count(0) == 20
        same = objective(sample_uniform(spark, BOUNDS, 50, k)).agg(F.max("objective_score")).first()[0]
        assert max(r.objective_score for r in rows) > max(same, 4.5)
        batch = np.array([[r.a, r.b, r.c] for r in rows if r.round == 1])
        assert min(np.abs(batch[i] - batch[j]).max() for i in range(5) for j in range(i)) > 1e-3
    assert S.guided_search(spark, BOUNDS, objective, S.Settings(seed=1)).collect() == got[0].collect()


def test_points_without_score_and_constant_features(spark):
    out = S.guided_search(spark, {"a": (0.0, 1.0), "k": (2.0, 2.0)}, lambda d: d.withColumn("objective_score", F.when(F.col("a") > 0.3, -F.col("a"))), S.Settings(rounds=2, candidates=500))
    rows = out.collect()
    assert len(rows) == 30 and {r.k for r in rows} == {2.0} and any(r.objective_score is None for r in rows)
    none = S.guided_search(spark, {"a": (0.0, 1.0)}, lambda d: d.withColumn("objective_score", F.lit(None).cast("double")), S.Settings(rounds=2, candidates=500))
    assert none.count() == 20


def brute(x, y, frac, robust=3):
    k = min(len(x), max(2, int(frac * len(x) + 1e-10)))
    r, fit = np.ones(len(x)), {}
    for step in range(robust + 1):
        for g in np.unique(x):
            d = np.abs(x - g)
            h = np.sort(d)[k - 1]
            w = r * (np.where(d < h, (1 - (d / h) ** 3) ** 3, 0) if h > 0 else d == 0)
            if w.sum() == 0:
                continue
            m, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            var = (w * (x - m) ** 2).sum()
            fit[g] = my + ((w * (x - m) * (y - my)).sum() / var if var > 1e-12 * h * h * w.sum() else 0) * (g - m)
        e = np.abs(y - np.array([fit[v] for v in x]))
        med = np.median(e)
        if not med:
            break
        r = np.where(e < 6 * med, (1 - (e / (6 * med)) ** 2) ** 2, 0)
    return fit


@pytest.mark.parametrize("frac, values", [(0.4, 60), (0.1, 400)])
def test_trend_equals_brute_force(spark, frac, values):
    rng = np.random.default_rng(values)
    x = rng.integers(0, values, 2000) / 7
    y = np.sin(x / 8) + rng.normal(size=2000) * 0.2
    y[::50] += 8
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, float("nan"))], "x double, y double").repartition(4)
    got = L.local_trend(df, "x", "y", frac, points=values)
    want = brute(x, y, frac)
    rows = got.collect()
    assert [r.x for r in rows] == sorted(want) and np.allclose([r.trend for r in rows], [want[r.x] for r in rows], atol=1e-8)


def test_trend_at_quantiles_and_odd_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1500)
    df = spark.createDataFrame([(float(a), float(3 * a + 1)) for a in x], "x double, y double")
    rows = L.local_trend(df, "x", "y", points=25).collect()
    assert len(rows) == 25 and all(abs(r.trend - (3 * r.x + 1)) < 1e-6 for r in rows)
    assert L.local_trend(df.limit(0), "x", "y").collect() == []
    one = L.local_trend(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double"), "x", "y").collect()
    assert [(r.x, r.trend) for r in one] == [(1.0, 3.0)]
