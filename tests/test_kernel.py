"""Kernel machines: optimality of the fit, accuracy no linear machine reaches, calibrated probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernel as K
from tessera.operators import models as T


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(1)
    r = np.repeat([0.5, 1.5, 2.6], 200)
    t = rng.uniform(0, 2 * np.pi, 600)
    x = np.stack([r * np.cos(t), r * np.sin(t)], axis=1) + rng.normal(size=(600, 2)) * 0.12
    rows = [(i, *map(float, p), "abc"[i // 200], float(np.sin(2 * p[0]) + p[1] ** 2)) for i, p in enumerate(x)]
    rows += [(900, None, 1.0, "a", 1.0), (901, 1.0, 1.0, None, None)]
    return spark.createDataFrame(rows, "id int, u double, v double, k string, y double").repartition(3), x


def test_classes_and_probabilities(spark, rings):
    df, x = rings
    f = T.fit(df, ["u", "v"], "k", "SVC")
    out = T.predict(f, df, ["id", "k"]).where("id < 900").toPandas()
    assert (out["__prediction__"] == out.k).mean() > 0.97
    p = out[["prob_a", "prob_b", "prob_c"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)
    own = p[np.arange(600), out.k.map("abc".index)]
    assert own.mean() > 0.85 and T.score(f, df.where("k is not null and u is not null"), "roc_auc") > 0.99
    assert T.predict(f, df.where("id = 900"), ["id"]).first()["__prediction__"] is None


def test_weights_are_the_minimum(spark, rings):
    df, x = rings
    two = df.where("id < 400")
    s = K.Settings(n_features=40, C=2.0, max_iter=60, tol=1e-10)
    m = K.fit(two, ["u", "v"], "k", ["a", "b"], s)
    z, t = m.map(x[:400]), np.where(np.arange(400) >= 200, 1.0, -1.0)

    def objective(w):
        return 0.5 * (w[:-1] ** 2).sum() + 2.0 * (np.maximum(1 - t * (z @ w), 0) ** 2).sum()

    w = m.weights[:, 0]
    rng = np.random.default_rng(0)
    assert all(objective(w) <= objective(w + rng.normal(size=len(w)) * e) + 1e-9 for e in (1e-4, 1e-2, 1) for _ in range(30))


def test_probabilities_are_calibrated(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, 3000)
    p = 1 / (1 + np.exp(-3 * np.sin(2 * x)))
    rows = [(float(a), "yes" if b else "no") for a, b in zip(x, rng.uniform(size=3000) < p)]
    df = spark.createDataFrame(rows, "x double, k string")
    f = T.fit(df, ["x"], "k", "SVC")
    got = T.predict(f, spark.createDataFrame([(float(a),) for a in x[:500]], "x double"), ["x"]).toPandas()
    assert np.abs(got.prob_yes - 1 / (1 + np.exp(-3 * np.sin(2 * got.x)))).mean() < 0.08


def test_values(spark, rings):
    df, x = rings
    f = T.fit(df, ["u", "v"], "y", "SVR")
    out = T.predict(f, df.where("id < 900"), ["id", "y"]).toPandas()
    assert 1 - ((out.y - out["__prediction__"]) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum() > 0.95
