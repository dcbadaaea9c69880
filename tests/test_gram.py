"""Validation from moments against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gram as G
from tessera.operators import models as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4)) * [1, 10, 0.1, 1] + [0, 1e4, 5, 0]
    x[:, 3] = x[:, 0] * 2 - 1  # collinear
    y = x[:, 0] * 3 - x[:, 1] + rng.normal(size=500)
    rows = [(i, *map(float, r), float(v), i % 5) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(1000, None, 1.0, 1.0, 1.0, 1.0, 0), (1001, 1.0, 1.0, 1.0, float("nan"), 1.0, 1)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, fold int"), x, y


def ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    coef = np.linalg.lstsq((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my), rcond=None)[0]
    return lambda z: my + (z - mx) @ coef


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_folds_equal_single_fits(frame, alpha):
    df, x, y = frame
    got = G.held_out(G.moments(df, list("abcd"), "y", ["fold"]), [alpha])
    mae = G.mean_absolute_errors(df, list("abcd"), "y", "fold", {k: f for k, _, _, f in got})
    fold = np.arange(500) % 5
    assert [k for k, *_ in got] == list(range(5))
    for k, _, s, _ in got:
        p = ridge(x[fold != k], y[fold != k], alpha)(x[fold == k])
        t = y[fold == k]
        assert np.isclose(s["r2"], 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rtol=1e-6)
        assert np.isclose(s["mse"], ((t - p) ** 2).mean(), rtol=1e-6) and np.isclose(mae[k], np.abs(t - p).mean(), rtol=1e-6)


def test_validation_functions_use_one_scan(spark, frame):
    df, x, y = frame
    res = T.run_validation(df.na.drop(), list("abc"), "y", "Ridge", fold_col="fold", metric="r2", params={"alpha": 2.0})
    p = [ridge(x[np.arange(500) % 5 != k][:, :3], y[np.arange(500) % 5 != k], 2.0) for k in range(5)]
    for k in range(5):
        t, q = y[np.arange(500) % 5 == k], p[k](x[np.arange(500) % 5 == k][:, :3])
        assert np.isclose(res["scores"][k], 1 - ((t - q) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rtol=1e-6)
    out = {r.metric: r for r in T.cross_validate(df, list("abc"), "y", "LinearRegression", "fold").collect()}
    assert set(out) == {"r2", "neg_mse", "neg_mae"} and len(out["r2"]["values"]) == 5
    model, grid = T.grid_search(df.na.drop(), list("abc"), "y", "Ridge", "fold")
    assert [g[0] for g in grid] == ["alpha=0.1", "alpha=1", "alpha=10", "alpha=100"] and model.features == list("abc")
    curve = T.learning_curve(df.na.drop(), list("abc"), "y", "LinearRegression", "fold", "id").orderBy("size").collect()
    assert len(curve) == 8 and np.isclose(curve[-1]["size"], 1.0)
    assert np.isclose(curve[-1].valid_mean, T.run_validation(df.na.drop(), list("abc"), "y", "LinearRegression", fold_col="fold", metric="r2")["mean"])


def test_roc_auc_of_classes(spark, frame):
    df, x, y = frame
    d = df.na.drop().withColumn("label", F.when(F.col("a") + F.col("c") / 5 > 1.2, "yes").otherwise("no"))
    got = {r.metric: r["mean"] for r in T.cross_validate(d, ["a", "c"], "label", "LogisticRegression", "fold").collect()}
    assert set(got) == {"accuracy", "f1", "roc_auc"} and got["roc_auc"] > 0.95
    three = d.withColumn("label", F.when(F.col("a") > 0.7, "x").when(F.col("a") > -0.4, "y").otherwise("z"))
    f = T.fit(three, ["a"], "label", "LogisticRegression")
    assert 0.7 < T.score(f, three, "roc_auc") <= 1


def test_empty(spark, frame):
    df, *_ = frame
    with pytest.raises(ValueError):
        G.together(G.moments(df.limit(0), ["a"], "y", ["fold"]).values())
