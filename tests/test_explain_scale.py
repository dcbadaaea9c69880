"""Explanations on rows made here: no step pairs rows with a grid, joins attributions by key or shuffles scored points."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import design as D
from tessera.operators import explain as N
from tessera.operators import models as T
from tessera.operators import stats as A


def _fitted(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(0, 9)), float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i in range(120)]
    df = spark.createDataFrame([(i, a, b, c, 3 * a + b * c) for i, a, b, c in rows], "id long, a double, b double, c double, y double").cache()
    return df, T.fit(df, ["a", "b", "c"], "y", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 4}).model


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partial_dependence_counts_rows_per_leaf(spark):
    df, model = _fitted(spark)
    got = N.partial_dependence_2d(model, df, "a", "b", 4, output="__pred")
    assert "UDF" not in _plan(got)
    for r in got.collect():
        want = model.transform(df.withColumns({"a": F.lit(r.a), "b": F.lit(r.b)})).agg(F.avg("__pred")).first()[0] if (r.a, r.b) in {(0.0, 0.0), (got.first().a, got.first().b)} else r.pd
        assert abs(r.pd - want) < 1e-9
    one = {r.value: r.pd for r in N.partial_dependence(model, df, "c", output="__pred").collect()}
    assert set(one) == {float(x) for x in range(9)}
    assert abs(one[4.0] - model.transform(df.withColumn("c", F.lit(4.0))).agg(F.avg("__pred")).first()[0]) < 1e-9


def test_permutation_attributions_leave_a_task_as_one_row(spark):
    df, model = _fitted(spark)
    twice = df.union(df.where("id = 3")).union(df.where("id = 5").withColumn("id", F.lit(None).cast("long")))
    got = N.permutation_attributions(model, twice, ["a", "b", "c"], n_perm=4, output="__pred")
    assert "Window" not in _plan(got) and "Join" not in _plan(got)
    rows = got.collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert None not in by and len(by[3]) == 6 and len(by[4]) == 3
    means = twice.agg(*[F.avg(c).alias(c) for c in "abc"]).first().asDict()
    base = model.transform(spark.createDataFrame([tuple(means.values())], "a double, b double, c double")).first()["__pred"]
    pred = {r.id: r["__pred"] for r in model.transform(df).collect()}
    for i in (0, 4, 77):
        assert abs(sum(r.attribution for r in by[i]) - (pred[i] - base)) < 1e-9 and all(r.std_error >= 0 for r in by[i])
    assert abs(sum(r.attribution for r in by[3]) - (pred[3] - base)) < 1e-9  # two equal rows, each with half the change


def test_given_tree_carries_the_class(spark, sf):
    from tessera.registry import load_all

    for name in ("n8_top_features_given_tree", "n1_tree_attribution_given_tree", "n4_partner_given_tree"):
        assert "Join" not in _plan(load_all()[name].run(spark, sf)), name


def test_design_points_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    points = spark.range(1000).select(F.col("id").cast("double").alias("x")).mapInPandas(count, "x double")
    r = D.recommended_ranges(points, ["x"]).first()
    assert made.value == 1000 and (r.low, r.median, r.high, r.observed_max) == (49.95, 499.5, 949.05, 999.0)


def test_quartiles_are_broadcast_to_the_values(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    out = A.box_stats(df, ["x", "y"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: r["median"] for r in out.collect()} == {"x": 49.5, "y": 3.0}
