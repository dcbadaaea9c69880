"""Forests keep each row's node of every tree where that fits in memory, and read their input once."""
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import models as T


def _rows(spark, parts):
    u = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(3)]
    d = spark.range(0, 400, 1, parts).select(*[x.alias(n) for x, n in zip(u, "abc")])
    return d.withColumn("y", 3 * F.col("a") - F.col("b")).withColumn("k", F.when(F.col("c") < 0.5, "u").otherwise("v"))


@pytest.mark.parametrize("name, plain, label", [("RandomForestRegressor", RandomForestRegressor, "y"), ("RandomForestClassifier", RandomForestClassifier, "k")])
def test_forest_keeps_node_ids_and_its_trees(spark, name, plain, label):
    parts = 2 * spark.sparkContext.defaultParallelism
    df = _rows(spark, parts).select("a", "b", "c", label)
    got = T.fit(df, ["a", "b", "c"], label, name, {"n_estimators": 7, "max_depth": 6}).model
    model = got.stages[-1]
    assert model.getOrDefault("cacheNodeIds")
    ready = df
    for stage in got.stages[:-1]:
        ready = stage.transform(ready)
    walked = plain(numTrees=7, maxDepth=6, seed=T.SEED, featuresCol="__features", labelCol="__label" if label == "k" else "y", cacheNodeIds=False).fit(ready)
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in walked.trees]


def test_node_ids_are_not_kept_beyond_storage_memory(spark):
    assert T._node_ids_fit(spark.sparkContext, 1000, 100)
    assert not T._node_ids_fit(spark.sparkContext, 10 ** 10, 100)


@pytest.mark.parametrize("wide", [False, True])
def test_fit_computes_its_input_once(spark, wide):
    sc = spark.sparkContext
    seen = sc.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    parts = 2 * sc.defaultParallelism if wide else 1
    df = _rows(spark, parts).select("a", "b", "y").mapInPandas(count, "a double, b double, y double").groupBy("a", "b").agg(F.avg("y").alias("y"))
    n = _rows(spark, parts).count()
    T.fit(df, ["a", "b"], "y", "RandomForestRegressor", {"n_estimators": 3, "max_depth": 3})
    assert seen.value == n
