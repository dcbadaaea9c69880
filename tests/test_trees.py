"""Tree attributions against the definition: all subsets of features, and sums to the prediction."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tessera.operators import trees as X

FEATURES = [f"f{i}" for i in range(6)]


def value(tree, x, known, node=0):
    """Prediction with unknown features averaged over the training rows."""
    if tree.left[node] < 0:
        return tree.value[node]
    f, children = int(tree.feature[node]), (tree.left[node], tree.right[node])
    if f in known:
        return value(tree, x, known, children[0] if tree.goes_left(node, x[f:f + 1])[0] else children[1])
    return sum(tree.cover[c] / tree.cover[node] * value(tree, x, known, c) for c in children)


def brute(trees, x):
    d = len(x)
    out = np.zeros(d)
    for j in range(d):
        others = [k for k in range(d) if k != j]
        for r in range(d):
            w = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
            for s in itertools.combinations(others, r):
                out[j] += w * sum(value(t, x, {*s, j}) - value(t, x, set(s)) for t in trees)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6)).round(2)
    x[:, 5] = rng.integers(0, 4, 600)
    y = 3 * x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0.3, 2 * x[:, 3], -x[:, 4]) + (x[:, 5] == 2) * 4 + rng.normal(size=600) * 0.1
    rows = [(i, *map(float, r), float(v), float(int(v > 1) + int(v > 4))) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} double" for f in FEATURES) + ", y double, c double")
    return VectorAssembler(inputCols=FEATURES, outputCol="v").transform(df).persist(), x


def check(spark, model, scored, output, data, x, class_index=None):
    trees = X.node_tables(model, spark, class_index)
    phi = X.shapley_values(trees, x)
    want = np.array([r[0] for r in scored.orderBy("id").select(output).collect()])
    assert np.abs(phi.sum(axis=1) + sum(t.mean() for t in trees) - want).max() < 1e-9
    for i in (0, 17, 311):
        assert np.allclose(phi[i], brute(trees, x[i]), atol=1e-10)
    few = X.shapley_values(trees, x[:5])  # fewer rows than entries of a leaf's table
    assert np.allclose(few, phi[:5], atol=1e-12)
    return phi


def test_values(spark, data):
    df, x = data
    for est in (DecisionTreeRegressor(maxDepth=6), RandomForestRegressor(numTrees=7, maxDepth=5, seed=1), GBTRegressor(maxIter=6, maxDepth=4, seed=1)):
        model = est.setFeaturesCol("v").setLabelCol("y").fit(df)
        check(spark, model, model.transform(df), "prediction", df, x)


def test_class_probabilities_and_margins(spark, data):
    df, x = data
    for est in (DecisionTreeClassifier(maxDepth=5), RandomForestClassifier(numTrees=5, maxDepth=5, seed=1)):
        model = est.setFeaturesCol("v").setLabelCol("c").fit(df)
        for k in (0, 2):
            check(spark, model, model.transform(df), vector_to_array("probability")[k], df, x, k)
    two = df.withColumn("c", (F.col("c") > 0).cast("double"))
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1, featuresCol="v", labelCol="c").fit(two)
    check(spark, model, model.transform(two), vector_to_array("rawPrediction")[1], two, x)
    many = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, seed=1), featuresCol="v", labelCol="c").fit(df)
    check(spark, many, many.models[1].transform(df), vector_to_array(many.models[1].getRawPredictionCol())[1], df, x, 1)


def test_categories_and_long_form(spark, data):
    df, x = data
    index = VectorIndexer(inputCol="v", outputCol="w", maxCategories=6).fit(df)
    model = RandomForestRegressor(numTrees=4, maxDepth=5, seed=2, featuresCol="w", labelCol="y").fit(index.transform(df))
    trees = X.node_tables(model, spark)
    assert any(t.categories for t in trees)
    check(spark, model, model.transform(index.transform(df)), "prediction", df, x)
    got = X.tree_attributions(trees, df, FEATURES).toPandas()
    phi = X.shapley_values(trees, x)
    wide = got.pivot(index="id", columns="feature", values="attribution")[FEATURES].to_numpy()
    assert np.abs(wide - phi).max() < 1e-12 and len(got) == 3600
    assert np.allclose(got.pivot(index="id", columns="feature", values="value")[FEATURES].to_numpy(), x)


def test_empty_and_missing(spark, data):
    df, _ = data
    model = DecisionTreeRegressor(maxDepth=3, featuresCol="v", labelCol="y").fit(df)
    trees = X.node_tables(model, spark)
    assert X.tree_attributions(trees, df.limit(0), FEATURES).collect() == []
    odd = spark.createDataFrame([(None, *[None] * 6)], "id int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = X.tree_attributions(trees, odd, FEATURES).collect()
    assert len(got) == 6 and all(r.value is None and math.isfinite(r.attribution) for r in got)


def test_leaf_tables_are_made_once(monkeypatch):
    """Batches look their rows up in tables made before; leaves beyond the bound are worked out anew, to the same values."""
    tree = X.Tree(np.array([0, 1, 0, 0, 0, 0, 0]), np.array([0.5, 0.2, 0.7, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]),
                  np.array([10.0, 6, 4, 2, 4, 1, 3]), np.array([0, 0, 0, 1.0, 2, 3, 4]))
    x = np.random.default_rng(1).random((50, 2))
    made, real = [], X._shapley
    monkeypatch.setattr(X, "_shapley", lambda known, share: made.append(len(known)) or real(known, share))
    whole = X.Attributions([tree])
    assert len(made) == 4
    first, again = whole(x), whole(x[:7])
    assert len(made) == 4
    some = X.Attributions([tree], 10)
    assert len(some.tables) == 2 and (some(x) == first).all() and (first[:7] == again).all()
    assert first.sum(axis=1) == pytest.approx(tree.predict(x) - tree.mean())
