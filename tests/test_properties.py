"""Property checks for the rows-only operators."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import design as D
from tessera.operators import explain as N
from tessera.operators import models as T
from tessera.operators import splits as SP
from tessera.sources import views as V
from tessera.sources.tables import table


def test_kfold_disjoint_and_covering(spark, sf):
    c = V.chem_wide(spark, sf).select("id")
    f = SP.kfold(c, "id", 5)
    assert f.where((F.col("fold") < 0) | (F.col("fold") > 4)).count() == 0
    assert f.select("id").distinct().count() == c.count() == f.count()


def test_stratified_kfold_balanced(spark, sf):
    li = table(spark, sf, "lineitem")
    key = SP.row_key("l_orderkey", "l_linenumber", "l_partkey")
    f = SP.stratified_kfold(li, key, "l_returnflag", 5)
    sizes = {(r[0], r[1]): r[2] for r in f.groupBy("l_returnflag", "fold").count().collect()}
    for cls in {k[0] for k in sizes}:
        v = [sizes.get((cls, k), 0) for k in range(5)]
        assert max(v) - min(v) <= max(3, 0.1 * sum(v) / 5)
    with pytest.raises(ValueError):
        SP.stratified_kfold(li, key, "l_returnflag", 5, task="regression")


def test_train_test_split_adds_up(spark, sf):
    c = V.chem_wide(spark, sf).select("id")
    s = SP.train_test(c, "id", 0.2)
    n_test = s.where("is_test").count()
    assert n_test + s.where("not is_test").count() == c.count()
    assert 0.1 < n_test / c.count() < 0.3


def test_loo_guard(spark, sf):
    with pytest.raises(ValueError):
        SP.leave_one_out(table(spark, sf, "orders"), "o_orderkey")


def test_probabilities_sum_to_one(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    f = T.fit(e, [f"e{i}" for i in range(8)], "label", "LogisticRegression")
    p = T.predict(f, e, keep=["vec_id"], digits=12)
    probs = [c for c in p.columns if c.startswith("prob_")]
    tot = p.select(sum((F.col(c) for c in probs), F.lit(0.0)).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert abs(tot[0] - 1) < 1e-6 and abs(tot[1] - 1) < 1e-6


def test_design_points_respect_bounds_and_sum(spark):
    u = D.sample_uniform(spark, {"a": (1.0, 2.0), "b": (5.0, 5.0)}, 2000)
    r = u.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert 1.0 <= r[0] and r[1] <= 2.0 and r[2] == r[3] == 5.0
    d = D.sample_dirichlet(spark, ["x", "y", "z"], 100.0, 2000)
    s = d.select((F.col("x") + F.col("y") + F.col("z")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(s[0] - 100) < 1e-9 and abs(s[1] - 100) < 1e-9
    g = D.sample_dirichlet(spark, ["x", "y"], 10.0, 500, alpha=2.0)
    s2 = g.select((F.col("x") + F.col("y")).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(s2[0] - 10) < 1e-9 and abs(s2[1] - 10) < 1e-9


def _linear_model(spark):
    rows = [(i, float(i % 7), float(i % 5), 3.0 * (i % 7) - 2.0 * (i % 5) + 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    return df, T.fit(df, ["a", "b"], "y", "LinearRegression")


def test_pdp_of_linear_model_is_a_line(spark):
    df, f = _linear_model(spark)
    pd_ = sorted(N.partial_dependence(f.model, df, "a", output="__pred").collect())
    xs, ys = [r[0] for r in pd_], [r[1] for r in pd_]
    slopes = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    assert all(abs(s - 3.0) < 1e-6 for s in slopes)


def test_attributions_sum_to_prediction_minus_baseline(spark):
    df, f = _linear_model(spark)
    attr = N.permutation_attributions(f.model, df, ["a", "b"], "id", n_perm=4, output="__pred")
    tot = attr.groupBy("id").agg(F.sum("attribution").alias("s"))
    means = df.agg(F.avg("a"), F.avg("b")).first()
    base = 3.0 * means[0] - 2.0 * means[1] + 1.0
    pred = f.model.transform(df).select("id", "__pred")
    bad = tot.join(pred, "id").where(F.abs(F.col("s") - (F.col("__pred") - F.lit(base))) > 1e-6).count()
    assert bad == 0
    lin = N.linear_attributions(df, ["a", "b"], {"a": 3.0, "b": -2.0}, "id")
    j = attr.join(lin.withColumnRenamed("attribution", "exact"), ["id", "feature"])
    assert j.where(F.abs(F.col("attribution") - F.col("exact")) > 1e-6).count() == 0


def test_narrow_quantiles_equal_percentile(spark, sf):
    from tessera.functions.quantiles import exact_quantiles
    li = table(spark, sf, "lineitem")
    cols, probs = ["l_quantity", "l_extendedprice", "l_discount"], [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = exact_quantiles(li, cols, probs)
    ref = li.agg(*[F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in cols]).first()
    for c in cols:
        assert all(abs(a - b) <= 1e-9 * max(1.0, abs(b)) for a, b in zip(got[c], ref[c]))
    ids = spark.range(100_000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("b"), F.lit(7).alias("c"),
                                      F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.exp(F.col("id") / 1000)).alias("d"),
                                      F.when(F.col("id") > 60_000, F.lit(float("nan"))).otherwise(F.col("id")).alias("e"))
    got = exact_quantiles(ids, ids.columns, probs)
    ref = ids.agg(*[F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs])).alias(c) for c in ids.columns]).first()
    for c in ids.columns:
        assert all(a == b or (a != a and b != b) or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got[c], ref[c])), c
    tiny = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert exact_quantiles(tiny, ["x"], [0.5, 0.25])["x"] == [2.0, 1.5]


def test_knn_blocks_equal_brute_force(spark, monkeypatch):
    import numpy as np
    from tessera.operators import models as T
    monkeypatch.setattr(T, "KNN_BLOCK", 40)
    rng = np.random.default_rng(3)
    X, y = rng.normal(size=(150, 3)).round(2), rng.integers(0, 3, 150)
    train = [(*map(float, r), str(c)) for r, c in zip(X, y)] + [(9.0, 9.0, 9.0, "copy")] * 60 + [(0.0, 0.0, None, None)]
    test = [(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(90, 3)))] + [(90, 8.9, 9.0, 9.0), (91, None, None, None)]
    f = T.fit(spark.createDataFrame(train, "a double, b double, c double, y string"), ["a", "b", "c"], "y", "KNeighborsClassifier")
    queries = spark.createDataFrame(test, "id int, a double, b double, c double")
    got = {r["id"]: r["__prediction__"] for r in T.predict(f, queries, keep=["id"]).collect()}
    known = [t for t in train if t[3] is not None]
    for i, *v in test:
        near = sorted((sum((p - (q or 0.0)) ** 2 for p, q in zip(t[:3], v)), t[3]) for t in known)[:5]
        votes = [c for _, c in near]
        assert got[i] == min(votes, key=lambda c: (-votes.count(c), c)), i


def test_left_out_group_fit_equals_direct_fit(spark):
    import numpy as np
    from tessera.operators import splits as SP
    rng = np.random.default_rng(4)
    rows = [(int(g), float(a), float(b), float(2 * a - b + g + rng.normal())) for g, a, b in
            zip(rng.integers(0, 4, 80), rng.normal(size=80), rng.normal(size=80))]
    rows.append((1, None, 1.0, 1.0))
    out = SP.logo_linear(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["a", "b"], "y", "g").collect()
    assert len(out) == 80
    for r in out:
        rest = [x for x in rows[:80] if x[0] != r["g"]]
        beta = np.linalg.lstsq(np.array([[1, x[1], x[2]] for x in rest]), np.array([x[3] for x in rest]), rcond=None)[0]
        assert abs(r["prediction"] - (beta[0] + beta[1] * r["a"] + beta[2] * r["b"])) < 1e-9


def test_level_names_stay_apart(spark):
    from tessera.operators import clean as M
    out = M.method_one_hot(spark.createDataFrame([("a-b",), ("a b",), ("x" * 41 + "1",), ("x" * 41 + "2",), (None,)], "m string"), "m", "p_")
    flags = [c for c in out.columns if c != "m"]
    assert len(flags) == 5 and all(sum(r[c] for c in flags) == 1 for r in out.collect())
