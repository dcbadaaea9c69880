"""Leaf-wise boosting against a plain one-machine version of the same rules."""

import numpy as np
import pytest

from tessera.operators import boosting as B
from tessera.operators import models as T
from tessera.operators import trees as X


def grow(codes, g, h, s, bins):
    """Best-first growth with histograms computed afresh for every leaf: the rule itself."""
    def leaf(rows, depth):
        hist = np.zeros((len(codes), bins, 3))
        for f in range(len(codes)):
            hist[f, :, 0] = np.bincount(codes[f, rows], g[rows], bins)
            hist[f, :, 1] = np.bincount(codes[f, rows], h[rows], bins)
            hist[f, :, 2] = np.bincount(codes[f, rows], minlength=bins)
        total = hist[0].sum(axis=0)
        return rows, total, B.best_split(hist, total, s) if depth < s.max_depth else None, depth

    leaves = [leaf(np.arange(codes.shape[1]), 0)]
    while len(leaves) < s.num_leaves:
        i = max((i for i in range(len(leaves)) if leaves[i][2]), key=lambda i: leaves[i][2][0], default=None)
        if i is None:
            break
        rows, _, (_, f, code), depth = leaves.pop(i)
        left = codes[f, rows] <= code
        leaves += [leaf(rows[left], depth + 1), leaf(rows[~left], depth + 1)]
    out = np.zeros(codes.shape[1])
    for rows, total, _, _ in leaves:
        out[rows] = -s.learning_rate * total[0] / (total[1] + s.l2)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4)).round(1)
    x[::17, 1] = np.nan
    y = np.where(x[:, 0] > 0.2, 3 * x[:, 2], x[:, 3]) + np.where(np.isnan(x[:, 1]), 2, x[:, 1]) + rng.normal(size=900) * 0.1
    rows = [(i, *map(float, r), float(v), "abc"[int(v > 0) + int(v > 2)]) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double, k string").repartition(5)
    return df, x, y


@pytest.mark.parametrize("kind", ["values", "two", "many"])
def test_equals_plain_growth(spark, data, kind):
    df, x, y = data
    s = B.Settings(n_estimators=4, num_leaves=7, min_rows=15, learning_rate=0.3, l2=0.5 if kind == "values" else 0.0)
    label = y
    if kind == "values":
        model = B.fit(df, list("abcd"), "y", settings=s)
    else:
        label = (y > 0).astype(int) + ((y > 2).astype(int) if kind == "many" else 0)
        d = df if kind == "many" else df.selectExpr("id", "a", "b", "c", "d", "if(k = 'a', 'a', 'b') as k")
        model = B.fit(d, list("abcd"), "k", ["a", "b", "c"][:3 if kind == "many" else 2], s)
    cuts = B.bin_cuts(df, list("abcd"), s.max_bin)
    bins = max(map(len, cuts)) + 2
    codes = np.stack([np.where(np.isnan(x[:, f]), bins - 1, np.searchsorted(cuts[f], x[:, f])) for f in range(4)])
    scores = np.tile(model.base, (len(x), 1))
    for _ in range(4):
        g, h = B._derivatives(scores, label.astype(float), kind)
        scores = scores + np.stack([grow(codes, g[:, c], h[:, c], s, bins) for c in range(scores.shape[1])], axis=1)
    assert np.allclose(model.scores(x), scores, atol=1e-9)
    assert max(len(t.value) for ts in model.trees for t in ts) == 13


def test_learns_and_explains(spark, data):
    df, x, y = data
    f = T.fit(df, list("abcd"), "y", "LightGBM", {"n_estimators": 30})
    pred = {r["id"]: r["__prediction__"] for r in T.predict(f, df, ["id"]).collect()}
    assert 1 - sum((pred[i] - y[i]) ** 2 for i in range(900)) / ((y - y.mean()) ** 2).sum() > 0.9
    assert T.score(f, df, "r2") > 0.9 and T.feature_importance(f, spark).count() == 4
    phi = X.shapley_values(X.node_tables(f.boosted, spark), x)
    base = f.boosted.base[0] + sum(t.mean() for t in f.boosted.trees[0])
    assert np.allclose(phi.sum(axis=1) + base, [pred[i] for i in range(900)])


def test_many_classes(spark, data):
    df, x, y = data
    f = T.fit(df, list("abcd"), "k", "GradientBoostingClassifier", {"n_estimators": 8})
    out = T.predict(f, df, ["id", "k"])
    assert out.columns == ["id", "k", "__prediction__", "prob_a", "prob_b", "prob_c"]
    assert T.score(f, df, "accuracy") > 0.85 and T.score(f, df, "roc_auc") > 0.95
    assert all(abs(r.prob_a + r.prob_b + r.prob_c - 1) < 1e-3 for r in out.collect())


def test_odd_tables(spark, data):
    df, *_ = data
    none = B.fit(df.limit(0), ["a"], "y")
    assert none.trees == [[]] and B.predict(none, df, ["id"]).where("__prediction__ = 0").count() == 900
    constant = B.fit(df.selectExpr("1.0 as a", "y"), ["a"], "y", settings=B.Settings(n_estimators=3))
    assert constant.trees == [[]]


def test_symmetric_trees(spark, data):
    df, x, y = data
    s = B.Settings(n_estimators=3, max_depth=3, l2=3.0, symmetric=True, learning_rate=0.5)
    model = B.fit(df, list("abcd"), "y", settings=s)
    cuts = B.bin_cuts(df, list("abcd"), s.max_bin)
    scores = np.full(len(x), model.base[0])
    for done, tree in enumerate(model.trees[0], 1):
        assert len(tree.value) == 15
        cells = np.zeros(len(x), int)
        for _ in range(3):  # the cut of a level, tried one by one
            best = None
            for f in range(4):
                for cut in [*cuts[f], np.inf]:
                    after = cells * 2 + ~(x[:, f] <= cut)
                    gain = sum((scores - y)[after == k].sum() ** 2 / ((after == k).sum() + 3.0) for k in np.unique(after))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, after)
            cells = best[1]
        for k in np.unique(cells):
            own = cells == k
            scores[own] -= 0.5 * (scores - y)[own].sum() / (own.sum() + 3.0)
        assert np.allclose(scores, model.base[0] + sum(t.predict(x) for t in model.trees[0][:done]))


def test_text_features_as_ordered_statistics(spark, data):
    from pyspark.sql import functions as F
    from tessera.operators import target_stats as TS

    df, x, y = data
    f = T.fit(df, ["a", "k"], "y", "CatBoost", {"iterations": 10})
    assert T.score(f, df, "r2") > 0.6
    unknown = T.predict(f, df.limit(3).withColumn("k", F.lit("zzz")), ["id"])
    assert unknown.count() == 3
    rows = [("b", i, float(i % 5)) for i in range(300)] + [(None, 1000 + i, 2.0) for i in range(5)] + [("one", 2000, 9.0), ("b", 3000, None)]
    d = spark.createDataFrame(rows, "k string, id int, y double").repartition(4)
    prior = sum(r[2] for r in rows if r[2] is not None) / 306
    for size in (500_000, 7):
        TS.RANGE_ROWS, before = size, TS.RANGE_ROWS
        try:
            got = TS.ordered_statistics(d, "id", ["k"], "y", 2.0).withColumn("u", TS.hash_rank("id", 42, "permutation")).orderBy("u").collect()
        finally:
            TS.RANGE_ROWS = before
        seen = {}
        for r in got:
            s, n = seen.get(r.k, (0.0, 0))
            assert abs(r.k_stat - (s + 2 * prior) / (n + 2)) < 1e-9
            if r.y is not None:
                seen[r.k] = s + r.y, n + 1
        assert len(got) == len(rows)
