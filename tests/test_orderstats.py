"""Order statistics by group against sorted lists; exact splits against counts by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import orderstats as O
from tessera.operators import splits as SP
from tessera.operators import stats as A


def _frame(spark):
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1) * 10 ** rng.randint(-12, 12)) for _ in range(9000)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(3000)]
    rows += [(None, rng.uniform(-1, 1)) for _ in range(700)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, math.nan, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, None)]
    rows += [("close", 1.0 + k * 2.0 ** -52) for k in range(600)]
    rows += [("one", 7.5), ("none", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6)


@pytest.mark.parametrize("list_rows, cells", [(4096, 4096), (50, 8), (1, 64)])
def test_order_statistics_equal_sorting(spark, monkeypatch, list_rows, cells):
    monkeypatch.setattr(O, "LIST_ROWS", list_rows)
    monkeypatch.setattr(O, "CELLS", cells)
    rows, df = _frame(spark)
    if cells == 64:  # many rounds: a smaller table
        rows = [r for r in rows if r[0] in ("close", "odd", "one")][:200]
        df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r["rank"]): (r.n, r.value) for r in O.order_statistics(
        df, ["g"], "x", lambda n: F.array(F.lit(0), (n / 3).cast("bigint"), (n / 2).cast("bigint"), n - 1, n + 5)).collect()}
    for g in {g for g, x in rows if x is not None}:
        v = sorted((x for h, x in rows if h == g and x is not None), key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))
        for r in {0, len(v) // 3, len(v) // 2, len(v) - 1}:
            n, value = got.pop((g, r))
            assert n == len(v) and (value == v[r] or math.isnan(value) and math.isnan(v[r])), (g, r)
    assert not got


def test_whole_numbers_and_no_groups(spark, monkeypatch):
    monkeypatch.setattr(O, "LIST_ROWS", 10)
    rng = random.Random(1)
    v = sorted([rng.randrange(-2 ** 60, 2 ** 60) for _ in range(2000)] + [2 ** 62 + k for k in range(40)] + [-2 ** 63, 2 ** 63 - 1])
    df = spark.createDataFrame([(x,) for x in v], "x bigint")
    ranks = [0, 1, 700, 2001, 2010, 2030, len(v) - 1, len(v)]
    got = O.order_statistics(df, [], "x", spark.createDataFrame([(r,) for r in ranks], "rank int")).collect()
    assert sorted((r["rank"], r.value) for r in got) == [(r, v[r]) for r in ranks[:-1]]
    assert O.order_statistics(df.limit(0), [], "x", lambda n: F.array(F.lit(0))).collect() == []


def test_group_quantiles(spark):
    rows, df = _frame(spark)
    got = {r.g: r for r in O.group_quantiles(df.where("g is null or g != 'odd'"), ["g"], "x", [0, 0.1, 0.5, 0.77, 1]).collect()}
    for g, r in got.items():
        v = [x for h, x in rows if h == g and x is not None]
        assert r.n == len(v) and np.allclose(r.q, np.quantile(v, [0, 0.1, 0.5, 0.77, 1]), rtol=1e-12)
    assert set(got) == {"hot", "ties", None, "close", "one"}


def test_box_stats_by_class_keeps_no_value_map(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    got = {r.group: r for r in A.box_stats(li, ["l_extendedprice"], by="l_returnflag").collect()}
    pdf = li.toPandas()
    for g, own in pdf.groupby("l_returnflag"):
        assert np.allclose([got[g].q1, got[g].median, got[g].q3], own.l_extendedprice.astype(float).quantile([0.25, 0.5, 0.75]))
    plan = A.box_stats(li, ["l_extendedprice"], by="l_returnflag")._jdf.queryExecution().toString()
    assert "percentile(" not in plan


@pytest.mark.parametrize("counts", [{"a": 50, "b": 33, "c": 7, None: 11}, {"a": 3, "b": 1, "c": 1}, {"a": 1000, "b": 2}])
def test_stratified_sizes_to_the_row(spark, counts):
    df = spark.createDataFrame([(i, c) for c, k in counts.items() for i in range(k)], "i int, c string").withColumn("key", F.concat_ws("|", "c", "i"))
    n = sum(counts.values())
    got = SP.stratified_train_test(df, "key", "c", 0.2)
    assert got.columns == [*df.columns, "is_test"]
    test = {r.c: r["count"] for r in got.where("is_test").groupBy("c").count().collect()}
    assert sum(test.values()) == math.ceil(0.2 * n)
    assert all(abs(test.get(c, 0) - 0.2 * k) < 1 + 0.2 for c, k in counts.items())
    folds = {(r.c, r.fold): r["count"] for r in SP.stratified_kfold(df, "key", "c", 4).groupBy("c", "fold").count().collect()}
    for c, k in counts.items():
        own = [folds.get((c, i), 0) for i in range(4)]
        assert sum(own) == k and max(own) - min(own) <= 1
    whole = [sum(m for (_, f), m in folds.items() if f == i) for i in range(4)]
    assert max(whole) - min(whole) <= 1


def test_exact_plain_split_and_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert SP.train_test(df, "k", 0.2, exact=True).where("is_test").count() == 21
    sizes = [r["count"] for r in SP.kfold(df, "k", 5, exact=True).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [21, 21, 21, 20, 20]
    again = SP.kfold(df.repartition(7), "k", 5, exact=True).orderBy("k").collect()
    assert again == SP.kfold(df, "k", 5, exact=True).orderBy("k").collect()
    assert SP.train_test(df.limit(0), "k", exact=True).collect() == []


@pytest.mark.parametrize("list_rows, accuracy", [(4096, 10_000), (20, 100), (1, 100)])
def test_column_quantiles_by_rounds(spark, monkeypatch, list_rows, accuracy):
    from tessera.functions import quantiles as Q

    monkeypatch.setattr(Q, "LIST_ROWS", list_rows)
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.choice([1, 1, 2, 3])), rng.choice([None, 5.0]), math.inf if i % 7 == 0 else rng.random(), None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    probs = [0, 0.01, 0.25, 0.5, 0.75, 1]
    got = Q.exact_quantiles(df, list("abcde"), probs)
    for j, c in enumerate("abcd"):
        v = sorted(r[j] for r in rows if r[j] is not None)
        h = [(len(v) - 1) * p for p in probs]
        want = [v[math.floor(k)] if k % 1 == 0 or v[math.floor(k)] == v[math.ceil(k)] else v[math.floor(k)] * (1 - k % 1) + v[math.ceil(k)] * (k % 1) for k in h]
        assert got[c] == pytest.approx(want), c
    assert got["e"] == [None] * 6 and Q.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
