"""Pruned nearest neighbours: the vote of all pairs, from a small part of the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models as T


def vote(train, labels, q, k):
    d = ((train - q) ** 2).sum(axis=1)
    order = sorted(range(len(train)), key=lambda i: (d[i], labels[i]))[:k]
    counts = {}
    for i in order:
        counts[labels[i]] = counts.get(labels[i], 0) + 1
    return min(counts, key=lambda c: (-counts[c], c))


@pytest.mark.parametrize("cell, block", [(20, 8192), (20, 7), (10 ** 6, 8192)])
def test_equals_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(T, "KNN_CELL", cell)
    monkeypatch.setattr(T, "KNN_BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 3)) * 10
    x = (centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 3))).round(1)
    x[:60] = x[0]                                   # copies
    labels = [str(v) for v in rng.integers(0, 4, 500)]
    q = np.concatenate([x[:40], rng.normal(size=(60, 3)) * 12]).round(1)
    schema = "id int, a double, b double, c double, k string"
    train = spark.createDataFrame([(i, *map(float, r), k) for i, (r, k) in enumerate(zip(x, labels))] + [(900, 0.0, 0.0, 0.0, None)], schema)
    asked = spark.createDataFrame([(i, *map(float, r), None) for i, r in enumerate(q)], schema)
    for k in (1, 5, 70):
        f = T.fit(train, ["a", "b", "c"], "k", "KNeighborsClassifier", {"n_neighbors": k})
        got = {r["id"]: r["__prediction__"] for r in T.predict(f, asked, ["id"]).collect()}
        assert got == {i: vote(x, labels, r, k) for i, r in enumerate(q)}
    assert [r["__prediction__"] for r in T.predict(T.fit(train.where("k is null"), ["a"], "k", "KNeighborsClassifier"), asked.limit(2), ["id"]).collect()] == [None, None]


def test_few_cells_are_seen(spark, monkeypatch):
    monkeypatch.setattr(T, "KNN_CELL", 25)
    rng = np.random.default_rng(5)
    centres = rng.uniform(-50, 50, size=(80, 4))
    x = centres[rng.integers(0, 80, 5000)] + rng.normal(size=(5000, 4))
    train = spark.createDataFrame([(list(map(float, r)), "l", 1) for r in x], "x array<double>, y string, w long")
    queries = train.select("x").where(F.xxhash64("x") % 10 == 0)
    dealt, pivots, sizes = T.knn_cells(train, 5)
    first = T.knn_route(queries, pivots, sizes, 5)
    near = T._search(first, dealt, sizes, 5)
    bounds = near.groupBy("x").agg(F.sort_array(F.collect_list("d")).alias("d")).select("x", F.get("d", F.lit(4)).alias("bound"))
    more = T.knn_route(queries, pivots, sizes, 5, bounds)
    n = queries.count()
    seen = (first.count() + more.count()) / (n * len(pivots))
    print("share of (query, cell) pairs seen:", round(seen, 3), "of", len(pivots), "cells")
    assert len(pivots) == 200 and seen < 0.1


def test_routes_are_made_in_bounded_pieces(spark, monkeypatch):
    """Neither the distances to all pivots nor the rows for all cells of a batch are held at once."""
    widest, sent, real = [], [], T._distances
    monkeypatch.setattr(T, "KNN_HELD", 240)
    monkeypatch.setattr(T, "_distances", lambda x, pivots: widest.append(len(x) * len(pivots)) or real(x, pivots))

    class Frame:
        def mapInPandas(self, run, schema):
            import pandas as pd
            sent.extend(run([pd.DataFrame({"x": list(x), "bound": np.inf})]))

    rng = np.random.default_rng(5)
    x, pivots = rng.normal(size=(100, 4)), rng.normal(size=(60, 4))
    sizes = np.tile([5.0, 0.0, 9.0], (60, 1))
    T.knn_route(Frame(), pivots, sizes, 5, Frame())
    assert len(widest) == 25 and max(widest) <= 240
    assert max(len(p) * 4 for p in sent) <= 240
    assert sum(len(p) for p in sent) == 100 * 59  # all cells but the nearest, which was seen before
    assert {(tuple(a), b) for p in sent for a, b in zip(p["x"], p["cell"])} == {(tuple(a), b) for a in x for b in range(60)} - {
        (tuple(a), int(b)) for a, b in zip(x, real(x, pivots).argmin(axis=1))}


def test_found_rows_carry_numbers(spark):
    """Numbered queries come back from the search as numbers: their values are not copied for every row found."""
    rng = np.random.default_rng(3)
    train = spark.createDataFrame([(list(map(float, r)), "l", 1) for r in rng.normal(size=(60, 4))], "x array<double>, y string, w long")
    queries = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rng.normal(size=(9, 4)))], "q long, x array<double>")
    dealt, pivots, sizes = T.knn_cells(train, 5)
    near = T._search(T.knn_route(queries, pivots, sizes, 5, numbered=True), dealt, sizes, 5)
    assert near.columns == ["q", "y", "w", "d"]
    x, asked = np.array([r["x"] for r in train.collect()]), np.array([r["x"] for r in queries.orderBy("q").collect()])
    got = {r["q"]: sorted(r["d"]) for r in near.groupBy("q").agg(F.collect_list("d").alias("d")).collect()}
    for i, q in enumerate(asked):
        assert got[i] == pytest.approx(np.sort(((x - q) ** 2).sum(axis=1))[:5])
