"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

COLUMNS = "vec_id bigint, label int, embedding array<float>, tile string, positives int, v string"


def brute(rows, every, positives, negs, low, high):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in one or (label, v) < one[i]:
            one[i] = (label, v)
    one = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in one.items()}
    out = set()
    for a, (label, v) in one.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in one.items() if i != a)
        for p, i, _ in [x for x in scores if x[2] == label][:positives]:
            fit = [x for x in scores if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negs]
            out |= {(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)}
    return out


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, "t", 1, "v") for r in rows], COLUMNS)
    got = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(400):
        label = rng.choice([0, 0, 0, 1, 2, 3])
        out.append((i, label, [rng.gauss((j % 4 == label) * 0.8, 0.3) for j in range(12)]))
    hot = out[5][2]
    out += [(400 + i, i % 2, hot) for i in range(120)]                      # a very common vector: ties by id
    out += [(600, 1, None), (601, None, hot), (None, 1, hot), (602, 1, [1.0, None]), (603, 1, [math.nan] * 12), (604, 1, [math.inf] * 12)]
    out += [(605, 1, [0.5, 0.5]), (606, 2, []), (607, 2, [0.0] * 12), out[7], out[7], (20, 3, [0.1] * 12), (700, 77, [0.3] * 12)]
    return out


@pytest.mark.parametrize("options", [{}, {"strips": 3, "tile": 4}, {"positives": 2, "negatives": 3, "low": 0, "high": 100, "strips": 1}])
def test_equals_brute_force(spark, rows, options):
    want = brute(rows, 10, options.get("positives", 5), options.get("negatives", 10), options.get("low", 30), options.get("high", 90))
    assert len(want) > 100
    assert mined(spark, rows, 10, **options) == want


def test_components_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, i % 3, [rng.uniform(-1, 1) * 2.0 ** 19 for _ in range(6)]) for i in range(80)]
    want = brute(rows, 10, 5, 10, 30, 90)
    assert want and max(x[4] for x in want) > 2 ** 53
    assert mined(spark, rows, 10) == want


def test_scan_drops_candidates_early(monkeypatch):
    """After the first columns of an anchor with a few large components, few rows are left."""
    rng = np.random.default_rng(0)
    columns = np.floor(rng.normal(size=(64, 2000)) * 256)
    batch = negatives.Batch(np.arange(2000), np.zeros(2000), columns)
    q = columns[:, 3] * np.where(np.arange(64) < 6, 20, 0.02).round(2)
    left = []

    def alive(lower, upper):
        keep = upper >= np.sort(lower)[-5:][0]
        left.append(int(keep.sum()))
        return keep

    rows, scores = batch.scan(np.floor(q), np.arange(2000), alive)
    want = np.floor(q) @ columns
    assert set(np.argsort(-want)[:5]) <= set(rows) and (scores == want[rows]).all()
    assert left[0] < 100 and left == sorted(left, reverse=True)


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert negatives.mine(none, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, 1, [0.5], "", 1, "")], COLUMNS)
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).collect() == []
