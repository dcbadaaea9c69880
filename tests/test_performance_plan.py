"""The day arrays of the performance index are built once a sample, whatever filters follow."""

from __future__ import annotations

import pytest

from tessera.operators import performance as P

ROWS = [(1, 0, 10.0, "fine"), (1, 0, 9.0, "odd"), (1, 1, None, "odd"), (1, 2, 5.0, None), (2, 0, 4.0, "fine"), (2, 2, 3.0, "fine"),
        (2, 1, 2.0, "strange"), (3, 0, 1.0, "unseen"), (None, 0, 2.0, "fine"), (None, 1, 1.0, "nobody"), (None, 2, 1.0, None), (4, 15, 1.0, "late")]


@pytest.fixture
def scored(spark):
    rows = spark.createDataFrame(ROWS, "id long, d int, y double, texture string")
    weights = spark.createDataFrame([("Fine", 1.0), ("Coarse", 2.0)], "label string, weight double")
    return P.performance_index(rows, weights, P.PipelineConfig(num_days=2))


@pytest.mark.parametrize("last", [P.missing_labels, P.average_best_r2, P.model_distribution])
def test_arrays_are_built_once(scored, last):
    plan = last(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("map_from_entries") == 1, plan


def test_labels_are_evaluated_once(scored):
    plan = P.missing_labels(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Generate explode")[0], plan  # no filter on the size of the whole expression


def test_day_arrays_and_missing_labels(spark, scored):
    rows = spark.createDataFrame(ROWS, "id long, d int, y double, texture string")
    got = {r["id"]: (r["y"], r["tex"]) for r in P.day_arrays(rows, num_days=2).collect()}
    tex = lambda *names: [n and P_clean(spark, n) for n in names]
    assert got[1] == ([9.0, None, 5.0], tex("odd", "odd", None))  # of two rows of day 0 the least stays
    assert got[2] == ([4.0, 2.0, 3.0], tex("fine", "strange", "fine"))
    assert got[3] == ([1.0, None, None], tex("unseen", None, None))
    assert got[None] == ([2.0, 1.0, 1.0], tex("fine", "nobody", None))
    assert 4 not in got
    # sample 3 is invalid; labels between two known ones are filled
    assert [r["label"] for r in P.missing_labels(scored).collect()] == sorted(tex("odd", "nobody"))


def P_clean(spark, name):
    from tessera.functions.text import clean_label

    return spark.createDataFrame([(name,)], "x string").select(clean_label("x")).first()[0]
