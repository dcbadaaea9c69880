"""Schema-only helpers (prop rows) and the header-less log reader."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import filters as FL
from tessera.operators import halflife as H
from tessera.operators import lablog as L
from tessera.operators import performance as P
from tessera.operators import profile as Q
from tessera.operators import stats as A
from tessera.operators import stability as S
from tessera.operators.features import clean_label_name
from tessera.sources.files import dedupe_names


def test_p1_day_mapping():
    foam, tex = P.map_day_columns(["Foam (cc)", "Texture", "Foam (cc).1", "Texture.1", "Score_Texture"])
    assert foam == {0: "Foam (cc)", 1: "Foam (cc).1"} and tex == {0: "Texture", 1: "Texture.1"}
    foam2, _ = P.map_day_columns(["Day 2 - Foam (cc)", "Day 0 - Foam (cc)"])
    assert foam2 == {0: "Day 0 - Foam (cc)", 1: "Day 2 - Foam (cc)"}


def test_p2_config_rejects():
    import pytest
    with pytest.raises(ValueError):
        P.PipelineConfig(model="rf")
    with pytest.raises(ValueError):
        P.PipelineConfig(num_days=15)


def test_wide_arrays(spark):
    df = spark.createDataFrame([(1, "10", "Fine", " 8 ", "coarse*")],
                               "id int, `Foam (cc)` string, Texture string, `Foam (cc).1` string, `Texture.1` string")
    r = P.day_arrays_from_wide(df, "id", 14).first()
    assert r["y"] == [10.0, 8.0] and r["tex"] == ["fine", "coarse"]


def test_s8_f4_f5_f6_a10_q9_h10_j14():
    assert dedupe_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    assert FL.find_columns(["Temp", "SDS (ppm)", "sds2"], ["sds", "temp"]) == ["SDS (ppm)", "sds2", "Temp"]
    assert FL.resolve_column(["APG (%)", "x"], "apg") == "APG (%)"
    assert FL.resolve_column(["APG (%)", "x"], "x") == "x"
    assert clean_label_name("APG (%)") == "APG" and clean_label_name("SDS %") == "SDS pct"
    assert A.first_pairs(["a", "b", "c"], 2) == [("a", "b"), ("a", "c")]
    assert Q.percent_columns_outside.__doc__
    assert S.resolve_result_column(["dilution stability (14 days)"], "Dilution Stability (14 Days)") == \
        "dilution stability (14 days)"
    cols = ["Day 0 - Foam (cc)", "Zeta", "APG (%)", "SampleID", "x"]
    assert L.sort_columns(cols) == ["APG (%)", "SampleID", "Zeta", "Day 0 - Foam (cc)", "x"]


def test_q9_percent_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`APG (%)` double, `SDS (%)` double, t double")
    assert Q.percent_columns_outside(df, {"anionic": ["APG (%)"]}) == ["SDS (%)"]


def test_h1_time_columns():
    cols = H.find_time_columns(["Time (3h)", "Sample", "Time (30m)", "Time (0.0)"])
    assert [c for c, _ in cols] == ["Time (0.0)", "Time (30m)", "Time (3h)"]


def test_s4_read_log_and_extract(spark):
    d = tempfile.mkdtemp(prefix="tessera-log-")
    lines = [
        '"0.5% APG, 20 ppm SDS (S1)",stable 4C,,,',
        "20X,45C 5cc,10 mL tube,,",
        "Day,Date,Foam (cc),Foam Texture,",
        "Day 0,2024-01-01,40 cc,fine,*",
        ",,,wet,",
        "Day 1,2024-01-02,30 cc,coarse,",
    ]
    with open(os.path.join(d, "a.csv"), "w", encoding="cp1252") as fh:
        fh.write("\n".join(lines) + "\n")
    log = L.read_log(spark, d, 5)
    samples, form, _ = L.extract(log, 5)
    rows = sorted(samples.where(F.col("Day").isNotNull()).collect(), key=lambda r: r["line_no"])
    assert [r["Foam (cc)"] for r in rows] == [40.0, 30.0]
    assert rows[0]["Foam Texture"] == "fine, wet" and rows[0]["Baseline"] == "*"
    assert rows[0]["Dilution Ratio"] == "20X 45C 5cc" and rows[0]["Tube Volume (mL)"] == "10 mL tube"
    assert rows[0]["Concentrate Stability (4C)"] is True and rows[0]["SampleID"] == "S1"
    f = form.first()
    assert f["doses"] == {"APG (%)": 0.5, "SDS (ppm)": 20.0}


def test_surrogate_rules_partition_the_rows(spark):
    from pyspark.sql import functions as F
    from tessera.operators.explain import surrogate_rules

    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.when(F.col("a") > 4, 10.0).otherwise(F.when(F.col("b") > 3, 3.0).otherwise(1.0)) + F.col("b") / 10)
    rules = surrogate_rules(df, ["a", "b"], "y", 3).collect()
    assert len({r["rule"] for r in rules}) == len(rules) > 2
    hits = df.select("y", *[F.expr(r["rule"]).cast("int").alias(f"r{i}") for i, r in enumerate(rules)])
    assert hits.where(sum(F.col(f"r{i}") for i in range(len(rules))) != 1).count() == 0
    for i, r in enumerate(rules):
        assert abs(hits.where(f"r{i} = 1").agg(F.avg("y")).first()[0] - r["prediction"]) < 1e-9


def test_whole_numbers_are_counted_exactly(spark):
    from tessera.operators.profile import frequency_table

    df = spark.createDataFrame([(9007199254740992,), (9007199254740993,), (5,)], "k bigint")
    assert {r["value"] for r in frequency_table(df).collect()} == {"5.0", "9007199254740993", "9.007199254740992E15"}


def test_repeated_day_keeps_the_least_row(spark):
    from tessera.operators.performance import day_arrays

    df = spark.createDataFrame([(1, 0, 5.0), (1, 0, 3.0), (1, 2, 7.0)], "id int, d int, y double")
    assert day_arrays(df, label_col=None, num_days=2).first()["y"] == [3.0, None, 7.0]


def test_repeated_names_avoid_taken_ones():
    from tessera.sources.files import dedupe_names

    assert dedupe_names(["a", "a", "a.1", "b", "a"]) == ["a", "a.2", "a.1", "b", "a.3"]


def test_unknown_metric_and_grid_names_raise(spark):
    import pytest
    from tessera.operators import models as T

    with pytest.raises(ValueError):
        T._known("auc", T.CLASS_METRICS)
    df = spark.range(40).selectExpr("cast(id as double) as x", "id * 2.0 as y", "cast(id % 5 as int) as fold")
    with pytest.raises(ValueError):
        T.grid_search(df, ["x"], "y", "Ridge", "fold", {"depth": [1]})
    _, res = T.grid_search(df, ["x"], "y", "Ridge", "fold", {"alpha": [0.1, 1.0]})  # five folds
    assert len(res) == 2
