"""Golden micro-fixtures worked by hand (FIXTURES.md §2) and the reference's own
test invariants, run through the Spark operators."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import clean as M
from tessera.operators import features as G
from tessera.operators import halflife as H
from tessera.operators import metrics as VM
from tessera.operators import performance as P
from tessera.operators import profile as Q
from tessera.operators import stability as S
from tessera.operators import filters as FL
from tessera.functions.text import clean_label, is_unstable


def test_m8_iqr_outlier(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (100.0,)], "a double")
    r = M.detect_outliers(df, ["a"]).first()
    assert r["outliers"] == 1 and r["pct"] == 25.0
    b = M.outlier_bounds(df, ["a"])["a"]
    assert b[1] == pytest.approx(67.375)


def test_m3_mode_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert [r[0] for r in M.impute(df, "mode", ["c"]).collect()].count("a") == 3


def test_e6_standard_ddof0(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    p = M.fit_scaler(df, ["x"], "standard")
    assert p["x"][1] == pytest.approx(1.247219, abs=1e-6)
    s = M.apply_scaler(df, p).agg(F.avg("x")).first()[0]
    assert abs(s) < 1e-9


def test_g4_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    assert [r[0] for r in G.quantile_bins(df, ["x"], 5).orderBy("x").select("x_bin").collect()] == [0, 1, 2, 3, 4]
    df2 = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 2, 3)], "x double")
    assert [r[0] for r in G.quantile_bins(df2, ["x"], 2).select("x_bin").collect()] == [0, 0, 0, 0, 0]


def test_g20_task(spark):
    a = spark.createDataFrame([(float(i % 30),) for i in range(40)], "y double")
    b = spark.createDataFrame([(float(i % 25),) for i in range(100)], "y double")
    assert G.detect_task(a, "y").first()["task"] == "regression"
    assert G.detect_task(b, "y").first()["task"] == "classification"


def test_x1_x7(spark):
    df = spark.createDataFrame([("Fine-Bubbly  *",), ("nan",), ("",)], "t string")
    assert [r[0] for r in df.select(clean_label("t")).collect()] == ["fine bubbly", None, None]
    o = spark.createDataFrame([("no gel",), ("unstable gel",), ("gelling",), ("precipitation",)], "t string")
    assert [r[0] for r in o.select(is_unstable("t")).collect()] == [False, True, False, True]


def test_x5_minutes():
    got = [H.parse_minutes(h) for h in ("Time (30m)", "Time(1h)", "time 0.5 h", "Time (0.0)", "Foam")]
    assert got[:4] == [30.0, 60.0, 30.0, 0.0] and math.isnan(got[4])


def test_p3_validity(spark):
    rows = [(1, [1.0, None, 3.0]), (2, [None, 2.0, 3.0]), (3, [1.0, None, None, 4.0]), (4, [1.0])]
    df = spark.createDataFrame(rows, "id int, y array<double>")
    got = dict(df.select("id", F.expr(P.valid_sample_expr("y"))).collect())
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_p10_sequential_fill(spark):
    table = [("p", 5.0), ("q", 3.0), ("r", 1.0), ("s", 2.0)]
    df = spark.createDataFrame([(1, ["p", None, None, "r"]), (2, [None, "p", None])], "id int, tex array<string>")
    got = dict(P.fill_labels(df, table).select("id", "tex_filled").collect())
    assert got[1] == ["p", "q", "s", "r"]
    assert got[2] == [None, "p", None]


def test_p12_score(spark):
    table = [("p", 5.0), ("q", 3.0), ("r", 1.0), ("s", 2.0)]
    df = spark.createDataFrame([([10.0, None, 4.0], ["p", "x", "r"])], "y_filled array<double>, tex_filled array<string>")
    cfg = P.PipelineConfig(num_days=2)
    r = P.score(df, table, cfg).first()
    assert (r["score_volume"], r["score_texture"], r["performance_index"]) == (14.0, 6.0, 20.0)
    u = df.select(F.expr(P.unmatched_labels_expr(table))).first()[0]
    assert u == ["x"]


def _hl(spark, t, y, method):
    df = spark.createDataFrame([(1, [{"t": float(a), "y": float(b)} for a, b in zip(t, y)])],
                               "id int, pts array<struct<t:double,y:double>>")
    ev = H.evaluate(df, 0.0)
    return H.half_life(ev, method, unit="minutes").first()["half_life"]


def test_h5_h6_h7(spark):
    assert _hl(spark, [0, 60, 120], [100, 75, 50], "linear") == pytest.approx(120.0)
    ts = [0, 1, 2, 3, 4, 5]
    assert _hl(spark, ts, [100 * math.exp(-0.1 * t) for t in ts], "exp") == pytest.approx(6.93, abs=0.01)
    assert _hl(spark, [0, 2, 4, 6], [100, 64, 36, 16], "poly") == pytest.approx(2.93, abs=0.01)


def test_h9_stability(spark):
    rows = [(1, 7, "no gel"), (1, 14, "Gel formed"), (2, 7, "clear"), (3, 7, "clear"), (3, 14, "clear"),
            (3, 30, "clear"), (4, 20, "precipitate")]
    df = spark.createDataFrame(rows, "id int, d int, txt string")
    got = {r["id"]: (r["shelf_life_days"], r["stable_14d"], r["stable_30d"]) for r in S.stability(df).collect()}
    assert got == {1: (14, False, False), 2: (None, None, None), 3: (None, True, True), 4: (20, True, False)}


def test_v2_v5(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 0])), "label int, pred int")
    r = VM.weighted_scores(df).first()
    assert r["accuracy"] == pytest.approx(0.6) and r["precision"] == pytest.approx(0.6) and r["f1"] == pytest.approx(0.6)
    a = spark.createDataFrame(list(zip([0, 0, 1, 1], [.1, .4, .35, .8])), "label int, score double")
    assert VM.auc(a).first()[0] == pytest.approx(0.75)
    b = spark.createDataFrame([(0, .5), (1, .5)], "label int, score double")
    assert VM.auc(b).first()[0] == pytest.approx(0.5)


def test_f9_constraints(spark):
    df = spark.createDataFrame([(60.0, 40.0), (60.0, 41.0), (60.0, None)], "a double, b double")
    out = FL.apply_constraints(df, {"a": (0, 100), "b": (0, 100)}, ["a", "b"], 100.0, 0.5).collect()
    assert len(out) == 1


def test_r3_constant_corr_is_null(spark):
    from tessera.operators import stats as A
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert A.corr_long(df, ["a", "b"]).first()["r"] is None


def test_q1_warnings(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 42), (3, 4.0, "y", 42), (5, None, "z", 42)], "a long, b double, c string, k int")
    w = {(r["check"], r["column"]) for r in Q.validate(df).collect()}
    assert ("constant", "k") in w and not any(c == "high_missing" for c, _ in w)
    clean = spark.createDataFrame([(1, 4), (2, 5), (3, 6)], "x long, y long")
    assert Q.validate(clean).count() == 0


def test_q2_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (3, 4.0, "y"), (5, None, "z")], "a long, b double, c string")
    b = {r["column"]: r for r in Q.profile(df).collect()}["b"]
    assert b["null_count"] == 1 and b["null_pct"] == 33.33 and b["n_unique"] == 2


def test_x5_column_matches_header_parser(spark):
    from tessera.functions.text import minutes_from_header
    heads = ["Time (30m)", "Time(1h)", "time 0.5 h", "Time (0.0)", "Foam", "t=15", "2 hours"]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    got = dict(df.select("h", minutes_from_header("h")).collect())
    for h in heads:
        want = H.parse_minutes(h)
        assert (got[h] is None and math.isnan(want)) or got[h] == want


def test_f3_full_range_rule_drops_null(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    assert FL.apply_rules(df, [FL.Rule("x")]).count() == 2
    assert FL.range_filter(df, "x", 3.0, 3.0).count() == 3  # lo >= hi: no-op


def test_x8_formulation_parse(spark):
    from tessera.operators import lablog as L
    df = spark.createDataFrame([(1, "0.5% APG, 20 ppm SDS (S1), 5 ppm sds")], "k int, t string")
    m = L.doses_map(df, "t", ["k"]).first()["doses"]
    assert m == {"APG (%)": 0.5, "SDS (ppm)": 20.0}


def test_one_hot_levels_bounded(spark):
    df = spark.createDataFrame([(str(i), "a" if i % 2 else "b") for i in range(30)], "id string, g string")
    out = M.one_hot(df, ["g"])
    assert sorted(c for c in out.columns if c.startswith("g_")) == ["g_a", "g_b"]
    with pytest.raises(ValueError):
        M.levels_many(df, ["id"], limit=10)
