"""Queries for missing values, outliers, encoding, scaling (M, E) and features (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import hash_u
from ..operators import clean as M
from ..operators import features as G
from ..operators import profile as Q
from ..sources import views as V
from ..sources.tables import table
from . import register

C = V.CHEM_COLS
GN = V.GAPPY_NUM
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _hash_sql(key: str, seed: int = 42, tag: str = "") -> str:
    return (f"(cast(('0x' || substr(md5(concat_ws('|', '{seed}', cast({key} as varchar), '{tag}')), 1, 8))"
            f" as bigint) / 4294967296.0)")


# ---------------------------------------------------------------- M

@register("m1_impute_drop_gappy", views=("gappy",), ops="M1 M7",
          sql="select * from gappy where disc is not null and tax is not null and flag is not null")
def m1_q(spark, sf):
    return M.impute(V.gappy(spark, sf), "drop")


def _fill_sql(stat_of):
    stats = ", ".join(f"{stat_of(c)} as s_{c}" for c in C)
    cols = ", ".join(f"coalesce({c}, s.s_{c}) as {c}" for c in C)
    return f"with s as (select {stats} from chem_wide) select id, {cols} from chem_wide, s"


@register("m2_impute_mean_chem", views=("chem_wide",), digits={c: 6 for c in C}, ops="M2",
          sql=_fill_sql(lambda c: f"avg({c})"))
def m2_mean_q(spark, sf):
    return M.impute(V.chem_wide(spark, sf), "mean", C).select("id", *C)


@register("m2_impute_median_chem", views=("chem_wide",), digits={c: 6 for c in C}, ops="M2",
          sql=_fill_sql(lambda c: f"quantile_cont({c}, 0.5)"))
def m2_median_q(spark, sf):
    return M.impute(V.chem_wide(spark, sf), "median", C).select("id", *C)


@register("m3_impute_mode_chem", views=("chem_wide",), ops="M3",
          sql="with " + ", ".join(
              f"f_{c} as (select {c} as v, count(*) as n from chem_wide where {c} is not null group by {c})"
              for c in C) + ", s as (select " + ", ".join(
              f"(select arg_min(v, (-n, v)) from f_{c}) as s_{c}" for c in C) + ") select id, " + ", ".join(
              f"coalesce({c}, s.s_{c}) as {c}" for c in C) + " from chem_wide, s")
def m3_q(spark, sf):
    return M.impute(V.chem_wide(spark, sf), "mode", C).select("id", *C)


@register("m4_impute_constant_chem", views=("chem_wide",), ops="M4",
          sql="select id, " + ", ".join(f"coalesce({c}, -1.0) as {c}" for c in C) + " from chem_wide")
def m4_q(spark, sf):
    return M.impute(V.chem_wide(spark, sf), "constant", C, value=-1.0).select("id", *C)


@register("m5_role_nulls_chem", views=("chem_wide",), ops="M5",
          sql="select id, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in C[:4]) + ", c5 "
              "from chem_wide where c5 is not null")
def m5_q(spark, sf):
    return M.role_nulls(V.chem_wide(spark, sf), C[:4], ["c5"]).select("id", *C[:5])


@register("m6_clean_target_chem", views=("chem_wide",), ops="M6",
          sql="select id, target from chem_wide where target is not null and target <= 1e5")
def m6_q(spark, sf):
    return M.clean_target(V.chem_wide(spark, sf), "target", "regression").select("id", "target")


IQR_SQL = """
with b as (select """ + ", ".join(
    f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in GN) + """ from gappy)"""


def _iqr_bounds(c, k=1.5):
    return f"(q1_{c} - {k} * (q3_{c} - q1_{c}))", f"(q3_{c} + {k} * (q3_{c} - q1_{c}))"


@register("m8_outliers_iqr_gappy", views=("gappy",), ops="M8",
          sql=IQR_SQL + "\n" + "\nunion all ".join(
              f"select '{c}' as feature, cast(count_if({c} < {_iqr_bounds(c)[0]} or {c} > {_iqr_bounds(c)[1]}) as bigint) as outliers, "
              f"coalesce(round_even(count_if({c} < {_iqr_bounds(c)[0]} or {c} > {_iqr_bounds(c)[1]}) * 100.0 "
              f"/ nullif(count({c}), 0), 2), 0.0) as pct from gappy, b" for c in GN))
def m8_q(spark, sf):
    return M.detect_outliers(V.gappy(spark, sf), GN, "IQR")


@register("m8_outliers_iqr_narrow_gappy", views=("gappy",), ops="M8",
          sql=IQR_SQL + "\n" + "\nunion all ".join(
              f"select '{c}' as feature, cast(count_if({c} < {_iqr_bounds(c)[0]} or {c} > {_iqr_bounds(c)[1]}) as bigint) as outliers, "
              f"coalesce(round_even(count_if({c} < {_iqr_bounds(c)[0]} or {c} > {_iqr_bounds(c)[1]}) * 100.0 "
              f"/ nullif(count({c}), 0), 2), 0.0) as pct from gappy, b" for c in GN))
def m8n_q(spark, sf):
    """Same answer as m8, quartiles found by bounded-memory narrowing."""
    return M.detect_outliers(V.gappy(spark, sf), GN, "IQR", approx="narrow")


@register("m9_outliers_z_gappy", views=("gappy",), ops="M9",
          sql="with b as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}" for c in GN)
              + " from gappy)\n" + "\nunion all ".join(
              f"select '{c}' as feature, cast(count_if(s_{c} > 0 and abs({c} - m_{c}) > 3 * s_{c}) as bigint) as outliers, "
              f"coalesce(round_even(count_if(s_{c} > 0 and abs({c} - m_{c}) > 3 * s_{c}) * 100.0 "
              f"/ nullif(count({c}), 0), 2), 0.0) as pct from gappy, b" for c in GN))
def m9_q(spark, sf):
    return M.detect_outliers(V.gappy(spark, sf), GN, "Z-score")


@register("m10_remove_outliers_iqr_gappy", views=("gappy",), ops="M10",
          sql=IQR_SQL + "\nselect l_orderkey, l_linenumber, l_extendedprice from gappy, b where " + " and ".join(
              f"{c} between {_iqr_bounds(c)[0]} and {_iqr_bounds(c)[1]}" for c in GN))
def m10_q(spark, sf):
    return M.remove_outliers(V.gappy(spark, sf), GN, "IQR").select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("q11_row_delta_outliers", views=("gappy",), ops="Q11 M10",
          sql=IQR_SQL + """
select (select count(*) from gappy) as n_before, count(*) as n_after,
       (select count(*) from gappy) - count(*) as n_removed from gappy, b where """ + " and ".join(
              f"{c} between {_iqr_bounds(c)[0]} and {_iqr_bounds(c)[1]}" for c in GN))
def q11_q(spark, sf):
    g = V.gappy(spark, sf)
    return Q.row_delta(g, M.remove_outliers(g, GN, "IQR"))


CHEM_IQR = """with b as (select """ + ", ".join(
    f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in C + ["target"]) + """ from chem_wide),
s as (""" + "\nunion all ".join(
    f"select '{c}' as feature, cast(count_if({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) or {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
    f" as bigint) as outliers, coalesce(round_even(count_if({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) or {c} > q3_{c} + 1.5 * "
    f"(q3_{c} - q1_{c})) * 100.0 / nullif(count({c}), 0), 2), 0.0) as pct from chem_wide, b" for c in C + ["target"]) + ")"


@register("m11_most_affected_chem", views=("chem_wide",), ops="M11 M8",
          sql=CHEM_IQR + " select * from s order by outliers desc, feature limit 5")
def m11_q(spark, sf):
    return M.most_affected(M.detect_outliers(V.chem_wide(spark, sf), C + ["target"]), 5)


# ---------------------------------------------------------------- E

@register("e1_one_hot_method_chem", views=("chem_wide",), ops="E1",
          sql="select id, " + ", ".join(f"cast(method = '{p}' as integer) as \"method_{p}\"" for p in PRIORITIES)
              + " from chem_wide")
def e1_q(spark, sf):
    return M.one_hot(V.chem_wide(spark, sf).select("id", "method"), ["method"])


@register("e2_label_codes_flag", views=("gappy",), ops="E2",
          sql="""with lv as (select v, cast(dense_rank() over (order by v) - 1 as integer) as code
                 from (select distinct coalesce(flag, 'nan') as v from gappy))
select g.l_orderkey, g.l_linenumber, lv.code as flag from gappy g join lv on coalesce(g.flag, 'nan') = lv.v""")
def e2_q(spark, sf):
    return M.label_codes(V.gappy(spark, sf).select("l_orderkey", "l_linenumber", "flag"), ["flag"])


@register("e3_ordinal_codes_lineitem", ops="E3",
          sql="""with a as (select v, cast(dense_rank() over (order by v) - 1 as double) as code
                 from (select distinct l_returnflag as v from lineitem)),
b as (select v, cast(dense_rank() over (order by v) - 1 as double) as code
      from (select distinct l_linestatus as v from lineitem))
select l.l_orderkey, l.l_linenumber, a.code as l_returnflag, b.code as l_linestatus
from lineitem l join a on l.l_returnflag = a.v join b on l.l_linestatus = b.v""")
def e3_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return M.label_codes(li, ["l_returnflag", "l_linestatus"], as_double=True)


@register("e4_factorize_segment", ops="E4",
          sql="""with f as (select c_mktsegment, cast(dense_rank() over (order by min(c_custkey)) - 1 as integer) as code
                from customer group by c_mktsegment)
select c.c_custkey, c.c_mktsegment, f.code as c_mktsegment_code from customer c join f using (c_mktsegment)""")
def e4_q(spark, sf):
    cu = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return M.factorize(cu, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "c_mktsegment_code")


def _scaled_sql(kind):
    if kind == "standard":
        st = ", ".join(f"avg({c}) as a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as b_{c}" for c in C[:3])
    elif kind == "minmax":
        st = ", ".join(f"min({c}) as a_{c}, coalesce(nullif(max({c}) - min({c}), 0), 1) as b_{c}" for c in C[:3])
    else:
        st = ", ".join(f"quantile_cont({c}, 0.5) as a_{c}, coalesce(nullif(quantile_cont({c}, 0.75) - "
                       f"quantile_cont({c}, 0.25), 0), 1) as b_{c}" for c in C[:3])
    return (f"with sp as (select *, {_hash_sql('id')} < 0.8 as train from chem_wide),\n"
            f"s as (select {st} from sp where train)\n"
            f"select id, train, " + ", ".join(f"({c} - a_{c}) / b_{c} as {c}" for c in C[:3]) + " from sp, s")


def _scaled_q(kind):
    def fn(spark, sf):
        df = V.chem_wide(spark, sf).withColumn("train", hash_u("id") < 0.8)
        params = M.fit_scaler(df.filter("train"), C[:3], kind)
        return M.apply_scaler(df, params).select("id", "train", *C[:3])
    return fn


for _k, _op in (("standard", "E6 T9"), ("minmax", "E7"), ("robust", "E8")):
    register(f"e_{_k}_scale_chem", views=("chem_wide",), digits={c: 6 for c in C[:3]}, ops=_op,
             sql=_scaled_sql(_k))(_scaled_q(_k))


@register("e9_scale_keep_original_chem", views=("chem_wide",), digits={"c1": 6, "c1_orig": 6, "roundtrip_err_zero": 6}, ops="E9",
          sql="""with s as (select avg(c1) as a, coalesce(nullif(stddev_pop(c1), 0), 1) as b from chem_wide)
select id, (c1 - a) / b as c1, c1 as c1_orig, (((c1 - a) / b) * b + a) - c1 as roundtrip_err_zero from chem_wide, s""")
def e9_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "c1")
    p = M.fit_scaler(df, ["c1"], "standard")
    s = M.apply_scaler(df, p, keep_original_suffix="_orig")
    back = M.inverse_scaler(s.select("id", F.col("c1").alias("c1_scaled"), "c1_orig").withColumnRenamed(
        "c1_scaled", "c1"), p)
    return (s.join(back.select("id", F.col("c1").alias("c1_back")), "id")
            .select("id", "c1", "c1_orig", F.bround(F.col("c1_back") - F.col("c1_orig"), 6)
                    .alias("roundtrip_err_zero")))


@register("e10_align_features_chem", views=("chem_wide",), ops="E10",
          sql="select id, coalesce(c2, 0.0e0) as c2, 0.0e0 as missing_feature, coalesce(c1, 0.0e0) as c1 from chem_wide")
def e10_q(spark, sf):
    return M.align_to_features(V.chem_wide(spark, sf), ["c2", "missing_feature", "c1"], keep=("id",))


# ---------------------------------------------------------------- G

@register("g1_math_features_chem", views=("chem_wide",),
          digits={k: 6 for k in ("log_target", "sqrt_target", "inv_target", "sqrt_c1", "inv_c1")},
          ops="G1", sql="""select id, target, c1, ln(target) as log_target, sqrt(abs(target)) as sqrt_target,
  target * target as target_sq, target * target * target as target_cube, 1.0 / nullif(target, 0) as inv_target,
  sqrt(abs(c1)) as sqrt_c1, c1 * c1 as c1_sq, c1 * c1 * c1 as c1_cube, 1.0 / nullif(c1, 0) as inv_c1
  from chem_wide""")
def g1_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "target", "c1")
    return G.math_features(df, ["target", "c1"])


@register("g2_g3_pairs_chem", views=("chem_wide",),
          digits={"c1__div__c2": 6, "c1__div__c3": 6, "c2__div__c3": 6}, ops="G2 G3",
          sql="select id, c1 * c2 as c1__x__c2, c1 * c3 as c1__x__c3, c2 * c3 as c2__x__c3, "
              "c1 / nullif(c2, 0) as c1__div__c2, c1 / nullif(c3, 0) as c1__div__c3, c2 / nullif(c3, 0) as c2__div__c3 "
              "from chem_wide")
def g23_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "c1", "c2", "c3")
    return G.pair_ratios(G.pair_products(df, ["c1", "c2", "c3"]), ["c1", "c2", "c3"]).drop("c1", "c2", "c3")


def _bins_sql(cols, n=5):
    qs = ", ".join(str(i / n) for i in range(n + 1))
    e = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{qs}]))) as e_{c}" for c in cols)
    b = ", ".join(f"case when {c} is null or len(e_{c}) < 2 then null else "
                  f"cast(len(list_filter(e_{c}[2:], lambda x: x < {c})) as integer) end as {c}_bin" for c in cols)
    return f"with e as (select {e} from chem_wide) select id, {b} from chem_wide, e"


@register("g4_quantile_bins_chem", views=("chem_wide",), ops="G4", sql=_bins_sql(["target", "c1", "c2"]))
def g4_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "target", "c1", "c2")
    return G.quantile_bins(df, ["target", "c1", "c2"], 5, drop_original=True)


@register("g5_feature_config_gappy", views=("gappy",), ops="G5",
          digits={"sqrt_l_quantity": 6, "sqrt_l_extendedprice": 6, "l_quantity__div__l_extendedprice": 9},
          sql="""select l_orderkey, l_linenumber, sqrt(abs(l_quantity)) as sqrt_l_quantity,
  sqrt(abs(l_extendedprice)) as sqrt_l_extendedprice,
  l_quantity / nullif(l_extendedprice, 0) as l_quantity__div__l_extendedprice from gappy""")
def g5_q(spark, sf):
    df = V.gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out, report = G.build_features(df, ["sqrt", "ratios"], ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", *report["new"])


GROUPS = {"anionic": ["c1", "c2", "c3"], "nonionic": ["c4", "c5"], "polymer": ["c6", "c7"]}


@register("g6_group_sums_chem", views=("chem_wide",), digits={f"{g}_sum": 6 for g in GROUPS}, ops="G6",
          sql="select id, " + ", ".join(
              " + ".join(f"coalesce({c}, 0)" for c in cs) + f" as {g}_sum" for g, cs in GROUPS.items())
              + " from chem_wide")
def g6_q(spark, sf):
    return G.group_sums(V.chem_wide(spark, sf), GROUPS).select("id", *[f"{g}_sum" for g in GROUPS])


ROLE_GROUPS = {"Anionic": ["c1", "c2"], "Nonionic": ["c3"], "Zwitterionic": ["c4"], "Polymer": ["c5", "c6"],
               "Acid": ["c7"]}


@register("g6_sum_features_chem", views=("chem_wide",),
          digits={k: 6 for k in ("Anionic (All Types)", "Nonionic (All Types)", "Zwitterionic (All Types)",
                                 "Sum Surfactant", "Polymer (All Types)", "Acid (All Types)")}, ops="G6",
          sql="""select id, coalesce(c1, 0) + coalesce(c2, 0) as "Anionic (All Types)",
  0.0e0 + coalesce(c3, 0) as "Nonionic (All Types)", 0.0e0 + coalesce(c4, 0) as "Zwitterionic (All Types)",
  coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0) + coalesce(c4, 0) as "Sum Surfactant",
  coalesce(c5, 0) + coalesce(c6, 0) as "Polymer (All Types)", 0.0e0 + coalesce(c7, 0) as "Acid (All Types)"
  from chem_wide""")
def g6s_q(spark, sf):
    out = G.sum_features(V.chem_wide(spark, sf), ROLE_GROUPS)
    return out.drop("method", "target", *C)


@register("g7_fractions_chem", views=("chem_wide",),
          digits={**{f"total_{g}": 6 for g in GROUPS}, **{f"frac_{c}": 9 for c in C}}, ops="G7",
          sql="with t as (select *, " + ", ".join(
              "(" + " + ".join(f"coalesce({c}, 0)" for c in cs) + f") as total_{g}" for g, cs in GROUPS.items())
              + " from chem_wide) select id, " + ", ".join(
              f"total_{g}, case when total_{g} > 0 then 1.0e0 else 0.0e0 end as has_{g}, " + ", ".join(
                  f"coalesce({c}, 0) / (total_{g} + 1e-9) as frac_{c}" for c in cs) for g, cs in GROUPS.items())
              + " from t")
def g7_q(spark, sf):
    out = G.totals_flags_fractions(V.chem_wide(spark, sf), GROUPS)
    return out.drop("method", "target", *C)


G11_L, G11_R = ["l_quantity", "disc", "flag"], ["l_extendedprice", "tax"]


@register("g11_guarded_cross_gappy", views=("gappy",),
          digits={"l_quantity / l_extendedprice": 9, "disc / l_extendedprice": 12, "l_quantity / tax": 6,
                  "disc / tax": 6, "l_quantity + l_extendedprice": 4, "disc + l_extendedprice": 4,
                  "l_quantity + tax": 6, "disc + tax": 6},
          ops="G11", sql="select l_orderkey, l_linenumber, " + ", ".join(
              f'{a} + {b} as "{a} + {b}", {a} / nullif({b}, 0) as "{a} / {b}"'
              for a in ("l_quantity", "disc") for b in ("l_extendedprice", "tax")) + " from gappy")
def g11_q(spark, sf):
    df = V.gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "disc", "l_extendedprice", "tax", "flag")
    out = G.guarded_cross(df, G11_L, G11_R)
    return out.drop("l_quantity", "disc", "l_extendedprice", "tax", "flag")


@register("g12_guarded_products_gappy", views=("gappy",), digits={"Qty x Price": 4, "Disc x Tax": 9}, ops="G12",
          sql='select l_orderkey, l_linenumber, l_quantity * l_extendedprice as "Qty x Price", '
              'disc * tax as "Disc x Tax" from gappy')
def g12_q(spark, sf):
    df = V.gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "disc", "l_extendedprice", "tax", "flag")
    out = G.guarded_products(df, [("l_quantity", "l_extendedprice", "Qty x Price"), ("disc", "tax", "Disc x Tax"),
                                  ("flag", "tax", "Flag x Tax"), ("missing", "tax", "Missing x Tax")])
    return out.select("l_orderkey", "l_linenumber", "Qty x Price", "Disc x Tax")


PAIRS = [("c1", "c2"), ("c3", "c4"), ("c5", "c6")]


def _corr_sql(e, y="target"):
    ok = f"({e}) is not null and {y} is not null"
    xx, yy = f"case when {ok} then {e} end", f"case when {ok} then {y} end"
    return (f"case when count_if({ok}) >= 5 then coalesce(covar_pop({xx}, {yy}) / "
            f"nullif(stddev_pop({xx}) * stddev_pop({yy}), 0), 0) else 0 end")


@register("g14_pair_winners_chem", views=("chem_wide",), ops="G14 A1",
          sql="with r as (select " + ", ".join(
              f"{_corr_sql(f'{a} + {b}')} as s{i}, {_corr_sql(f'{a} / nullif({b}, 0)')} as r{i}"
              for i, (a, b) in enumerate(PAIRS)) + " from chem_wide)\n" + "\nunion all ".join(
              f"select '{a}  ×  {b}' as pair, "
              f"case when abs(s{i}) >= abs(r{i}) then '{a} + {b}' else '{a} / {b}' end as winner, "
              f"round_even(case when abs(s{i}) >= abs(r{i}) then s{i} else r{i} end, 4) as winner_r, "
              f"round_even(abs(case when abs(s{i}) >= abs(r{i}) then s{i} else r{i} end), 4) as winner_abs_r, "
              f"case when abs(s{i}) >= abs(r{i}) then '{a} / {b}' else '{a} + {b}' end as loser, "
              f"round_even(case when abs(s{i}) >= abs(r{i}) then r{i} else s{i} end, 4) as loser_r, "
              f"round_even(abs(case when abs(s{i}) >= abs(r{i}) then r{i} else s{i} end), 4) as loser_abs_r from r"
              for i, (a, b) in enumerate(PAIRS)))
def g14_q(spark, sf):
    return G.pair_winners(V.chem_wide(spark, sf), PAIRS, "target")[1]


@register("g14_pair_winner_features_chem", views=("chem_wide",), digits={"c1 + c2": 6, "c3 / c4": 9, "c3 + c4": 6,
                                                                         "c5 / c6": 9, "c5 + c6": 6},
          ops="G14 G15", sql="select id, c1 + c2 as \"c1 + c2\", c3 + c4 as \"c3 + c4\", c5 + c6 as \"c5 + c6\", "
                             "c3 / nullif(c4, 0) as \"c3 / c4\", c5 / nullif(c6, 0) as \"c5 / c6\" from chem_wide")
def g14f_q(spark, sf):
    out, rep = G.pair_winners(V.chem_wide(spark, sf), PAIRS, "target", keep="both", excluded={"c1 / c2"})
    return out.select("id", "c1 + c2", "c3 + c4", "c5 + c6", "c3 / c4", "c5 / c6")


@register("g17_cross_ratio_zero_counts", ops="G17 G16",
          sql="""select 'l_discount' as denominator, cast(count_if(l_discount = 0) as bigint) as n_zero from lineitem
union all select 'l_tax', cast(count_if(l_tax = 0) as bigint) from lineitem""")
def g17_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return G.cross_ratios(li, ["l_quantity"], ["l_discount", "l_tax"])[1].withColumn(
        "n_zero", F.col("n_zero").cast("bigint"))


@register("g16_cross_products_sum", ops="G16",
          digits={"s_qd": 4, "s_qt": 4},
          sql="select sum(l_quantity * l_discount) as s_qd, sum(l_quantity * l_tax) as s_qt, "
              "count(l_quantity / nullif(l_discount, 0)) as n_ratio from lineitem")
def g16_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    out = G.cross_products(li, ["l_quantity"], ["l_discount", "l_tax"])
    out = G.cross_ratios(out, ["l_quantity"], ["l_discount"])[0]
    return out.agg(F.sum("l_quantity_x_l_discount").alias("s_qd"), F.sum("l_quantity_x_l_tax").alias("s_qt"),
                   F.count("l_quantity_div_l_discount").alias("n_ratio"))


@register("g18_one_hot_interaction_lineitem", ops="G18",
          sql="select " + ", ".join(
              f"cast(sum(case when l_returnflag = '{a}' and l_linestatus = '{b}' then 1 else 0 end) as bigint) "
              f"as \"l_returnflag_{a}__l_linestatus_{b}\""
              for a in "ANR" for b in "FO") + " from lineitem")
def g18_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    out = G.one_hot_interaction(li, "l_returnflag", "l_linestatus")
    new = [c for c in out.columns if "__" in c]
    return out.agg(*[F.sum(c).cast("bigint").alias(c) for c in new])


@register("g19_target_classes_chem", views=("chem_wide",), ops="G19",
          sql="""with q as (select quantile_cont(target, 0.5) as m, quantile_cont(target, 0.33) as a,
  quantile_cont(target, 0.67) as b from chem_wide)
select id, case when target > m then 'High' when target is not null then 'Low' end as binary_class,
  case when target <= a then 'Low' when target <= b then 'Mid' when target is not null then 'High' end as ternary_class
from chem_wide, q""")
def g19_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "target")
    df = G.target_classes(df, "target", "binary", out="binary_class")
    return G.target_classes(df, "target", "ternary", out="ternary_class").drop("target")


@register("g20_detect_task", ops="G20",
          sql="""select 'o_totalprice' as target, count(*) as n, count(distinct o_totalprice) as k,
  case when count(*) < 5 or count(distinct o_totalprice) < 2 then 'classification'
       when count(distinct o_totalprice) <= 20 then 'classification'
       when avg(case when o_totalprice != floor(o_totalprice) then 1.0 else 0.0 end) >= 0.02 then 'regression'
       when count(distinct o_totalprice) / count(*) > 0.5 then 'regression' else 'classification' end as task
  from orders
union all select 'l_linenumber', count(*), count(distinct l_linenumber),
  case when count(*) < 5 or count(distinct l_linenumber) < 2 then 'classification'
       when count(distinct l_linenumber) <= 20 then 'classification' else 'regression' end from lineitem
union all select 'p_size', count(*), count(distinct p_size),
  case when count(*) < 5 or count(distinct p_size) < 2 then 'classification'
       when count(distinct p_size) <= 20 then 'classification'
       when avg(case when p_size != floor(p_size) then 1.0 else 0.0 end) >= 0.02 then 'regression'
       when count(distinct p_size) / count(*) > 0.5 then 'regression' else 'classification' end from part""")
def g20_q(spark, sf):
    a = G.detect_task(table(spark, sf, "orders"), "o_totalprice").select(F.lit("o_totalprice").alias("target"), "*")
    b = G.detect_task(table(spark, sf, "lineitem"), "l_linenumber").select(F.lit("l_linenumber").alias("target"), "*")
    c = G.detect_task(table(spark, sf, "part"), "p_size").select(F.lit("p_size").alias("target"), "*")
    return a.unionByName(b).unionByName(c)
