"""Queries for profiling and data quality (Q)."""

from __future__ import annotations


from ..operators import profile as Q
from ..sources import views as V
from ..sources.tables import table
from . import register

GAPPY_TYPES = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
               ("l_extendedprice", "double"), ("disc", "double"), ("tax", "double"), ("flag", "string")]
CHEM_TYPES = [("id", "bigint"), ("method", "string"), ("target", "double")] + [(f"c{i}", "double") for i in range(1, 8)]


def _long_sql(cols, src, keep_null=False):
    parts = [f"select '{c}' as \"column\", cast({c} as varchar) as value from {src}" for c, _ in cols]
    body = "\nunion all ".join(parts)
    return body if keep_null else f"select * from ({body}) where value is not null"


@register("q1_validate_chem", views=("chem_wide",), ops="Q1",
          sql="""
with n as (select count(*) as n_rows from chem_wide),
long as (""" + _long_sql(CHEM_TYPES, "chem_wide", keep_null=True) + """),
freq as (select "column", value, count(*) as n from long group by "column", value),
per as (select "column", count(*) as n_values,
               coalesce(sum(case when value is null then n end), 0) as nulls from freq group by "column")
select 'large' as "check", cast(null as varchar) as "column", cast(n_rows as double) as value from n where n_rows > 1000
union all select 'empty', null, 0.0 from n where n_rows = 0
union all select 'high_missing', "column", round_even(nulls * 100.0 / n_rows, 2) from per, n where nulls * 2 > n_rows
union all select 'constant', "column", cast(n_values as double) from per where n_values <= 1""")
def validate_q(spark, sf):
    return Q.validate(V.chem_wide(spark, sf))


def _profile_sql2(cols, src):
    recs = []
    for c, t in cols:
        isnum = t != "string"
        x = f"cast({c} as double)"
        stat = (f"avg({x}) as mean, stddev_samp({x}) as std, min({x}) as min, quantile_cont({x}, 0.25) as p25, "
                f"quantile_cont({x}, 0.5) as p50, quantile_cont({x}, 0.75) as p75, max({x}) as max") if isnum else \
            ", ".join(f"cast(null as double) as {k}" for k in ("mean", "std", "min", "p25", "p50", "p75", "max"))
        recs.append(f"""select '{c}' as "column", '{t}' as data_type, count(*) as total_count,
            count({c}) as not_null_count, count(*) - count({c}) as null_count,
            round_even((count(*) - count({c})) * 100.0 / count(*), 2) as null_pct,
            count(distinct {c}) as n_unique, {stat} from {src}""")
    body = "\nunion all ".join(recs)
    cats = [(c, t) for c, t in cols if t == "string"]
    return f"""
with base as ({body}),
long as ({_long_sql(cats, src)}),
freq as (select "column", value, count(*) as n from long group by "column", value),
top as (select "column", arg_min(value, (-n, value)) as top, max(n) as freq from freq group by "column")
select b.*, t.top, t.freq from base b left join top t on b."column" = t."column" """


@register("q2_profile_gappy", views=("gappy",), ops="Q2",
          digits={"mean": 6, "std": 6, "min": 6, "p25": 6, "p50": 6, "p75": 6, "max": 6},
          sql=_profile_sql2(GAPPY_TYPES, "gappy"))
def profile_q(spark, sf):
    return Q.profile(V.gappy(spark, sf))


@register("q2_profile_narrow_gappy", views=("gappy",), ops="Q2",
          digits={"mean": 6, "std": 6, "min": 6, "p25": 6, "p50": 6, "p75": 6, "max": 6},
          sql=_profile_sql2(GAPPY_TYPES, "gappy"))
def profile_narrow_q(spark, sf):
    """Same answer as q2, quartiles by bounded-memory narrowing."""
    return Q.profile(V.gappy(spark, sf), approx="narrow")


@register("q3_dataset_card_chem", views=("chem_wide",), ops="Q3",
          sql="""select count(*) as n_rows, cast(10 as bigint) as n_columns, cast(9 as bigint) as n_numeric,
  cast(1 as bigint) as n_categorical,
  round_even((""" + " + ".join(f"(count(*) - count({c}))" for c, _ in CHEM_TYPES) + """) * 100.0
             / (count(*) * 10), 2) as missing_pct from chem_wide""")
def card_q(spark, sf):
    return Q.dataset_card(V.chem_wide(spark, sf))


ORD_CATS = [("o_orderstatus", "string"), ("o_orderpriority", "string")]


@register("q4_categorical_summary_orders", ops="Q4",
          sql="""
with long as (""" + _long_sql(ORD_CATS, "orders", keep_null=True) + """),
freq as (select "column", value, count(*) as n from long group by "column", value)
select "column", count(value) as n_unique, arg_min(value, (-n, value)) as top_value,
       coalesce(max(case when value is not null then n end), 0) as top_freq,
       cast(coalesce(sum(case when value is null then n end), 0) as bigint) as null_count
from freq group by "column" """)
def catsum_q(spark, sf):
    return Q.categorical_summary(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


CUST_CATS = [("c_name", "string"), ("c_mktsegment", "string")]
LI_CATS = [("l_returnflag", "string"), ("l_linestatus", "string")]


@register("q5_categorical_warnings_customer", ops="Q5",
          sql="""
with long as (""" + _long_sql(CUST_CATS, "customer") + """),
freq as (select "column", value, count(*) as n from long group by "column", value),
per as (select "column", count(*) as k, max(n) as top, sum(n) as tot from freq group by "column")
select "column", concat_ws('; ',
   case when k > 20 then 'High cardinality (' || k || ' unique)' end,
   case when top * 100.0 / tot > 90 then 'Dominant class (' || printf('%.1f', top * 100.0 / tot) || ' %)' end)
   as warning
from per where k > 20 or top * 100.0 / tot > 90""")
def catwarn_q(spark, sf):
    return Q.categorical_warnings(table(spark, sf, "customer").select("c_name", "c_mktsegment"))


@register("q6_categorical_shares_lineitem", ops="Q6",
          sql="""
with long as (""" + _long_sql(LI_CATS, "lineitem") + """),
freq as (select "column", value, count(*) as n from long group by "column", value)
select "column", value, round_even(n * 100.0 / sum(n) over (partition by "column"), 2) as pct from freq""")
def shares_q(spark, sf):
    return Q.categorical_shares(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))


@register("q7_null_report_chem", views=("chem_wide",), digits={"null_frac": 6}, ops="Q7",
          sql="\nunion all ".join(
              f"select '{c}' as \"column\", avg(case when {c} is null then 1.0 else 0.0 end) as null_frac "
              f"from chem_wide having avg(case when {c} is null then 1.0 else 0.0 end) > 0"
              for c, _ in CHEM_TYPES))
def nullrep_q(spark, sf):
    return Q.null_report(V.chem_wide(spark, sf))


@register("q8_value_counts_flag", views=("gappy",), ops="Q8",
          sql="select flag as value, count(*) as n from gappy group by flag")
def vc_q(spark, sf):
    return Q.value_counts(V.gappy(spark, sf), "flag")


@register("q10_null_impact_gappy", views=("gappy",), ops="Q10",
          sql="""select count(*) as n_rows, cast(count_if(disc is null or tax is null or flag is null) as bigint) as n_affected,
  round_even(count_if(disc is null or tax is null or flag is null) * 100.0 / count(*), 2) as pct_affected
  from gappy""")
def impact_q(spark, sf):
    return Q.null_impact(V.gappy(spark, sf), ["disc", "tax", "flag"])


@register("q12_overview_regression_chem", views=("chem_wide",), digits={"target_median": 6},
          ops="Q12", sql="""select count(*) as n_rows, 7 as n_features, quantile_cont(target, 0.5) as target_median,
  min(target) as target_min, max(target) as target_max from chem_wide""")
def overview_reg_q(spark, sf):
    return Q.model_ready_overview(V.chem_wide(spark, sf), "target", V.CHEM_COLS, "regression")


@register("q12_overview_classes_lineitem", ops="Q12",
          sql="""with c as (select l_returnflag as cls, count(*) as n from lineitem group by l_returnflag)
select cast(sum(n) as bigint) as n_rows, 4 as n_features, count(*) as n_classes, arg_min(cls, (-n, cls)) as largest_class,
       max(n) as largest_class_n from c""")
def overview_cls_q(spark, sf):
    df = table(spark, sf, "lineitem")
    return Q.model_ready_overview(df, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                  "classification")
