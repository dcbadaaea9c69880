"""Queries for exploratory statistics (A) and filters (F)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators import stats as A
from ..sources import views as V
from ..sources.tables import table
from . import register

C = V.CHEM_COLS
GN = V.GAPPY_NUM


def _corr(x, y):
    ok = f"{x} is not null and {y} is not null"
    xx, yy = f"case when {ok} then {x} end", f"case when {ok} then {y} end"
    return f"covar_pop({xx}, {yy}) / nullif(stddev_pop({xx}) * stddev_pop({yy}), 0)"


A1_COLS = ["c1", "c2", "c3", "c4", "target"]


@register("a1_corr_matrix_chem", views=("chem_wide",), digits={"r": 6}, ops="A1",
          sql="\nunion all ".join(f"select '{a}' as f1, '{b}' as f2, {_corr(a, b)} as r from chem_wide"
                                  for a, b in combinations(A1_COLS, 2)))
def a1_q(spark, sf):
    return A.corr_long(V.chem_wide(spark, sf), A1_COLS)


@register("a2_top_features_by_target_chem", views=("chem_wide",), digits={"r": 6, "abs_r": 6}, ops="A2",
          sql="select * from (" + "\nunion all ".join(
              f"select '{c}' as feature, {_corr(c, 'target')} as r, abs({_corr(c, 'target')}) as abs_r from chem_wide"
              for c in C) + ") where r is not null order by abs_r desc, feature limit 5")
def a2_q(spark, sf):
    return A.top_by_target(V.chem_wide(spark, sf), C, "target", 5)


@register("a3_collinear_pairs_lineitem", digits={"r": 6}, ops="A3",
          sql="select * from (" + "\nunion all ".join(
              f"select '{a}' as f1, '{b}' as f2, {_corr(a, b)} as r from lineitem"
              for a, b in combinations(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2))
              + ") where abs(r) >= 0.85")
def a3_q(spark, sf):
    return A.collinear_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _a4_sql(f):
    ok = f"{f} is not null and target is not null"
    x, y = f"case when {ok} then {f} end", f"case when {ok} then target end"
    return (f"select '{f}' as feature, count({x}) as n, {_corr(f, 'target')} as r, "
            f"({_corr(f, 'target')}) * ({_corr(f, 'target')}) as r2, regr_slope({y}, {x}) as slope, "
            f"regr_intercept({y}, {x}) as intercept, min({x}) as x_min, max({x}) as x_max from chem_wide")


@register("a4_feature_vs_target_chem", views=("chem_wide",),
          digits={"r": 6, "r2": 6, "slope": 4, "intercept": 2}, ops="A4",
          sql="select * from (" + "\nunion all ".join(_a4_sql(c) for c in C) + ") where n >= 2")
def a4_q(spark, sf):
    return A.feature_vs_target(V.chem_wide(spark, sf), C, "target")


def _hist_sql(src, col, bins, by=None):
    g = f"{by} as grp, " if by else ""
    grp_sel = "grp as \"group\", " if by else ""
    grid = (f"(select distinct {by} as grp from {src}) gs cross join range(0, {bins}) r(bin)" if by
            else f"range(0, {bins}) r(bin)")
    join_on = "c.grp = grid.grp and c.bin = grid.bin" if by else "c.bin = grid.bin"
    grid_sel = "gs.grp, " if by else ""
    return f"""with mm as (select min({col}) as lo, max({col}) as hi, (max({col}) - min({col})) / {bins} as w from {src}),
c as (select {g}cast(case when hi = lo then 0 else least(floor(({col} - lo) / w), {bins - 1}) end as integer) as bin,
             count(*) as n from {src}, mm where {col} is not null group by all),
grid as (select {grid_sel}cast(r.bin as integer) as bin, lo + cast(r.bin as integer) * w as "left",
                lo + (cast(r.bin as integer) + 1) * w as "right" from {grid}, mm)
select {("grid.grp as " + chr(34) + "group" + chr(34) + ", ") if by else ""}grid.bin, grid."left", grid."right",
       coalesce(c.n, 0) as n from grid left join c on {join_on}"""


@register("a5_histogram_target_chem", views=("chem_wide",), ops="A5",
          sql=_hist_sql("chem_wide", "target", 30))
def a5_q(spark, sf):
    return A.histogram(V.chem_wide(spark, sf), "target", 30)


@register("a6_histogram_by_class_lineitem", ops="A6",
          sql=_hist_sql("lineitem", "l_extendedprice", 15, by="l_returnflag"))
def a6_q(spark, sf):
    return A.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 15, by="l_returnflag")


BOX_SQL = """with long as ({long}),
q as (select "column"{g}, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median,
             quantile_cont(x, 0.75) as q3 from long group by all)
select q."column"{qg}, q.q1, q.median, q.q3,
  min(case when x >= q1 - 1.5 * (q3 - q1) then x end) as whisker_lo,
  max(case when x <= q3 + 1.5 * (q3 - q1) then x end) as whisker_hi,
  cast(count_if(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1)) as bigint) as n_fliers,
  count(*) as n
from long join q on long."column" = q."column"{jg} group by all"""


@register("a7_box_stats_gappy", views=("gappy",),
          digits={"q1": 6, "median": 6, "q3": 6, "whisker_lo": 6, "whisker_hi": 6}, ops="A7",
          sql=BOX_SQL.format(long="\nunion all ".join(
              f"select '{c}' as \"column\", cast({c} as double) as x from gappy where {c} is not null" for c in GN),
              g="", qg="", jg=""))
def a7_q(spark, sf):
    return A.box_stats(V.gappy(spark, sf), GN)


@register("a7_box_stats_by_class_lineitem",
          digits={"q1": 6, "median": 6, "q3": 6, "whisker_lo": 6, "whisker_hi": 6}, ops="A7",
          sql=BOX_SQL.format(long="select 'l_quantity' as \"column\", l_returnflag as \"group\", l_quantity as x "
                                  "from lineitem", g=', "group"', qg=', q."group"', jg=' and long."group" = q."group"'))
def a7c_q(spark, sf):
    return A.box_stats(table(spark, sf, "lineitem"), ["l_quantity"], by="l_returnflag")


@register("a8_kde_grid_events", digits={"x": 6, "density": 9}, ops="A8",
          sql="""with s as (select count(value) as n, stddev_samp(value) * pow(count(value), -0.2) as bw,
  min(value) as lo, max(value) as hi from events),
g as (select k, (lo - 3 * bw) + ((hi + 3 * bw) - (lo - 3 * bw)) * k / 49 as x from s, range(0, 50) r(k))
select g.x, sum(exp(-0.5 * pow((g.x - e.value) / s.bw, 2))) / (s.n * s.bw * sqrt(2 * pi())) as density
from g, s, events e where e.value is not null group by g.k, g.x, s.n, s.bw""")
def a8_q(spark, sf):
    return A.kde_grid(table(spark, sf, "events"), "value", 50)


@register("a11_distinct_levels_orders", ops="A11",
          sql="select distinct cast(o_orderpriority as varchar) as level from orders where o_orderpriority is not null")
def a11_q(spark, sf):
    return A.distinct_levels(table(spark, sf, "orders"), "o_orderpriority")


@register("a12_residual_summary_reg", views=("reg",), digits={"resid_mean": 4, "resid_std": 4}, ops="A12 V10",
          sql="select avg(y - yhat) as resid_mean, stddev_pop(y - yhat) as resid_std, count(y - yhat) as n from reg")
def a12_q(spark, sf):
    return A.residual_summary(V.reg(spark, sf), "y", "yhat")


@register("a12_residual_histogram_reg", views=("reg",), ops="A12 A5",
          sql=_hist_sql("(select y - yhat as resid from reg)", "resid", 40))
def a12h_q(spark, sf):
    r = V.reg(spark, sf).select((F.col("y") - F.col("yhat")).alias("resid"))
    return A.histogram(r, "resid", 40)


# ---------------------------------------------------------------- F

@register("f1_range_filter_lineitem", ops="F1",
          sql="select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 20")
def f1_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return FL.range_filter(li, "l_quantity", 10, 20)


@register("f2_category_filter_orders", ops="F2",
          sql="select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def f2_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FL.category_filter(o, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("f3_rule_list_gappy", views=("gappy",), ops="F3",
          sql="""with lim as (select min(disc) as lo, max(disc) as hi from gappy)
select l_orderkey, l_linenumber, disc, flag from gappy, lim
where disc between lim.lo and lim.hi and l_quantity between 5 and 25 and flag in ('R')""")
def f3_q(spark, sf):
    g = V.gappy(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "disc", "flag")
    rules = [FL.Rule("disc"), FL.Rule("l_quantity", 5, 25), FL.Rule("flag", values=["R"])]
    return FL.apply_rules(g, rules).drop("l_quantity")


@register("f7_projection_dedup_chem", views=("chem_wide",), ops="F7",
          sql="select c2, c1, target from chem_wide")
def f7_q(spark, sf):
    return FL.project(V.chem_wide(spark, sf), ["c2", "c1", "c2"], "target")


@register("f8_task_hint_orders", ops="F8",
          sql="select count(distinct o_totalprice) as n_distinct, case when count(distinct o_totalprice) > 5 "
              "then 'regression' else 'classification' end as task from orders")
def f8_q(spark, sf):
    return FL.task_hint(table(spark, sf, "orders"), "o_totalprice")


@register("f9_constraints_lineitem", ops="F9",
          sql="""select l_orderkey, l_linenumber from lineitem
where l_quantity between 1 and 40 and l_discount between 0 and 0.08
  and abs(coalesce(l_discount, 0) + coalesce(l_tax, 0) - 0.1) <= 0.02""")
def f9_q(spark, sf):
    li = table(spark, sf, "lineitem")
    out = FL.apply_constraints(li, {"l_quantity": (1, 40), "l_discount": (0, 0.08), "absent": (0, 1)},
                               ["l_discount", "l_tax", "absent"], 0.1, 0.02)
    return out.select("l_orderkey", "l_linenumber")


@register("f10_key_search_customer", ops="F10",
          sql="select c_custkey, c_name from customer where contains(lower(c_name), lower('#00000001'))")
def f10_q(spark, sf):
    return FL.key_search(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "#00000001",
                         mode="contains")


@register("f11_reaches_half_decay", ops="F11 H4",
          sql="""with first as (select id, arg_min(y, t) as y0, max(t) as tmax from decay_long group by id)
select f.id, coalesce(f.y0 != 0 and exists (select 1 from decay_long d where d.id = f.id and d.t > (select min(t)
  from decay_long d2 where d2.id = f.id) and d.y > 0.35 * f.y0 and d.y < 0.65 * f.y0), false) as reaches_half
from first f""", views=("decay_long",))
def f11_q(spark, sf):
    d = V.decay_long(spark, sf)
    arr = (d.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"))
           .select("id", F.expr("transform(s, p -> p.y)").alias("y")))
    return arr.select("id", FL.reaches_half("y").alias("reaches_half"))


@register("f12_pairs_extract_gappy", views=("gappy",), ops="F12 A9",
          sql="select disc, tax, flag from gappy where disc is not null and tax is not null and flag is not null")
def f12_q(spark, sf):
    return A.pair_plot_data(V.gappy(spark, sf), ["disc", "tax"], hue="flag")


@register("f13_drop_empty_columns", views=("chem_wide",), ops="F13",
          sql="select id, method, target, c1 from chem_wide")
def f13_q(spark, sf):
    df = V.chem_wide(spark, sf).select("id", "method", "target", "c1",
                                      F.lit(None).cast("double").alias("all_null"))
    return FL.drop_empty_columns(df)
