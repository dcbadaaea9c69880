"""Queries for design-space search (D), explanation (N) and ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.core import col
from ..operators import design as D
from ..operators import explain as N
from ..operators import models as T
from ..operators import search as SE
from ..operators import trend as LT
from ..operators import trees as X
from ..session import shared_table, spread
from ..sources import views as V
from ..sources.tables import table
from . import register
from .prepare import _hash_sql

LI_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _uniform_sql(src, feats, n_expr, seed=42):
    b = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in feats)
    cols = ", ".join(f"case when abs(hi_{c} - lo_{c}) <= 1e-8 + 1e-9 * abs(hi_{c}) then lo_{c} else "
                     f"lo_{c} + (hi_{c} - lo_{c}) * {_hash_sql('r.range', seed, c)} end as {c}" for c in feats)
    return (f"with b as (select {b}, {n_expr} as n from {src})\n"
            f"select r.range as id, {cols} from b, range(0, (select n from b)) r")


@register("d1_uniform_design_lineitem", digits={c: 9 for c in LI_FEATS}, ops="D1",
          sql=_uniform_sql("lineitem", LI_FEATS, "count(*)"))
def d1_q(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.count()
    return D.sample_uniform(spark, D.observed_bounds(li, LI_FEATS), n)


MIX = ["a", "b", "c"]


@register("d2_dirichlet_design_orders", digits={c: 9 for c in MIX}, ops="D2",
          sql="with n as (select count(*) as n from orders),\n"
              "e as (select r.range as id, " + ", ".join(
                  f"-ln(greatest({_hash_sql('r.range', 42, 'dir_' + c)}, 1e-300)) as e_{c}" for c in MIX)
              + " from range(0, (select n from n)) r)\nselect id, " + ", ".join(
                  (f"least(greatest(e_{c} / (e_a + e_b + e_c) * 100.0, 0.0), 60.0) as {c}" if c == "a"
                   else f"e_{c} / (e_a + e_b + e_c) * 100.0 as {c}") for c in MIX) + " from e")
def d2_q(spark, sf):
    n = table(spark, sf, "orders").count()
    return D.sample_dirichlet(spark, MIX, 100.0, n, bounds={"a": (0.0, 60.0)})


@register("d7_recommended_ranges_design", ops="D7 D1",
          sql=_uniform_sql("lineitem", LI_FEATS, "count(*)").replace("\nselect", ",\ns as (select", 1)
              + ")\n" + "\nunion all ".join(
                  f"select '{c}' as feature, round_even(quantile_cont({c}, 0.05), 2) as low, "
                  f"round_even(quantile_cont({c}, 0.5), 2) as median, round_even(quantile_cont({c}, 0.95), 2) as high, "
                  f"round_even(min({c}), 2) as observed_min, round_even(max({c}), 2) as observed_max from s"
                  for c in LI_FEATS))
def d7_q(spark, sf):
    li = table(spark, sf, "lineitem")
    s = D.sample_uniform(spark, D.observed_bounds(li, LI_FEATS), li.count())
    return D.recommended_ranges(s, LI_FEATS)


def _probs_frame(spark, sf):
    c = V.chem_wide(spark, sf)
    raw = [F.coalesce(col(x), F.lit(0.0)) + F.lit(1.0) for x in ("c1", "c2", "c3")]
    tot = raw[0] + raw[1] + raw[2]
    return c.select("id", F.array(*[r / tot for r in raw]).alias("probability"))


PROBS_SQL = """probs as (select id, [(coalesce(c1, 0) + 1) / t, (coalesce(c2, 0) + 1) / t, (coalesce(c3, 0) + 1) / t] as p
  from (select *, (coalesce(c1, 0) + 1) + (coalesce(c2, 0) + 1) + (coalesce(c3, 0) + 1) as t from chem_wide))"""
SCORED_SQL = PROBS_SQL + """,
scored as (select id, cast(list_position(p, list_max(p)) - 1 as integer) as pred_class_idx,
  ['low', 'mid', 'high'][list_position(p, list_max(p))] as pred_class, p[3] as safe_probability,
  p[3] - greatest(p[1], p[2]) as safety_margin from probs)"""


@register("d4_score_classification_given_probs", views=("chem_wide",),
          digits={"safe_probability": 9, "safety_margin": 9}, ops="D4",
          sql="with " + SCORED_SQL + " select * from scored")
def d4_q(spark, sf):
    return D.score_classification(_probs_frame(spark, sf), ["low", "mid", "high"], "high").drop("probability")


@register("d6_safe_set_given_probs", views=("chem_wide",), digits={"safe_probability": 9, "safety_margin": 9},
          ops="D6", sql="with " + SCORED_SQL + " select * from scored where pred_class_idx = 2 and safe_probability >= 0.6")
def d6_q(spark, sf):
    s = D.score_classification(_probs_frame(spark, sf), ["low", "mid", "high"], "high").drop("probability")
    return D.safe_set(s, 2, 0.6)


@register("d6_safe_set_fallback_given_probs", views=("chem_wide",),
          digits={"safe_probability": 9, "safety_margin": 9}, ops="D6",
          sql="with " + SCORED_SQL + """ select * from scored where pred_class_idx = 2
order by safe_probability desc, safety_margin desc, id limit 200""")
def d6f_q(spark, sf):
    s = D.score_classification(_probs_frame(spark, sf), ["low", "mid", "high"], "high").drop("probability")
    return D.safe_set(s, 2, 1.01)


_UNC = {
    "entropy": "-list_sum(list_transform(p, lambda x: x * ln(x + 1e-9)))",
    "margin": "1.0 - (list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2])",
    "least": "1.0 - list_max(p)",
}
for _m, _e in _UNC.items():
    register(f"d10_next_experiments_{_m}", views=("chem_wide",), digits={"uncertainty_score": 9}, ops="D10",
             sql=f"with {PROBS_SQL} select id, {_e} as uncertainty_score from probs "
                 f"order by uncertainty_score desc, id limit 5")(
        (lambda m: lambda spark, sf: D.next_experiments(_probs_frame(spark, sf), "probability", method=m)
         .select("id", "uncertainty_score"))(_m))


@register("d11_refilter_chem", views=("chem_wide",), ops="D11",
          sql="select id, c1, c2 from chem_wide where c1 between 10 and 20 and c2 between 5 and 30")
def d11_q(spark, sf):
    return D.refilter(V.chem_wide(spark, sf).select("id", "c1", "c2"), {"c1": (10, 20), "c2": (5, 30)})


@register("j11_top_k_multi_key_orders", ops="J11",
          sql="""select o_orderkey, o_totalprice, o_orderdate, cast(row_number() over (order by o_totalprice desc,
  o_orderdate desc, o_orderkey) as integer) as rank from orders order by o_totalprice desc, o_orderdate desc, o_orderkey limit 10""")
def j11_q(spark, sf):
    from pyspark.sql import Window
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    top = o.orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").limit(10)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey")))  # over 10 rows


@register("j12_top_fraction_orders", ops="J12",
          sql="""select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey
limit greatest(1, cast(floor((select count(*) from orders) * 0.10) as bigint))""")
def j12_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.top_fraction(o, "o_totalprice", 0.10, "o_orderkey")


@register("j13_above_quantile_orders", ops="J13",
          sql="""select o_orderkey, o_totalprice from orders
where o_totalprice >= (select quantile_cont(o_totalprice, 0.9) from orders)""")
def j13_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return D.above_quantile(o, "o_totalprice", 0.9)


def _li_model(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_FEATS, "l_returnflag")
    return li, T.fit(li, LI_FEATS, "l_returnflag", "LogisticRegression")


@register("d_design_search", ops="D1 D4 D6 D7 D9 E10")
def design_search_q(spark, sf):
    """Sample as many design points as lineitem has rows, score them with a
    classifier trained on lineitem, keep the safe set, report ranges."""
    li, f = _li_model(spark, sf)
    pts = D.sample_uniform(spark, D.observed_bounds(li, LI_FEATS), li.count())
    scored = f.model.transform(pts)
    s = D.score_classification(scored, f.classes, "R")
    safe = D.safe_set(s, f.classes.index("R"), 0.4)
    return D.recommended_ranges(safe, LI_FEATS, approx=True)  # sketch: the safe set can be most of n


@register("d5_d9_random_search_regression", ops="D5 D9 D3")
def d9_q(spark, sf):
    c = V.chem_wide(spark, sf)
    d = c.select("target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in ("c1", "c2", "c3")])
    f = T.fit(d, ["c1", "c2", "c3"], "target", "LinearRegression")
    n = c.count()
    pts = D.mixed_design(spark, ["c1", "c2"], 60.0, {"c3": D.observed_bounds(d, ["c3"])["c3"]}, n)
    sc = D.score_regression(f.model.transform(pts).withColumnRenamed("__pred", "prediction"))
    return sc.orderBy(F.desc("objective_score"), "id").limit(1).select("id", "c1", "c2", "c3", "objective_score")


@register("d8_recommendation_text", ops="D8")
def d8_q(spark, sf):
    li = table(spark, sf, "lineitem")
    return D.recommendation_lines(D.recommended_ranges(li, LI_FEATS), "l_returnflag = R")


# ---------------------------------------------------------------- N

N1_SQL = """with s as (select regr_slope(y, yhat) as b, avg(yhat) as m from reg),
attr as (select id, 'yhat' as feature, yhat as value, b * (yhat - m) as attribution from reg, s)"""


@register("n1_linear_attribution_reg", views=("reg",), digits={"attribution": 4}, ops="N1",
          sql=N1_SQL + " select * from attr")
def n1_q(spark, sf):
    r = V.reg(spark, sf)
    f = T.fit(r, ["yhat"], "y", "LinearRegression")
    coef = float(f.model.stages[-1].coefficients[0])
    return N.linear_attributions(r, ["yhat"], {"yhat": coef})


@register("n2_importance_linear_reg", views=("reg",), digits={"importance": 4}, ops="N2",
          sql=N1_SQL + " select feature, avg(abs(attribution)) as importance from attr group by feature")
def n2_q(spark, sf):
    return N.importance(n1_q(spark, sf))


@register("n3_binned_dependence_reg", views=("reg",), digits={"mean_attribution": 4}, ops="N3",
          sql=N1_SQL + """, mm as (select min(value) as lo, max(value) as hi from attr),
c as (select greatest(1, least(20, cast(ceil((value - lo) / ((hi - lo) / 20)) as integer))) as bin,
  avg(attribution) as m, count(*) as n from attr, mm group by 1)
select g.range::integer as bin, coalesce(c.m, 0.0) as mean_attribution, coalesce(c.n, 0) as n
from range(1, 21) g left join c on c.bin = g.range""")
def n3_q(spark, sf):
    return N.binned_dependence(n1_q(spark, sf), "yhat", 20)


def _rf_chem(spark, sf):
    c = V.chem_wide(spark, sf)
    d = c.select("id", "method", "target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in V.CHEM_COLS])
    f = T.fit(d, V.CHEM_COLS, "target", "RandomForestRegressor", {"n_estimators": 20, "max_depth": 6})
    return d, f


@register("n1_permutation_attribution_rf", ops="N1 N2")
def n1p_q(spark, sf):
    d, f = _rf_chem(spark, sf)
    attr = N.permutation_attributions(f.model, d, V.CHEM_COLS, "id", n_perm=8, output="__pred")
    return N.importance(attr)


@register("n4_partner_feature_rf", ops="N4")
def n4_q(spark, sf):
    d, f = _rf_chem(spark, sf)
    attr = N.permutation_attributions(f.model, d, V.CHEM_COLS, "id", n_perm=4, output="__pred")
    return N.partner_feature(attr, "c1", d, V.CHEM_COLS)


@register("n5_partial_dependence_rf", ops="N5")
def n5_q(spark, sf):
    d, f = _rf_chem(spark, sf)
    return N.partial_dependence(f.model, d, "c1", "id", 50, output="__pred")


@register("n6_partial_dependence_2d_rf", ops="N6")
def n6_q(spark, sf):
    d, f = _rf_chem(spark, sf)
    return N.partial_dependence_2d(f.model, d, "c1", "c2", 30, output="__pred")


@register("n7_surrogate_rules_chem", ops="N7")
def n7_q(spark, sf):
    c = V.chem_wide(spark, sf)
    d = c.select("target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in V.CHEM_COLS])
    return N.surrogate_rules(d, V.CHEM_COLS, "target", 3)


@register("n8_top_features_per_class_rf", ops="N8")
def n8_q(spark, sf):
    d, f = _rf_chem(spark, sf)
    attr = N.permutation_attributions(f.model, d, V.CHEM_COLS, "id", n_perm=4, output="__pred")
    by = attr.join(d.select("id", "method"), "id")
    return N.top_per_class(N.importance(by, "method"), "method", 3)


def _given_tree(spark, sf, *keep):
    """A small tree over lineitem with node counts from the data, and the rows with the key and the class; attributions carry the ``keep`` columns of their row."""
    li = table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("id"), "l_returnflag", "l_linestatus",
                                             F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"),
                                             F.col("l_tax").cast("double").alias("l_tax"))
    left = F.col("l_quantity") <= 25
    r = li.agg(F.count("*"), F.count_if(left), F.count_if(left & (F.col("l_discount") <= 0.05)), F.count_if(~left & (F.col("l_tax") <= 0.03))).first()
    n, a, aa, ba = (float(x) for x in r)
    tree = X.Tree(feature=np.array([0, 1, -1, -1, 2, -1, -1]), threshold=np.array([25, 0.05, 0, 0, 0.03, 0, 0]), left=np.array([1, 2, -1, -1, 5, -1, -1]),
                  right=np.array([4, 3, -1, -1, 6, -1, -1]), cover=np.array([n, a, aa, a - aa, n - a, ba, n - a - ba]), value=np.array([0, 0, 1.0, 4.0, 0, 9.0, -2.0]))
    li = shared_table(li, "rows")  # the key is a row number: it must be the same in every use
    return li, X.tree_attributions([tree], li, ["l_quantity", "l_discount", "l_tax"], "id", keep)


# A leaf with two features a and b on its path gives a: value * (o_a - z_a) * (z_b + o_b) / 2.
TREE_SQL = """with d as (select l_returnflag, cast(l_quantity as double) as l_quantity, cast(l_discount as double) as l_discount, cast(l_tax as double) as l_tax,
  cast(l_quantity <= 25 as double) as q, cast(l_discount <= 0.05 as double) as a, cast(l_tax <= 0.03 as double) as b from lineitem),
z as (select avg(q) as zq, sum(q * a) / sum(q) as za, sum((1 - q) * b) / sum(1 - q) as zb from d),
w as (select d.*, (q - zq) * ((za + a) / 2 + 4 * (2 - za - a) / 2) + (zq - q) * (9 * (zb + b) / 2 - 2 * (2 - zb - b) / 2) as pq,
  -3 * (a - za) * (zq + q) / 2 as pa, 11 * (b - zb) * (2 - zq - q) / 2 as pb from d, z),
attr as (select l_returnflag, f.feature, f.x as value, f.phi as attribution
  from w, lateral (values ('l_quantity', l_quantity, pq), ('l_discount', l_discount, pa), ('l_tax', l_tax, pb)) f(feature, x, phi))
"""


@register("n1_tree_attribution_given_tree", digits={"mean": 9, "importance": 9, "least": 9, "most": 9, "mean_value": 9}, ops="N1 N2",
          sql=TREE_SQL + """select l_returnflag, feature, count(*) as n, avg(attribution) as mean, avg(abs(attribution)) as importance, min(attribution) as least, max(attribution) as most,
  avg(value) as mean_value from attr group by all""")
def n1t_q(spark, sf):
    _, attr = _given_tree(spark, sf, "l_returnflag")
    out = attr.groupBy("l_returnflag", "feature")
    return out.agg(F.count("*").alias("n"), F.avg("attribution").alias("mean"), F.avg(F.abs("attribution")).alias("importance"), F.min("attribution").alias("least"),
                   F.max("attribution").alias("most"), F.avg("value").alias("mean_value"))


@register("n8_top_features_given_tree", digits={"importance": 9}, ops="N8 N2",
          sql=TREE_SQL + """, i as (select l_returnflag, feature, avg(abs(attribution)) as importance from attr group by all)
select l_returnflag, feature, importance, cast(row_number() over (partition by l_returnflag order by importance desc, feature) as int) as rank from i
qualify rank <= 2""")
def n8t_q(spark, sf):
    _, attr = _given_tree(spark, sf, "l_returnflag")
    return N.top_per_class(N.importance(attr, "l_returnflag"), "l_returnflag", 2)


@register("n4_partner_given_tree", digits={"abs_r": 9}, ops="N4",
          sql=TREE_SQL + """select partner, abs_r from (select 'l_discount' as partner, abs(corr(l_discount, pq)) as abs_r from w union all select 'l_tax', abs(corr(l_tax, pq)) from w)
order by abs_r desc, partner limit 1""")
def n4t_q(spark, sf):
    _, attr = _given_tree(spark, sf, "l_discount", "l_tax")
    return N.partner_feature(attr, "l_quantity", None, ["l_discount", "l_tax"])


def _rf_full(spark, sf):
    d = V.chem_wide(spark, sf).select("id", "method", "target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in V.CHEM_COLS])
    return d, T.fit(d, V.CHEM_COLS, "target", "RandomForestRegressor", {"max_depth": 6})


@register("n1_tree_attribution_rf", ops="N1 N2 N8 T3")
def n1f_q(spark, sf):
    """Exact attributions of a forest of 100 trees, all rows, with the mean by method."""
    d, f = _rf_full(spark, sf)
    attr = X.tree_attributions(X.node_tables(f.model, spark), spread(d), V.CHEM_COLS, "id")
    return N.top_per_class(N.importance(attr.join(d.select("id", "method"), "id"), "method"), "method", 3)


@register("d9_guided_search_regression", ops="D9 D5")
def d9g_q(spark, sf):
    """Points that a model-guided search tries, scored by a fitted model of the prices."""
    c = V.chem_wide(spark, sf)
    d = c.select("target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in ("c1", "c2", "c3")])
    f = T.fit(d, ["c1", "c2", "c3"], "target", "RandomForestRegressor", {"n_estimators": 20, "max_depth": 6})
    score = lambda points: D.score_regression(f.model.transform(points).withColumnRenamed("__pred", "prediction"))
    return SE.guided_search(spark, D.observed_bounds(d, ["c1", "c2", "c3"]), score)


# Straight-line fits weighted by the tricube of the distance over the farthest of the nearest 40 % of rows.
TREND_SQL = """with d as (select cast(l_discount as double) as x, cast(l_extendedprice as double) as y from lineitem), n as (select cast(floor(0.4 * count(*)) as bigint) as k from d),
g as (select distinct x as px from d), c as (select px, abs(x - px) as dist, count(*) as m from g, (select x from d) group by all),
r as (select px, min(dist) as h from (select px, dist, sum(m) over (partition by px order by dist) as upto from c), n where upto >= k group by px),
w as (select px, h, x - px as u, y, case when abs(x - px) < h then pow(1 - pow(abs(x - px) / h, 3), 3) else 0 end as w from r join d on abs(x - px) <= h),
s as (select px, h, sum(w * u) / sum(w) as mu, sum(w * y) / sum(w) as my, sum(w * u * u) / sum(w) as muu, sum(w * u * y) / sum(w) as muy from w group by all)
select px as x, my - mu * (muy - mu * my) / (muu - mu * mu) as trend, h as radius from s"""


@register("n3_local_trend_lineitem", digits={"x": 9, "trend": 3, "radius": 9}, ops="N3", sql=TREND_SQL)
def n3t_q(spark, sf):
    """Local trend of price over discount, one pass without robust weights."""
    return LT.local_trend(table(spark, sf, "lineitem"), "l_discount", "l_extendedprice", robust=0)
