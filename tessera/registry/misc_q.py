"""Queries for sources (S), string scalars (X), relational operators (J) and
remaining feature builders (G8–G10, G13, G15, E5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.core import col
from ..functions import text as X
from ..functions.windows import running
from ..operators import clean as M
from ..operators import features as G
from ..session import ensure_checkpoint_dir
from ..sources import files as S
from ..sources import views as V
from ..sources.tables import table
from . import register


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-src/{name}-{uuid.uuid4().hex}"


@register("s1_csv_roundtrip_customer", ops="S1 S6 S8",
          sql="select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def s1_q(spark, sf):
    path = _scratch(spark, "customer")
    S.write_csv(table(spark, sf, "customer"), path, bom=True)
    df = S.load_csv(spark, path)
    return df.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
                     F.col("c_acctbal").cast("double"), "c_mktsegment")


@register("s2_clean_on_read_part", ops="S2 S3 S6",
          sql="select cast(p_partkey as varchar) as \"part key\", p_brand as brand, "
              "nullif(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), '') as type from part")
def s2_q(spark, sf):
    p = table(spark, sf, "part")
    dirty = p.select(F.col("p_partkey").alias("part key*"),
                     F.concat(F.lit(" "), F.col("p_brand"), F.lit(" *")).alias("Brand"),
                     F.concat(F.col("p_type"), F.lit("  ")).alias("type"))
    path = _scratch(spark, "part")
    S.write_csv(dirty, path)
    df = S.load_clean(spark, path)
    return df.select("part key", F.col("Brand").alias("brand"), "type")


@register("s5_drop_empty_rows_gappy", views=("gappy",), ops="S5",
          sql="select disc, tax, flag from gappy where disc is not null or tax is not null or flag is not null")
def s5_q(spark, sf):
    return S.drop_empty_rows(V.gappy(spark, sf).select("disc", "tax", "flag"))


@register("s7_preview_orders", ops="S7",
          sql="select o_orderkey, o_totalprice from orders order by o_orderkey limit 20")
def s7_q(spark, sf):
    return S.preview(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 20)


# ---------------------------------------------------------------- X

@register("x1_clean_labels_part", ops="X1 X18",
          sql="""select p_partkey, nullif(nullif(trim(regexp_replace(regexp_replace(replace(lower(trim(
  replace(p_type, ' ', '-') || '*')), chr(160), ' '), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'nan') as label,
  replace(p_name || '*', '*', '') as no_stars from part""")
def x1_q(spark, sf):
    p = table(spark, sf, "part")
    dirty = F.concat(F.regexp_replace("p_type", " ", "-"), F.lit("*"))
    return p.select("p_partkey", X.clean_label(dirty).alias("label"),
                    X.strip_stars(F.concat("p_name", F.lit("*"))).alias("no_stars"))


@register("x2_x3_x4_numbers_customer", ops="X2 X3 X4",
          sql="""select c_custkey,
  try_cast(nullif(trim(replace(cast(c_acctbal as varchar) || chr(160), chr(160), '')), '') as double) as volume,
  try_cast(trim(c_mktsegment) as double) as as_number,
  try_cast(nullif(regexp_replace(c_name, '[^0-9.]', '', 'g'), '') as double) as digits
  from customer""")
def x234_q(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.to_volume(F.concat(F.col("c_acctbal").cast("string"), F.lit(" "))).alias("volume"),
                    X.to_number("c_mktsegment").alias("as_number"), X.digits_only_number("c_name").alias("digits"))


@register("x5_minutes_from_headers_lineitem", ops="X5 H1",
          sql="""select distinct h, case when regexp_matches(lower(h), '(\\d+\\.?\\d*)\\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes)\\b')
   then cast(regexp_extract(lower(h), '(\\d+\\.?\\d*)\\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes)\\b', 1) as double)
        * case when starts_with(regexp_extract(lower(h), '(\\d+\\.?\\d*)\\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes)\\b', 2), 'h') then 60 else 1 end
   when regexp_matches(lower(h), '\\btime\\b|\\bt\\s*=') and regexp_matches(lower(h), '(\\d+\\.?\\d*)')
   then cast(regexp_extract(lower(h), '(\\d+\\.?\\d*)', 1) as double) end as minutes
from (select case l_linenumber % 3 when 0 then 'Time (' || cast(l_linenumber * 30 as varchar) || 'm)'
                                 when 1 then 'time ' || cast(l_linenumber as varchar) || ' h'
                                 else 'Time (' || cast(l_linenumber as varchar) || '.0)' end as h from lineitem)""")
def x5_q(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    h = (F.when(n % 3 == 0, F.concat(F.lit("Time ("), (n * 30).cast("string"), F.lit("m)")))
         .when(n % 3 == 1, F.concat(F.lit("time "), n.cast("string"), F.lit(" h")))
         .otherwise(F.concat(F.lit("Time ("), n.cast("string"), F.lit(".0)"))))
    return li.select(h.alias("h")).distinct().select("h", X.minutes_from_header("h").alias("minutes"))


@register("x16_slugs_part", ops="X16",
          sql="""select p_partkey, regexp_replace(substr(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), 1, 40),
  '^_+|_+$', '', 'g') as slug,
  substr(regexp_replace(regexp_replace(trim(p_name || ' #' || p_brand), '[^\\w\\s\\-]', '', 'g'), '\\s+', '_', 'g'), 1, 60)
  as file_slug from part""")
def x16_q(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.slug("p_name", 40).alias("slug"),
                    X.slug_words(F.concat("p_name", F.lit(" #"), "p_brand"), 60).alias("file_slug"))


# ---------------------------------------------------------------- J

@register("j1_left_join_lineitem_part", ops="J1",
          sql="select l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_brand from lineitem l "
              "left join part p on l.l_partkey = p.p_partkey")
def j1_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey, "left").drop("p_partkey")


@register("j3_lookup_last_duplicate_wins_events", digits={"weight": 6}, ops="J3",
          sql="""with lk as (select event_type as label, arg_max(value, event_id) as weight from events group by event_type)
select e.event_id, e.event_type, lk.weight from events e left join lk on e.event_type = lk.label""")
def j3_q(spark, sf):
    e = table(spark, sf, "events")
    lk = e.groupBy(F.col("event_type").alias("label")).agg(F.max_by("value", "event_id").alias("weight"))
    return e.join(lk, e.event_type == lk.label, "left").select("event_id", "event_type", "weight")


@register("j5_union_by_name_orders_customer", ops="J5",
          sql="""select o_orderkey as key, o_orderpriority as segment, cast(null as double) as balance from orders
union all select c_custkey, c_mktsegment, c_acctbal from customer""")
def j5_q(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("segment"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"),
                                            F.col("c_acctbal").alias("balance"))
    return o.unionByName(c, allowMissingColumns=True)


@register("j6_pivot_days_foam", views=("foam_long",), digits={f"d{d}": 6 for d in range(15)}, ops="J6 P11",
          sql="select id, " + ", ".join(f"max(case when d = {d} then y end) as d{d}" for d in range(15))
              + " from foam_long group by id")
def j6_q(spark, sf):
    f = V.foam_long(spark, sf)
    w = f.groupBy("id").pivot("d", list(range(15))).agg(F.first("y"))
    return w.select("id", *[F.col(str(d)).alias(f"d{d}") for d in range(15)])


@register("j7_first_non_null_per_group_foam", views=("foam_long",), ops="J7",
          sql="""select id, arg_min(texture, d) filter (where texture is not null) as first_texture,
  max(case when d = 0 then texture end) as day0_texture from foam_long group by id""")
def j7_q(spark, sf):
    f = V.foam_long(spark, sf)
    return f.groupBy("id").agg(F.min_by("texture", F.when(F.col("texture").isNotNull(), F.col("d"))).alias("first_texture"),
                               F.max(F.when(F.col("d") == 0, F.col("texture"))).alias("day0_texture"))


@register("j8_unpivot_chem", views=("chem_wide",), ops="J8",
          sql="\nunion all ".join(f"select id, '{c}' as col, {c} as value from chem_wide" for c in V.CHEM_COLS))
def j8_q(spark, sf):
    return V.chem_wide(spark, sf).unpivot(["id"], V.CHEM_COLS, "col", "value")


@register("j9_running_max_events", ops="J9",
          sql="""select event_id, user_id, value, max(value) over (partition by user_id order by event_id
  rows between unbounded preceding and current row) as best_so_far from events""")
def j9_q(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return running(e, ["user_id"], "event_id", F.col("value"), "best_so_far", "max", bucket_width=1000)


# ---------------------------------------------------------------- G8–G10, G13, G15, E5

@register("g9_brine_features_lineitem", digits={"ionic_strength": 6, "div_mono_ratio": 6, "log1p_divalent": 9,
                                                "log1p_monovalent": 9}, ops="G9",
          sql="""select l_orderkey, l_linenumber, l_tax as "Divalent", l_discount as "Monovalent",
  l_discount + 2 * l_tax as ionic_strength, l_tax / (l_discount + 1e-9) as div_mono_ratio,
  ln(1 + l_tax) as log1p_divalent, ln(1 + l_discount) as log1p_monovalent from lineitem""")
def g9_q(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return G.brine_features(li, "l_tax", "l_discount").drop("l_tax", "l_discount")


@register("g10_role_features_chem", views=("chem_wide",), ops="G8 G10 F6",
          sql='select c1 as "c1 pct", c2 as "c2 pct", c2 as "c2", target as "target" from chem_wide')
def g10_q(spark, sf):
    c = V.chem_wide(spark, sf).select("c1", "c2", "target").withColumn("c2 (%)", F.col("c2"))
    c = c.withColumnRenamed("c1", "c1%").withColumnRenamed("c2", "c2 %")
    out, _ = G.role_features(c, {"dose": ["c1%", "c2 %", "c2 (%)"], "oil": ["missing"]}, {"oil": ["target"]})
    return out


@register("g13_custom_operations_chem", views=("chem_wide",), digits={"c1 / c2": 9, "c1 + c3": 6}, ops="G13",
          sql='select id, c1 + c3 as "c1 + c3", c1 / nullif(c2, 0) as "c1 / c2" from chem_wide')
def g13_q(spark, sf):
    c = V.chem_wide(spark, sf).select("id", "c1", "c2", "c3")
    return G.custom_operations(c, ["c1 + c3", "c1 / c2", "nope + c1", "bad"]).select("id", "c1 + c3", "c1 / c2")


@register("g15_drop_features_chem", views=("chem_wide",), ops="G15",
          sql="select id, method, target, c1, c2, c3 from chem_wide")
def g15_q(spark, sf):
    return G.drop_features(V.chem_wide(spark, sf), ["c4", "c5", "c6", "c7", "absent"])


@register("e5_method_one_hot_orders", ops="E5 X16",
          sql="select o_orderkey, " + ", ".join(
              f"cast(o_orderpriority = '{p}' as double) as \"Concen_Ratio_Method_{s}\""
              for p, s in [("1-URGENT", "1_urgent"), ("2-HIGH", "2_high"), ("3-MEDIUM", "3_medium"),
                           ("4-NOT SPECIFIED", "4_not_specified"), ("5-LOW", "5_low")]) + " from orders")
def e5_q(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return M.method_one_hot(o, "o_orderpriority").drop("o_orderpriority")


# ---------------------------------------------------------------- T18, T20, H3

@register("t18_automl_report_chem", ops="T18 G6 G14 M5 M6 E5 E6 T3 N1 N2")
def t18_q(spark, sf):
    from ..plans.jobs import AutoMLConfig, automl
    c = V.chem_wide(spark, sf)
    out = automl(c, "id", "target", {"anionic": ["c1", "c2"], "nonionic": ["c3", "c4"]}, [],
                 [("c1", "c2"), ("c3", "c4")], method_col="method",
                 cfg=AutoMLConfig(n_estimators=20, max_depth=8, max_target=float("inf")))  # prices are no measurements
    return out["metrics"]


@register("t18_automl_classes_lineitem", ops="T18 T3 V1 V2 N1 N2")
def t18_classes_q(spark, sf):
    from ..plans.jobs import AutoMLConfig, automl
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), "l_returnflag", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_linestatus")
    out = automl(li, "id", "l_returnflag", {"money": ["l_extendedprice", "l_tax"]}, ["l_discount"],
                 [("l_quantity", "l_tax")], method_col="l_linestatus",
                 cfg=AutoMLConfig(task="classification", n_estimators=20, max_depth=6))
    return out["metrics"]


@register("t20_run_history_chem", ops="T20 T14 V12")
def t20_q(spark, sf):
    from ..operators import models as T
    from ..operators import splits as SP
    from ..operators.metrics import metric_changes
    c = V.chem_wide(spark, sf)
    d = SP.kfold(c.select("id", "target", *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in V.CHEM_COLS]),
                 "id", 3)
    path = _scratch(spark, "runs")
    for i, name in enumerate(["LinearRegression", "Ridge"]):
        res = T.run_validation(d, V.CHEM_COLS, "target", name, fold_col="fold", metric="r2")
        T.append_run(spark, path, {"name": name, "params": {}, "validation": "kfold", "mean": res["mean"],
                                   "std": res["std"]})
    runs = spark.read.parquet(path).withColumn("metric", F.lit("r2"))
    return metric_changes(runs.select(F.col("ts").alias("run"), "metric", F.col("mean").alias("value"), "name"))


@register("h3_equation_texts_decay", ops="H3 H2")
def h3_q(spark, sf):
    from ..operators import halflife as H
    ev = H.evaluate(H.points_from_long(V.decay_long(spark, sf)), 0.8)
    return H.equation_columns(ev).select("id", "equ_linear", "equ_exp", "equ_poly")
