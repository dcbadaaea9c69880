"""Queries for evaluation metrics (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as VM
from ..sources import views as V
from ..sources.tables import table
from . import register


def _per_class_sql(src):
    return f"""
cells as (select cast(label as varchar) as y, cast(pred as varchar) as p, count(*) as n from {src} group by all),
t as (select y as cls, sum(n) as support, sum(case when y = p then n else 0 end) as tp from cells group by y),
pp as (select p as cls, sum(n) as pred_n from cells group by p),
pc as (select coalesce(t.cls, pp.cls) as cls, coalesce(t.tp, 0) as tp, coalesce(pp.pred_n, 0) as pred_n,
              coalesce(t.support, 0) as support from t full join pp on t.cls = pp.cls),
m as (select cls, tp, pred_n, support, coalesce(tp / nullif(pred_n, 0), 0.0) as prec,
             coalesce(tp / nullif(support, 0), 0.0) as rec from pc),
f as (select *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) as f1 from m)"""


@register("v1_accuracy_binary", views=("clf_binary",), digits={"accuracy": 6}, ops="V1",
          sql="select avg(case when label = pred then 1.0 else 0.0 end) as accuracy from clf_binary")
def v1_q(spark, sf):
    return VM.accuracy(V.clf_binary(spark, sf))


@register("v2_weighted_scores_multi", views=("clf_multi",),
          digits={"accuracy": 6, "precision": 6, "recall": 6, "f1": 6}, ops="V1 V2",
          sql="with" + _per_class_sql("clf_multi") + """
select sum(tp) / sum(support) as accuracy, sum(prec * support) / sum(support) as precision,
       sum(rec * support) / sum(support) as recall, sum(f1 * support) / sum(support) as f1 from f""")
def v2_q(spark, sf):
    return VM.weighted_scores(V.clf_multi(spark, sf))


@register("v2_weighted_scores_binary", views=("clf_binary",),
          digits={"accuracy": 6, "precision": 6, "recall": 6, "f1": 6}, ops="V2",
          sql="with" + _per_class_sql("clf_binary") + """
select sum(tp) / sum(support) as accuracy, sum(prec * support) / sum(support) as precision,
       sum(rec * support) / sum(support) as recall, sum(f1 * support) / sum(support) as f1 from f""")
def v2b_q(spark, sf):
    return VM.weighted_scores(V.clf_binary(spark, sf))


@register("v3_confusion_matrix_multi", views=("clf_multi",), ops="V3",
          sql="""with lv as (select distinct cast(label as varchar) as v from clf_multi
                 union select distinct cast(pred as varchar) from clf_multi),
cells as (select cast(label as varchar) as y, cast(pred as varchar) as p, count(*) as n from clf_multi group by all)
select a.v as true_label, b.v as pred_label, coalesce(c.n, 0) as n
from lv a cross join lv b left join cells c on c.y = a.v and c.p = b.v""")
def v3_q(spark, sf):
    return VM.confusion_matrix(V.clf_multi(spark, sf))


@register("v4_classification_report_multi", views=("clf_multi",),
          digits={"precision": 6, "recall": 6, "f1": 6}, ops="V4",
          sql="with" + _per_class_sql("clf_multi") + """
select cls as "row", prec as precision, rec as recall, f1, cast(support as double) as support from f
union all select 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
                 cast(sum(support) as double) from f
union all select 'macro avg', avg(prec), avg(rec), avg(f1), cast(sum(support) as double) from f
union all select 'weighted avg', sum(prec * support) / sum(support), sum(rec * support) / sum(support),
                 sum(f1 * support) / sum(support), cast(sum(support) as double) from f""")
def v4_q(spark, sf):
    return VM.classification_report(V.clf_multi(spark, sf))


def _score_sql(src, pos, score):
    return f"""
c as (select cast({score} as double) as s, count_if({pos}) as pos, count_if(not ({pos})) as neg
      from {src} where {score} is not null group by 1),
tot as (select sum(pos) as P, sum(neg) as N from c),
t as (select s, pos, neg,
        coalesce(sum(pos) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as pos_above,
        coalesce(sum(neg) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as neg_above
      from c)"""


@register("v5_auc_binary", views=("clf_binary",), digits={"auc": 9}, ops="V5",
          sql="with" + _score_sql("clf_binary", "label = 1", "score")
              + " select sum(pos * ((N - neg_above - neg) + neg / 2.0)) / (max(P) * max(N)) as auc from t, tot")
def v5_q(spark, sf):
    return VM.auc(V.clf_binary(spark, sf))


@register("v5_auc_lineitem", digits={"auc": 9}, ops="V5",
          sql="with" + _score_sql("lineitem", "l_returnflag = 'R'", "l_discount")
              + " select sum(pos * ((N - neg_above - neg) + neg / 2.0)) / (max(P) * max(N)) as auc from t, tot")
def v5l_q(spark, sf):
    return VM.auc(table(spark, sf, "lineitem"), "l_returnflag", "l_discount", "R")


def _ovr_part(cls, sc):
    return ("(with" + _score_sql("clf_multi", f"label = '{cls}'", sc)
            + f" select '{cls}' as cls, sum(pos * ((N - neg_above - neg) + neg / 2.0)) / (max(P) * max(N)) as auc from t, tot)")


@register("v6_auc_ovr_multi", views=("clf_multi",), digits={"auc": 9}, ops="V6",
          sql="with per as (" + " union all ".join(_ovr_part(c, f"s_{c}") for c in "ANR") + """),
prev as (select label as cls, count(*) as support from clf_multi group by label)
select sum(auc * coalesce(support, 0)) / sum(coalesce(support, 0)) as auc from per left join prev using (cls)""")
def v6_q(spark, sf):
    return VM.auc_ovr(V.clf_multi(spark, sf), "label", {c: f"s_{c}" for c in "ANR"})


@register("v7_roc_points_binary", views=("clf_binary",), digits={"threshold": 6, "fpr": 9, "tpr": 9}, ops="V7",
          sql="with" + _score_sql("clf_binary", "label = 1", "score") + """
select 'inf'::double as threshold, 0.0e0 as fpr, 0.0e0 as tpr
union all select s, (neg_above + neg) / N, (pos_above + pos) / P from t, tot""")
def v7_q(spark, sf):
    return VM.roc_points(V.clf_binary(spark, sf))


@register("v8_pr_points_binary", views=("clf_binary",), digits={"threshold": 6, "precision": 9, "recall": 9},
          ops="V8", sql="with" + _score_sql("clf_binary", "label = 1", "score") + """
select s as threshold, (pos_above + pos) / (pos_above + pos + neg_above + neg) as precision,
       (pos_above + pos) / P as recall from t, tot
union all select 'inf'::double, 1.0e0, 0.0e0""")
def v8_q(spark, sf):
    return VM.pr_points(V.clf_binary(spark, sf))


@register("v8_pr_area_binary", views=("clf_binary",), digits={"pr_auc": 9}, ops="V8",
          sql="with" + _score_sql("clf_binary", "label = 1", "score") + """
select sum(((pos_above + pos) / P - pos_above / P)
           * ((pos_above + pos) / (pos_above + pos + neg_above + neg)
              + coalesce(pos_above / nullif(pos_above + neg_above, 0), 1.0)) / 2) as pr_auc from t, tot""")
def v8a_q(spark, sf):
    return VM.pr_area(V.clf_binary(spark, sf))


@register("v9_regression_metrics_reg", views=("reg",), digits={"r2": 9, "mae": 4, "mse": 0, "rmse": 4}, ops="V9",
          sql="""select case when var_pop(y) * count(y) = 0 then case when sum((y - yhat) * (y - yhat)) = 0 then 1.0 else 0.0 end
  else 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(y)) end as r2,
  avg(abs(y - yhat)) as mae, avg((y - yhat) * (y - yhat)) as mse, sqrt(avg((y - yhat) * (y - yhat))) as rmse from reg""")
def v9_q(spark, sf):
    return VM.regression_metrics(V.reg(spark, sf))


@register("v10_residuals_reg", views=("reg",), ops="V10",
          sql="select id, y as actual, yhat as predicted, y - yhat as residual, abs(y - yhat) as abs_error from reg")
def v10_q(spark, sf):
    return VM.residuals(V.reg(spark, sf))


@register("v12_metric_changes_by_line", digits={"value": 4, "delta": 4}, ops="V12 J15",
          sql="""with runs as (select l_linenumber as run, 'mae' as metric, avg(abs(l_extendedprice - 2000 * l_quantity)) as value
  from lineitem group by l_linenumber)
select run, metric, value, value - lag(value) over (partition by metric order by run) as delta from runs""")
def v12_q(spark, sf):
    li = table(spark, sf, "lineitem")
    runs = li.groupBy(F.col("l_linenumber").alias("run")).agg(
        F.avg(F.abs(F.col("l_extendedprice") - 2000 * F.col("l_quantity"))).alias("value")).withColumn(
        "metric", F.lit("mae"))
    return VM.metric_changes(runs.select("run", "metric", "value"))
