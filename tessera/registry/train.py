"""Queries for splits, training, validation and prediction (T, V11, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import col
from ..operators import boosting as BO
from ..operators import models as T
from ..operators import splits as SP
from ..operators import target_stats as TS
from ..sources import views as V
from ..sources.tables import table
from . import register
from .prepare import _hash_sql

EMB_DIM = 64


def embeddings_wide(spark, sf, dims: int = EMB_DIM):
    """Embedding vectors as numeric feature columns e0..e63 with a string class."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


EMB_FEATS = [f"e{i}" for i in range(EMB_DIM)]


@register("t9_train_test_split_chem", views=("chem_wide",), ops="T9",
          sql=f"select id, {_hash_sql('id', 42, 'split')} < 0.2 as is_test from chem_wide")
def t9_q(spark, sf):
    return SP.train_test(V.chem_wide(spark, sf).select("id"), "id", 0.2)


@register("t10_kfold_chem", views=("chem_wide",), ops="T10",
          sql=f"select id, cast(floor({_hash_sql('id', 42, 'fold')} * 5) as integer) as fold from chem_wide")
def t10_q(spark, sf):
    return SP.kfold(V.chem_wide(spark, sf).select("id"), "id", 5)


def _li_key(spark, sf):
    return (table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"),
            SP.row_key("l_orderkey", "l_linenumber", "l_partkey"))


def _rank_sql(tag: str) -> str:
    """60 bits of the hash that orders rows, for the lineitem row key."""
    return f"cast('0x' || substr(md5(concat_ws('|', '42', concat_ws('|', l_orderkey, l_linenumber, l_partkey), '{tag}')), 1, 15) as bigint)"


# Training rows of each class: the whole part of its share, the rest to the largest remainders.
SPLIT_SQL = """with c as (select l_returnflag, count(*) as n from lineitem group by all),
t as (select sum(n) as total, sum(n) - cast(ceil(sum(n) * 0.2) as bigint) as train from c),
a as (select l_returnflag, n, cast(n * train // total as bigint) as whole, n * train % total as rest, train from c, t),
k as (select l_returnflag, n, whole + cast(row_number() over (order by rest desc, l_returnflag) <= train - sum(whole) over () as int) as keep from a)
"""
# Fold i takes the places i, i + 5, ... of the rows sorted by class.
FOLD_SQL = """with c as (select l_returnflag, count(*) as n, sum(count(*)) over (order by l_returnflag) - count(*) as lo from lineitem group by l_returnflag),
k as (select l_returnflag, i, cast((lo + n - i + 4) // 5 - (lo - i + 4) // 5 as bigint) as n from c, range(5) r(i))
"""


@register("t9_stratified_split_sizes_lineitem", ops="T9",
          sql=SPLIT_SQL + "select l_returnflag, is_test, cast(case when is_test then n - keep else keep end as bigint) as n from k, (values (true), (false)) v(is_test)")
def t9s_q(spark, sf):
    li, key = _li_key(spark, sf)
    out = SP.stratified_train_test(li, key, "l_returnflag", 0.2)
    return out.groupBy("l_returnflag", "is_test").agg(F.count("*").alias("n"))


@register("t9_stratified_split_rows_lineitem", ops="T9",
          sql=SPLIT_SQL + f"""select l_orderkey, l_linenumber, l_partkey, l.l_returnflag, row_number() over (partition by l.l_returnflag order by {_rank_sql('split')}) <= n - keep as is_test
from lineitem l join k on k.l_returnflag = l.l_returnflag""")
def t9r_q(spark, sf):
    li, key = _li_key(spark, sf)
    return SP.stratified_train_test(li, key, "l_returnflag", 0.2)


@register("t9_exact_split_orders", ops="T9",
          sql="""select o_orderkey, row_number() over (order by cast('0x' || substr(md5(concat_ws('|', '42', cast(o_orderkey as varchar), 'split')), 1, 15) as bigint))
   <= ceil((select count(*) from orders) * 0.3) as is_test from orders""")
def t9e_q(spark, sf):
    return SP.train_test(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3, exact=True)


@register("t11_stratified_kfold_sizes_lineitem", ops="T11",
          sql=FOLD_SQL + "select l_returnflag, cast(i as int) as fold, n from k")
def t11_q(spark, sf):
    li, key = _li_key(spark, sf)
    out = SP.stratified_kfold(li, key, "l_returnflag", 5)
    return out.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))


@register("t11_stratified_kfold_rows_lineitem", ops="T11",
          sql=FOLD_SQL + f""", e as (select l_returnflag, i, sum(n) over (partition by l_returnflag order by i) as upto, n from k),
r as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() over (partition by l_returnflag order by {_rank_sql('fold')}) as r from lineitem)
select l_orderkey, l_linenumber, l_partkey, r.l_returnflag, cast(i as int) as fold from r join e on e.l_returnflag = r.l_returnflag and r <= upto and r > upto - n""")
def t11r_q(spark, sf):
    li, key = _li_key(spark, sf)
    return SP.stratified_kfold(li, key, "l_returnflag", 5)


@register("t12_row_folds_orders", ops="T12", sql="select o_orderkey, o_orderkey as fold from orders")
def t12r_q(spark, sf):
    return SP.row_folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("t12_leave_one_out_nation", ops="T12",
          sql="select n_nationkey, n_nationkey as fold from nation")
def t12_q(spark, sf):
    return SP.leave_one_out(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")


@register("t13_leave_one_group_out_customer", ops="T13",
          sql="select c_custkey, c_mktsegment, c_mktsegment as fold from customer")
def t13_q(spark, sf):
    return SP.leave_one_group_out(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@register("t13_leave_one_group_out_fit_lineitem", digits={"mse": 2, "mean_prediction": 4}, ops="T13 T8",
          sql="""with f as (select g.l_linenumber as m, regr_slope(l.l_extendedprice, l.l_quantity) as b,
   regr_intercept(l.l_extendedprice, l.l_quantity) as a
   from (select distinct l_linenumber from lineitem) g join lineitem l on l.l_linenumber <> g.l_linenumber group by all)
select m as l_linenumber, count(*) as n, avg(pow(l_extendedprice - (a + b * l_quantity), 2)) as mse,
   avg(a + b * l_quantity) as mean_prediction from lineitem join f on m = l_linenumber group by all""")
def t13_fit_q(spark, sf):
    out = SP.logo_linear(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", "l_linenumber")
    return out.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg(F.pow("residual", 2)).alias("mse"),
                                         F.avg("prediction").alias("mean_prediction"))


@register("t8_linear_regression_reg", views=("reg",), digits={"slope": 6, "intercept": 4}, ops="T8 T16",
          sql="select regr_slope(y, yhat) as slope, regr_intercept(y, yhat) as intercept from reg")
def t8_q(spark, sf):
    r = V.reg(spark, sf)
    f = T.fit(r, ["yhat"], "y", "LinearRegression")
    lr = f.model.stages[-1]
    return spark.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))], "slope double, intercept double")


def _emb_split(spark, sf):
    return SP.train_test(embeddings_wide(spark, sf), "vec_id", 0.2)


def _holdout_metrics(name, params=None, binary=False):
    def fn(spark, sf):
        d = _emb_split(spark, sf)
        if binary:  # one-vs-rest learners shown on "class 0 vs the rest"
            d = d.withColumn("label", F.when(F.col("label") == "0", "0").otherwise("rest"))
        f = T.fit(d.where(~F.col("is_test")), EMB_FEATS, "label", name, params)
        pred = T.predict(f, d.where(F.col("is_test")), keep=["vec_id", "label"])
        from ..operators import metrics as VM
        return VM.weighted_scores(pred, "label", "__prediction__").withColumn("model", F.lit(name))
    return fn


for _name, _ops in (("LogisticRegression", "T2 T21 V2"), ("RandomForestClassifier", "T3"),
                    ("GradientBoostingClassifier", "T4"), ("SVC", "T6"), ("KNeighborsClassifier", "T7")):
    _params = {"GradientBoostingClassifier": {"n_estimators": 20},
               "RandomForestClassifier": {"max_depth": 8}}.get(_name)
    register(f"t_holdout_{_name}", ops=_ops)(
        _holdout_metrics(_name, _params, binary=_name == "GradientBoostingClassifier"))


def _reg_frame(spark, sf):
    c = V.chem_wide(spark, sf)
    return c.select("id", F.col("target"), *[F.coalesce(col(x), F.lit(0.0)).alias(x) for x in V.CHEM_COLS])


# Registered demonstrations use small ensembles (the operator defaults stay as in the registry).
SMALL = {"RandomForestRegressor": {"max_depth": 8},
         "GradientBoostingRegressor": {"n_estimators": 20}, "LightGBM": {"n_estimators": 20},
         "CatBoost": {"iterations": 20}}


def _reg_holdout(name):
    def fn(spark, sf):
        d = SP.train_test(_reg_frame(spark, sf), "id", 0.2)
        f = T.fit(d.where(~F.col("is_test")), V.CHEM_COLS, "target", name, SMALL.get(name))
        pred = T.predict(f, d.where(F.col("is_test")), keep=["id", "target"])
        from ..operators import metrics as VM
        return VM.regression_metrics(pred, "target", "__prediction__").withColumn("model", F.lit(name))
    return fn


for _name, _ops in (("RandomForestRegressor", "T3"), ("GradientBoostingRegressor", "T4"), ("LightGBM", "T5"),
                    ("CatBoost", "T5"), ("LinearRegression", "T8"), ("Ridge", "T8")):
    register(f"t_holdout_{_name}", ops=_ops)(_reg_holdout(_name))


@register("t14_kfold_validation_ridge", ops="T14 T10")
def t14_q(spark, sf):
    d = SP.kfold(_reg_frame(spark, sf), "id", 5)
    res = T.run_validation(d, V.CHEM_COLS, "target", "Ridge", fold_col="fold", metric="r2")
    rows = [(i, float(s)) for i, s in enumerate(res["scores"])]
    return spark.createDataFrame(rows, "fold int, score double").withColumns(
        {"mean": F.lit(res["mean"]), "std": F.lit(res["std"])})


@register("t15_cross_validate_multi_metric", ops="T15")
def t15_q(spark, sf):
    d = SP.kfold(_reg_frame(spark, sf), "id", 5)
    return T.cross_validate(d, V.CHEM_COLS, "target", "LinearRegression", "fold", ["r2", "neg_mse"])


@register("t17_grid_search_ridge", ops="T17 T1")
def t17_q(spark, sf):
    d = SP.kfold(_reg_frame(spark, sf), "id", 3)
    _, res = T.grid_search(d, V.CHEM_COLS, "target", "Ridge", "fold")
    return spark.createDataFrame([(p, float(m)) for p, m in res], "params string, avg_r2 double")


@register("t19_learning_curve_linear", ops="T19")
def t19_q(spark, sf):
    d = SP.kfold(_reg_frame(spark, sf), "id", 3)
    return T.learning_curve(d, V.CHEM_COLS, "target", "LinearRegression", "fold", "id", "r2")


def _gram_frame(spark, sf, k):
    li = table(spark, sf, "lineitem")
    d = li.select(SP.row_key("l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"),
                  F.col("l_extendedprice").alias("y"))
    return SP.kfold(d, "id", k)


def _gram_sql(k: int, alphas: str, steps: str = "(values (0, 2.0)) s(step, frac)") -> str:
    """Two-feature ridge of every fold, penalty and size step by closed form, with its squared-error scores: table ``m``."""
    key = "concat_ws('|', l_orderkey, l_linenumber, l_partkey)"
    return f"""with d as (select l_quantity as x1, l_discount as x2, l_extendedprice as y, cast(floor({_hash_sql(key, 42, 'fold')} * {k}) as int) as fold, {_hash_sql(key, 42, 'lc')} as u from lineitem),
g as (select fold as f, step, frac from (select distinct fold from d), {steps}),
t as (select f, step, frac, count(*) as n, avg(x1) as m1, avg(x2) as m2, avg(y) as my, count(*) * var_pop(x1) as s11, count(*) * var_pop(x2) as s22, count(*) * covar_pop(x1, x2) as s12,
        count(*) * covar_pop(x1, y) as s1, count(*) * covar_pop(x2, y) as s2 from g join d on d.fold <> g.f and u < frac group by all),
b as (select f, step, frac, alpha, m1, m2, my, (s1 * (s22 + alpha) - s2 * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) as b1, (s2 * (s11 + alpha) - s1 * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) as b2 from t, {alphas}),
p as (select f, step, alpha, fold = f as held, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) as p from b join d on fold = f or u < frac),
m as (select f, step, alpha, held, 1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) as r2, avg((y - p) * (y - p)) as mse, avg(abs(y - p)) as mae from p group by all)
"""


@register("t14_kfold_ridge_lineitem", digits={"score": 9, "mean": 9, "std": 9}, ops="T14 T10",
          sql=_gram_sql(5, "(values (1.0)) a(alpha)") + "select cast(f as int) as fold, r2 as score, avg(r2) over () as mean, stddev_pop(r2) over () as std from m where held")
def t14g_q(spark, sf):
    res = T.run_validation(_gram_frame(spark, sf, 5), ["x1", "x2"], "y", "Ridge", fold_col="fold", metric="r2")
    return spark.createDataFrame([(i, float(s), res["mean"], res["std"]) for i, s in enumerate(res["scores"])], "fold int, score double, mean double, std double")


@register("t15_cross_validate_lineitem", digits={"mean": 5, "std": 5}, ops="T15",
          sql=_gram_sql(5, "(values (0.0)) a(alpha)") + """select metric, avg(v) as mean, stddev_pop(v) as std from
  (select 'r2' as metric, r2 as v from m where held union all select 'neg_mse', -mse from m where held union all select 'neg_mae', -mae from m where held) group by metric""")
def t15g_q(spark, sf):
    return T.cross_validate(_gram_frame(spark, sf, 5), ["x1", "x2"], "y", "LinearRegression", "fold").drop("values")


@register("t17_grid_ridge_lineitem", digits={"avg_r2": 9}, ops="T17 T1",
          sql=_gram_sql(3, "(values (0.1), (1.0), (10.0), (100.0)) a(alpha)") + "select cast(alpha as double) as alpha, avg(r2) as avg_r2 from m where held group by alpha")
def t17g_q(spark, sf):
    _, res = T.grid_search(_gram_frame(spark, sf, 3), ["x1", "x2"], "y", "Ridge", "fold")
    return spark.createDataFrame([(float(p.split("=")[1]), m) for p, m in res], "alpha double, avg_r2 double")


@register("t19_learning_curve_lineitem", digits={x: 9 for x in ("size", "train_mean", "train_std", "valid_mean", "valid_std")}, ops="T19",
          sql=_gram_sql(3, "(values (0.0)) a(alpha)", "(select i as step, 0.1e0 + 0.9e0 * i / 7 as frac from range(8) r(i)) s") + """select 0.1e0 + 0.9e0 * step / 7 as size,
  avg(r2) filter (where not held) as train_mean, stddev_pop(r2) filter (where not held) as train_std, avg(r2) filter (where held) as valid_mean, stddev_pop(r2) filter (where held) as valid_std from m group by step""")
def t19g_q(spark, sf):
    return T.learning_curve(_gram_frame(spark, sf, 3), ["x1", "x2"], "y", "LinearRegression", "fold", "id")


@register("t5_histogram_gains_lineitem", digits={"gain": 3}, ops="T5 T4",
          sql="""with d as (select l_extendedprice as y, cast(l_quantity as double) as l_quantity, cast(l_discount as double) as l_discount, cast(l_tax as double) as l_tax,
  cast(l_linenumber as double) as l_linenumber from lineitem), m as (select avg(y) as b from d),
v as (select f.feature, f.x, b - y as g from d, m, lateral (values ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax), ('l_linenumber', l_linenumber)) f(feature, x)),
c as (select feature, x as cut, sum(sum(g)) over w as gl, sum(count(*)) over w as nl, sum(sum(g)) over (partition by feature) as g, sum(count(*)) over (partition by feature) as n
  from v group by feature, x window w as (partition by feature order by x))
select feature, cut, gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n as gain from c where nl >= 20 and n - nl >= 20""")
def t5g_q(spark, sf):
    """Gains of all first cuts of the leaf-wise learner, from its gradient histograms."""
    return BO.root_gains(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice")


@register("t5_ordered_statistics_lineitem", digits={"l_linestatus_stat": 2, "l_returnflag_stat": 2}, ops="T5",
          sql="""with d as (select concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id, l_returnflag, l_linestatus, l_extendedprice as y, avg(l_extendedprice) over () as p from lineitem),
u as (select *, cast('0x' || substr(md5(concat_ws('|', '42', id, 'permutation')), 1, 15) as bigint) as u from d)
select id, l_returnflag, l_linestatus,
  (coalesce(sum(y) over (partition by l_linestatus order by u rows between unbounded preceding and 1 preceding), 0) + p) / (coalesce(count(*) over (partition by l_linestatus order by u rows between unbounded preceding and 1 preceding), 0) + 1) as l_linestatus_stat,
  (coalesce(sum(y) over (partition by l_returnflag order by u rows between unbounded preceding and 1 preceding), 0) + p) / (coalesce(count(*) over (partition by l_returnflag order by u rows between unbounded preceding and 1 preceding), 0) + 1) as l_returnflag_stat
from u""")
def t5o_q(spark, sf):
    """Mean price of the earlier rows of a level, for two columns of lineitem."""
    id_ = SP.row_key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id")
    li = table(spark, sf, "lineitem").select(id_, "l_returnflag", "l_linestatus", "l_extendedprice")
    return TS.ordered_statistics(li, "id", ["l_linestatus", "l_returnflag"], "l_extendedprice").drop("l_extendedprice")


@register("t4_holdout_three_classes", ops="T4 T21 V2")
def t4m_q(spark, sf):
    """Softmax boosting on three classes of lineitem rows."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double").alias("day"),
                                             SP.row_key("l_orderkey", "l_linenumber", "l_partkey").alias("id"))
    d = SP.train_test(li, "id", 0.2)
    f = T.fit(d.where(~F.col("is_test")), ["l_quantity", "l_extendedprice", "day"], "l_returnflag", "GradientBoostingClassifier", {"n_estimators": 20})
    from ..operators import metrics as VM
    return VM.weighted_scores(T.predict(f, d.where(F.col("is_test")), keep=["id", "l_returnflag"]), "l_returnflag", "__prediction__")


@register("t21_batch_predictions_logreg", ops="T21 T16")
def t21_q(spark, sf):
    d = _emb_split(spark, sf)
    f = T.fit(d.where(~F.col("is_test")), EMB_FEATS, "label", "LogisticRegression")
    return T.predict(f, d.where(F.col("is_test")), keep=["vec_id"])


@register("v11_feature_importance_rf", ops="V11")
def v11_q(spark, sf):
    d = _reg_frame(spark, sf)
    f = T.fit(d, V.CHEM_COLS, "target", "RandomForestRegressor", {"n_estimators": 20, "max_depth": 8})
    return T.feature_importance(f, spark)


@register("j15_best_model_by_metric", ops="J15")
def j15_q(spark, sf):
    parts = [_reg_holdout(n)(spark, sf) for n in ("LinearRegression", "Ridge", "GradientBoostingRegressor")]
    runs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return runs.agg(F.max_by("model", "r2").alias("best_model"), F.max("r2").alias("best_r2"))


KNN_SQL = f"""with e as (select vec_id, cast(label as varchar) as label, embedding,
    {_hash_sql('vec_id', 42, 'split')} < 0.2 as is_test from embeddings),
tr as (select * from e where not is_test), te as (select * from e where is_test),
d as (select te.vec_id, tr.label,
        list_sum(list_transform(list_zip(te.embedding, tr.embedding),
                 lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double)))) as dist,
        tr.vec_id as tid from te, tr),
r as (select vec_id, label, row_number() over (partition by vec_id order by dist, tid) as rk from d),
v as (select vec_id, label, count(*) as n from r where rk <= 5 group by vec_id, label)
select vec_id, arg_min(label, (-n, label)) as __prediction__ from v group by vec_id"""


@register("t7_knn_predictions_embeddings", sql=KNN_SQL, ops="T7")
def t7_q(spark, sf):
    d = _emb_split(spark, sf)
    f = T.fit(d.where(~F.col("is_test")), EMB_FEATS, "label", "KNeighborsClassifier")
    return T.predict(f, d.where(F.col("is_test")), keep=["vec_id"])


@register("t12_loo_linear_closed_form_reg", views=("reg",), digits={"loo_mse": 2, "mean_leverage": 12}, ops="T12 T8",
          sql="""with s as (select avg(yhat) as mx, sum((yhat - (select avg(yhat) from reg)) * (yhat - (select avg(yhat) from reg))) as sxx,
   regr_slope(y, yhat) as b, regr_intercept(y, yhat) as a, count(*) as n from reg)
select avg(pow((y - (a + b * yhat)) / (1 - (1.0 / n + (yhat - mx) * (yhat - mx) / sxx)), 2)) as loo_mse,
       avg(1.0 / n + (yhat - mx) * (yhat - mx) / sxx) as mean_leverage from reg, s""")
def t12c_q(spark, sf):
    out = SP.loo_linear(V.reg(spark, sf), ["yhat"], "y")
    return out.agg(F.avg(F.pow("loo_residual", 2)).alias("loo_mse"), F.avg("leverage").alias("mean_leverage"))
