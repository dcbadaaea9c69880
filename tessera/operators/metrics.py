"""Evaluation metrics as aggregates over (label, prediction[, score]).

Nothing is collected: classification metrics come from the confusion counts
``groupBy(label, pred)`` (one row per cell); ranking metrics from counts per
distinct score. Cumulative counts over scores avoid a single-partition global
window: distinct scores are cut into ranges, each range is cumulated by a
window partitioned by range, and range offsets (one number per range) are
added — the only driver-side data is one total per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col
MAX_CLASSES = 10_000


def _labels(df: DataFrame, label: str, pred: str | None = None) -> list:
    cols = [col(label).cast("string").alias("v")]
    d = df.select(*cols)
    if pred is not None:
        d = d.union(df.select(col(pred).cast("string").alias("v")))
    lv = [r[0] for r in d.where(F.col("v").isNotNull()).distinct().orderBy("v").limit(MAX_CLASSES + 1).collect()]
    if len(lv) > MAX_CLASSES:
        raise ValueError("too many classes")
    return lv


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """V1."""
    return df.agg(F.avg((col(label) == col(pred)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1) with zero division → 0.
    Classes = union of labels and predictions."""
    y, p = col(label).cast("string"), col(pred).cast("string")
    cells = df.groupBy(y.alias("y"), p.alias("p")).agg(F.count("*").alias("n"))
    true_side = cells.groupBy(F.col("y").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("tp"))
    pred_side = cells.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("pred_n"))
    t = true_side.join(pred_side, "cls", "full").fillna(0, ["support", "tp", "pred_n"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return t.select("cls", F.col("tp").cast("long").alias("tp"),
                    (F.col("pred_n") - F.col("tp")).cast("long").alias("fp"),
                    (F.col("support") - F.col("tp")).cast("long").alias("fn"),
                    F.col("support").cast("long").alias("support"),
                    prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                    f1.cast("double").alias("f1"))


def weighted_scores(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """V1 + V2: accuracy and support-weighted precision, recall, F1."""
    pc = per_class(df, label, pred)
    tot = F.sum("support")
    return pc.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """V3: dense (true, predicted, n) over the sorted union of classes."""
    lv = _labels(df, label, pred)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("p")) for a in lv for b in lv]))
    grid = df.sparkSession.range(1).select(pairs.alias("c")).select("c.y", "c.p")
    cells = df.groupBy(col(label).cast("string").alias("y"), col(pred).cast("string").alias("p")).agg(
        F.count("*").alias("n"))
    return (grid.join(cells, ["y", "p"], "left").select(F.col("y").alias("true_label"),
                                                       F.col("p").alias("pred_label"),
                                                       F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """V4: per class precision/recall/F1/support, then 'accuracy',
    'macro avg' and 'weighted avg' rows."""
    pc = per_class(df, label, pred)
    tot = F.sum("support")
    rows = pc.select(F.col("cls").alias("row"), "precision", "recall", "f1", F.col("support").cast("double"))
    acc = pc.agg((F.sum("tp") / tot).alias("a"), tot.alias("s")).select(
        F.lit("accuracy").alias("row"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1"), F.col("s").cast("double").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("double").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("row"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("double").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def score_table(df: DataFrame, positive: Column, score: str, buckets: int | None = None) -> DataFrame:
    """Distinct scores with pos/neg counts and the cumulative counts of all
    strictly higher scores (``pos_above``, ``neg_above``).

    No global window: distinct scores are cut into score ranges at
    approximate quantiles (a deterministic expression), each range is
    cumulated by a window partitioned by range, and the offsets of earlier
    ranges — one number per range — are added as literals.
    """
    spark = df.sparkSession
    counts = (df.where(col(score).isNotNull())
              .groupBy(col(score).cast("double").alias("s"))
              .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n for i in range(1, n)]
    cuts = counts.agg(F.percentile_approx("s", probs, 10000).alias("c")).first()["c"] if probs else []
    cuts = sorted(set(cuts or []))
    arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    ranged = counts.withColumn("bucket", F.size(F.filter(arr, lambda c: c >= F.col("s"))))
    tot = ranged.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).collect()
    off_p, off_n, acc_p, acc_n = {}, {}, 0, 0
    for r in sorted(tot, key=lambda r: r["bucket"]):
        off_p[r["bucket"]], off_n[r["bucket"]] = acc_p, acc_n
        acc_p, acc_n = acc_p + r["p"], acc_n + r["q"]

    def offset(m):
        if not m:
            return F.lit(0)
        return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("bucket")]

    w = Window.partitionBy("bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select(
        "s", "pos", "neg",
        (F.coalesce(F.sum("pos").over(w), F.lit(0)) + offset(off_p)).alias("pos_above"),
        (F.coalesce(F.sum("neg").over(w), F.lit(0)) + offset(off_n)).alias("neg_above"))
    return out.withColumns({"P": F.lit(acc_p).cast("long"), "N": F.lit(acc_n).cast("long")})


def auc(df: DataFrame, label: str = "label", score: str = "score", positive_value=1) -> DataFrame:
    """V5: ROC AUC with ties counted half: Σ pos·(neg below + neg tied/2) / (P·N)."""
    t = score_table(df, col(label) == F.lit(positive_value), score)
    neg_below = F.col("N") - F.col("neg_above") - F.col("neg")
    return t.agg(F.try_divide(F.sum(F.col("pos").cast("double") * (neg_below + F.col("neg") / 2.0)),
                              F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))


def auc_ovr(df: DataFrame, label: str, scores: dict, weighted: bool = True) -> DataFrame:
    """V6: one-vs-rest AUC per class (score column per class), averaged
    by prevalence (or plain mean)."""
    parts = []
    for cls, sc in scores.items():
        a = auc(df, label, sc, cls).select(F.lit(str(cls)).alias("cls"), "auc")
        parts.append(a)
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    prev = df.groupBy(col(label).cast("string").alias("cls")).agg(F.count("*").alias("support"))
    j = per.join(prev, "cls", "left").fillna(0, ["support"])
    if weighted:
        return j.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"))
    return j.agg(F.avg("auc").alias("auc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", positive_value=1) -> DataFrame:
    """V7: (threshold, fpr, tpr) at every distinct score (descending), plus
    the (0, 0) start at threshold +inf."""
    t = score_table(df, col(label) == F.lit(positive_value), score)
    pts = t.select(F.col("s").alias("threshold"),
                   F.try_divide(F.col("neg_above") + F.col("neg"), F.col("N")).alias("fpr"),
                   F.try_divide(F.col("pos_above") + F.col("pos"), F.col("P")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def pr_points(df: DataFrame, label: str = "label", score: str = "score", positive_value=1) -> DataFrame:
    """V8: (threshold, precision, recall) at every distinct score, plus the
    final (recall 0, precision 1) point."""
    t = score_table(df, col(label) == F.lit(positive_value), score)
    tp = F.col("pos_above") + F.col("pos")
    fp = F.col("neg_above") + F.col("neg")
    pts = t.select(F.col("s").alias("threshold"), F.try_divide(tp, tp + fp).alias("precision"),
                   F.try_divide(tp, F.col("P")).alias("recall"))
    end = df.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def pr_area(df: DataFrame, label: str = "label", score: str = "score", positive_value=1) -> DataFrame:
    """V8: trapezoid area under the PR curve. Each distinct score's segment
    starts at the point of the next higher score (its ``*_above`` counts),
    or at (recall 0, precision 1) for the highest score — a row-wise sum over
    the score table, no ordering window."""
    t = score_table(df, col(label) == F.lit(positive_value), score)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    r1, p1 = F.try_divide(tp, F.col("P")), F.try_divide(tp, tp + fp)
    r0 = F.try_divide(F.col("pos_above"), F.col("P"))
    p0 = F.coalesce(F.try_divide(F.col("pos_above"), F.col("pos_above") + F.col("neg_above")), F.lit(1.0))
    return t.agg(F.sum((r1 - r0) * (p1 + p0) / 2).alias("pr_auc"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """V9: R² (constant y: 1 if exact else 0), MAE, MSE, RMSE."""
    e = col(y) - col(yhat)
    g = df.agg(F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
               (F.count(col(y)) * F.var_pop(col(y))).alias("sst"))
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.col("sse") / F.col("sst"))
    return g.select(r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat", keep=("id",)) -> DataFrame:
    """Residual and absolute error per row, plus the shared axis range."""
    e = col(y) - col(yhat)
    return df.select(*keep, col(y).alias("actual"), col(yhat).alias("predicted"),
                     e.alias("residual"), F.abs(e).alias("abs_error"))


def metric_changes(runs: DataFrame, run_col: str = "run", metric_col: str = "metric",
                   value_col: str = "value") -> DataFrame:
    """Change of each metric against the previous run."""
    w = Window.partitionBy(metric_col).orderBy(run_col)
    return runs.withColumn("delta", col(value_col) - F.lag(value_col).over(w))
