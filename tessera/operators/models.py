"""Training, validation and prediction on ``pyspark.ml``.

Estimators come from a registry of names with the reference's defaults mapped
to their Spark counterparts. Training data stays distributed; the only
driver-side loops are over folds / grid points (a handful), each fitting on a
persisted DataFrame.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col, is_numeric
from ..session import shared_table
from . import boosting as BO
from . import gram as GR
from . import kernel as KE
from . import metrics as VM
from . import target_stats as TS

SEED = 42


@dataclass
class ModelSpec:
    """A named model: task, factory(params, n_rows) → estimator, defaults, grid."""
    name: str
    task: str
    make: Callable
    defaults: dict = field(default_factory=dict)
    grid: dict = field(default_factory=dict)


def _logreg(p, n, multi):
    c = float(p.get("C", 1.0))
    return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (c * max(n, 1)),
                              elasticNetParam=0.0, standardization=False,
                              family="multinomial" if multi else "binomial")


def _rf_c(p, n, multi):
    md = p.get("max_depth")
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=30 if md is None else int(md),
                                  minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


def _rf_r(p, n, multi):
    md = p.get("max_depth")
    return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), maxDepth=30 if md is None else int(md),
                                 minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=SEED)


def _gbt_c(p, n, multi):
    g = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                      maxDepth=int(p.get("max_depth", 3)), seed=SEED)
    return OneVsRest(classifier=g) if multi else g


def _gbt_r(p, n, multi, depth=3):
    return GBTRegressor(maxIter=int(p.get("n_estimators", p.get("iterations", 100))),
                        stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth", depth)), seed=SEED)


def _svc(p, n, multi):
    s = LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), maxIter=int(p.get("max_iter", 1000)))
    return OneVsRest(classifier=s) if multi else s


def _linreg(p, n, multi):
    return LinearRegression(regParam=0.0, solver="normal")


def _ridge(p, n, multi, y_std=1.0):
    # Spark scales the label by its std inside the normal solver: λ = α·σ_y / n
    return LinearRegression(regParam=float(p.get("alpha", 1.0)) * y_std / max(n, 1), elasticNetParam=0.0,
                            standardization=False, solver="normal")


# Model names, default parameters and declared grids of the model registry.
REGISTRY: dict[str, ModelSpec] = {
    "LogisticRegression": ModelSpec("LogisticRegression", "classification", _logreg, {"max_iter": 1000},
                                    {"C": [0.01, 0.1, 1, 10]}),
    "RandomForestClassifier": ModelSpec("RandomForestClassifier", "classification", _rf_c, {"n_estimators": 100},
                                        {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10]}),
    "GradientBoostingClassifier": ModelSpec("GradientBoostingClassifier", "classification", _gbt_c,
                                            {"n_estimators": 100}, {"n_estimators": [50, 100, 200],
                                                                    "learning_rate": [0.05, 0.1, 0.2]}),
    "SVC": ModelSpec("SVC", "classification", None, {}, {"C": [0.1, 1, 10]}),
    "LinearSVC": ModelSpec("LinearSVC", "classification", _svc, {}, {"C": [0.1, 1, 10]}),
    "SVR": ModelSpec("SVR", "regression", None, {}, {"C": [0.1, 1, 10]}),
    "KNeighborsClassifier": ModelSpec("KNeighborsClassifier", "classification", None, {"n_neighbors": 5},
                                      {"n_neighbors": [3, 5, 7, 11]}),
    "RandomForestRegressor": ModelSpec("RandomForestRegressor", "regression", _rf_r, {"n_estimators": 100},
                                       {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10]}),
    "GradientBoostingRegressor": ModelSpec("GradientBoostingRegressor", "regression", _gbt_r, {"n_estimators": 100},
                                           {"n_estimators": [50, 100, 200], "learning_rate": [0.05, 0.1, 0.2]}),
    "LightGBM": ModelSpec("LightGBM", "regression", None, {"n_estimators": 100, "learning_rate": 0.1}),
    "CatBoost": ModelSpec("CatBoost", "regression", None, {"iterations": 100, "learning_rate": 0.1, "depth": 6}),
    "LinearRegression": ModelSpec("LinearRegression", "regression", _linreg, {}, {}),
    "Ridge": ModelSpec("Ridge", "regression", _ridge, {"alpha": 1.0}, {"alpha": [0.1, 1.0, 10.0, 100.0]}),
}


def model_names(task: str) -> list[str]:
    """Names of the models for a task."""
    return [n for n, s in REGISTRY.items() if s.task == task]


def default_params(name: str) -> dict:
    return dict(REGISTRY[name].defaults)


def param_grid(name: str) -> dict:
    return dict(REGISTRY[name].grid)


@dataclass
class Fitted:
    """A fitted pipeline with what prediction needs."""
    model: PipelineModel | None
    features: list[str]
    label: str
    task: str
    classes: list | None = None
    knn_train: DataFrame | None = None
    k: int = 5
    boosted: BO.Boosted | None = None
    kernel: KE.Machine | None = None
    levels: dict = field(default_factory=dict)  # statistics of the levels of text features


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")


def fit(df: DataFrame, features: list[str], label: str, name: str, params: dict | None = None,
        n_rows: int | None = None) -> Fitted:
    """Fit a named model (T2–T8) on the given rows."""
    spec = REGISTRY[name]
    p = {**spec.defaults, **(params or {})}
    if name == "KNeighborsClassifier":
        return Fitted(None, features, label, "classification", knn_train=df.select(*features, label),
                      k=int(p.get("n_neighbors", 5)))
    if name == "LightGBM":
        s = BO.Settings(n_estimators=int(p["n_estimators"]), learning_rate=float(p["learning_rate"]), num_leaves=int(p.get("num_leaves", 31)))
        return Fitted(None, features, label, spec.task, boosted=BO.fit(df, features, label, settings=s))
    if name in ("SVC", "SVR"):
        classes = None
        if name == "SVC":
            classes = [r[0] for r in df.select(col(label).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").collect()]
        s = KE.Settings(C=float(p.get("C", 1.0)), gamma=p.get("gamma", "scale"), max_iter=int(p.get("max_iter", 40)), n_features=int(p.get("n_features", 256)))
        return Fitted(None, features, label, spec.task, classes, kernel=KE.fit(df, features, label, classes, s))
    if name == "CatBoost":
        return _fit_symmetric(df, features, label, p)
    if name == "GradientBoostingClassifier":
        classes = [r[0] for r in df.select(col(label).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").collect()]
        if len(classes) > 2:  # trees of three levels, one a class and round
            depth = int(p.get("max_depth", 3))
            s = BO.Settings(n_estimators=int(p["n_estimators"]), learning_rate=float(p.get("learning_rate", 0.1)), num_leaves=1 << depth, max_depth=depth,
                            min_rows=int(p.get("min_samples_leaf", 1)))
            return Fitted(None, features, label, spec.task, classes, boosted=BO.fit(df, features, label, classes, s))
    # Iterative learners make several passes: keep the projected training
    # columns cached, spread over at least the cluster's default parallelism
    # (a narrow input is re-partitioned; a wide one is only cached). The cached
    # columns are asked for their partitions: the exchanges below them run once.
    sc = df.sparkSession.sparkContext
    data = read = df.select(*dict.fromkeys(list(features) + [label])).persist()
    try:
        if read.rdd.getNumPartitions() < sc.defaultParallelism:
            data = read.repartition(sc.defaultParallelism).persist()
            data.count()
            read.unpersist()
        return _fit_cached(data, features, label, name, spec, p, n_rows)
    finally:
        read.unpersist()
        data.unpersist()


def _fit_symmetric(df: DataFrame, features: list[str], label: str, p: dict) -> Fitted:
    """Symmetric trees; text features enter as ordered target statistics."""
    text = [c for c in features if not is_numeric(df.schema[c].dataType)]
    s = BO.Settings(n_estimators=int(p["iterations"]), learning_rate=float(p["learning_rate"]), max_depth=int(p["depth"]), l2=float(p.get("l2_leaf_reg", 3.0)),
                    max_bin=254, symmetric=True)
    levels = {c: TS.level_statistics(df, c, label) for c in text}
    levels = {c: (shared_table(table, "levels"), prior) for c, (table, prior) in levels.items()}
    if text:
        row = F.to_json(F.struct(*[col(c) for c in dict.fromkeys([*features, label])]))
        df = TS.ordered_statistics(df, row, text, label)
    used = [f"{c}_stat" if c in text else c for c in features]
    return Fitted(None, features, label, "regression", boosted=BO.fit(df, used, label, settings=s), levels=levels)


def _node_ids_fit(sc, n: int, trees: int) -> bool:
    """Whether a forest can keep each row's node of every tree, so that no level walks its rows down from the roots.

    The trees are the same either way. A row has its sampling counts and, while a
    level ends, its old and new nodes: one int a tree each, beside its bins. Rows
    beyond the executors' storage memory would be written to disk and read again
    at every level; they are walked.
    """
    sizes = []
    shares = sc._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    while shares.hasNext():
        sizes.append(shares.next()._1())
    sizes.sort()
    there = sum(sizes[1:]) if len(sizes) > 1 else sum(sizes)  # the driver's own share holds no rows
    return n * (3 * (16 + 4 * trees) + 120) <= there


def _fit_cached(df, features, label, name, spec, p, n_rows) -> Fitted:
    stats = None
    if n_rows is None or spec.task == "classification":
        # row count and class count in one pass
        aggs = [F.count(F.lit(1)).alias("n")]
        if spec.task == "classification":
            aggs.append(F.count_distinct(col(label)).alias("k"))
        stats = df.agg(*aggs).first()
    n = n_rows if n_rows is not None else stats["n"]
    stages = [_assembler(features)]
    if spec.task == "classification":
        idx = StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="error")
        stages.insert(0, idx)
        lab = "__label"
    else:
        lab = label
    if name == "Ridge":
        sd = df.agg(F.stddev_pop(col(label).cast("double"))).first()[0] or 1.0
        est = _ridge(p, n, False, sd)
    else:
        multi = spec.task == "classification" and stats["k"] > 2
        est = spec.make(p, n, multi)
    if isinstance(est, (RandomForestClassifier, RandomForestRegressor)):
        est.setCacheNodeIds(_node_ids_fit(df.sparkSession.sparkContext, n, est.getNumTrees()))
    if spec.task == "regression":
        df = df.withColumn(label, col(label).cast("double"))
    est.setFeaturesCol("__features").setLabelCol(lab)
    if hasattr(est, "setPredictionCol"):
        est.setPredictionCol("__pred")
    model = Pipeline(stages=stages + [est]).fit(df)
    classes = list(model.stages[0].labels) if spec.task == "classification" else None
    return Fitted(model, features, label, spec.task, classes)


def predict(f: Fitted, df: DataFrame, keep: list[str] | None = None, digits: int = 4) -> DataFrame:
    """``__prediction__`` and ``prob_<class>`` (rounded) per row."""
    keep = keep or []
    if f.knn_train is not None:
        return knn_predict(f, df, keep)
    if f.kernel is not None:
        return KE.predict(f.kernel, df, keep, digits)
    if f.boosted is not None:
        for c, (table, prior) in f.levels.items():
            df = TS.apply_statistics(df, c, table, prior)
        return BO.predict(f.boosted, df, keep, digits)
    out = f.model.transform(df.withColumn(f.label, F.lit(None).cast("string")) if f.task == "classification"
                            and f.label not in df.columns else df)
    cols = [col(c) for c in keep]
    if f.task == "classification":
        lab = F.array(*[F.lit(c) for c in f.classes])
        cols.append(lab[F.col("__pred").cast("int")].alias("__prediction__"))
        if "probability" in out.columns:
            pr = vector_to_array("probability")
            cols += [F.bround(pr[i], digits).alias(f"prob_{c}") for i, c in enumerate(f.classes)]
    else:
        cols.append(F.col("__pred").alias("__prediction__"))
    return out.select(*cols)


#: Learners whose validation needs no fit for each fold, size or penalty (see ``gram``).
LINEAR = ("LinearRegression", "Ridge")


def _alpha(name: str, params: dict | None) -> float:
    return float({**REGISTRY[name].defaults, **(params or {})}.get("alpha", 0.0)) if name == "Ridge" else 0.0


def default_metrics(task: str) -> list[str]:
    """Scores of a cross-validation that names none."""
    return ["accuracy", "f1", "roc_auc"] if task == "classification" else ["r2", "neg_mse", "neg_mae"]


#: Distinct rows in a block of either side of the k-NN search, queries compared with a training block at a time,
#: training rows a cell has on average, and the most cells.
KNN_BLOCK, KNN_SLICE, KNN_CELL, KNN_CELLS = 8192, 512, 2048, 4096
#: Distances to pivots, and values of routed rows, that a task holds at a time.
KNN_HELD = 1 << 20


def _nearest(k: int, key: str):
    """(query block, training block) → up to k nearest distinct training rows per query, which ``key`` names."""
    import pandas as pd

    def run(queries, train):
        found = {key: [], "y": [], "w": [], "d": []}
        if len(queries) and len(train):
            rows, labels, weights = np.stack(train["x"]), train["y"].to_numpy(), train["w"].to_numpy()
            norms, kk = (rows * rows).sum(1), min(k, len(rows))
            for at in range(0, len(queries), KNN_SLICE):
                q = np.stack(queries["x"][at:at + KNN_SLICE])
                near = np.argpartition(norms - 2 * q @ rows.T, kk - 1, axis=1)[:, :kk].ravel()
                own = np.repeat(np.arange(len(q)), kk)
                found[key].append(queries[key].to_numpy()[at:at + KNN_SLICE][own])
                found["y"].append(labels[near])
                found["w"].append(weights[near])
                found["d"].append(((q[own] - rows[near]) ** 2).sum(1))
        kinds = {"x": object, "q": "int64", "y": object, "w": "int64", "d": "float64"}
        return pd.DataFrame({c: pd.Series(np.concatenate(v) if v else v, dtype=kinds[c]) for c, v in found.items()})

    return run


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0))


def _held(pdf, width: int):
    """``pdf`` in pieces of at most ``KNN_HELD`` values, if a row has ``width`` of them."""
    step = max(1, KNN_HELD // max(1, width))
    for at in range(0, len(pdf), step):
        yield pdf.iloc[at:at + step]


def knn_cells(train: DataFrame, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(training rows with their cell, pivots, cells x (rows, least and greatest distance to the pivot)).

    Pivots are training rows of smallest hash; a row belongs to its nearest pivot.
    """
    m = max(1, min(KNN_CELLS, train.count() // KNN_CELL))
    pivots = np.array([r["x"] for r in train.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(m).collect()], dtype=float)
    if not len(pivots):
        return train.withColumn("cell", F.lit(0)), pivots, np.zeros((0, 3))

    def run(frames):
        for pdf in (part for frame in frames for part in _held(frame, len(pivots))):
            d = _distances(np.stack(pdf["x"]), pivots)
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    dealt = shared_table(train.mapInPandas(run, "x array<double>, y string, w long, cell int, far double"), "cells")
    sizes = np.zeros((len(pivots), 3))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect():
        sizes[r["cell"]] = r["n"], r["lo"], r["hi"]
    return dealt, pivots, sizes


def knn_route(queries: DataFrame, pivots: np.ndarray, sizes: np.ndarray, k: int, bounds: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(x, cell), and with ``numbered`` queries their number q: the cells a query must see.

    Without ``bounds``, the nearest cells that together hold ``k`` rows; with
    (x, bound), the other cells that can hold a row within the query's bound: by
    the triangle inequality such a row is at least |d(query, pivot)| away from
    the ring of distances that the cell's rows have to their pivot.
    """
    import pandas as pd

    bounded = bounds is not None

    def first(d: np.ndarray) -> np.ndarray:
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(sizes[order, 0], axis=1) - sizes[order, 0]
        seen = np.zeros(d.shape, bool)
        np.put_along_axis(seen, order, (before < k) & (sizes[order, 0] > 0), axis=1)
        return seen

    def run(frames):
        for pdf in (part for frame in frames for part in _held(frame, len(pivots))):
            x = np.stack(pdf["x"])
            d = _distances(x, pivots)
            go = first(d)
            if bounded:
                nearest = np.maximum(np.maximum(d - sizes[:, 2], sizes[:, 1] - d), 0)
                slack = 1e-6 * (1 + np.abs(x).max(initial=0) + np.abs(pivots).max(initial=0))  # rounding of the distances
                go = (nearest <= np.sqrt(pdf["bound"].to_numpy())[:, None] + slack) & (sizes[:, 0] > 0) & ~go
            q, cell = np.nonzero(go)
            step, own = max(1, KNN_HELD // max(1, x.shape[1])), list(x)
            for at in range(0, len(q), step):  # a query may go to every cell
                out = {"x": pd.Series([own[i] for i in q[at:at + step]], dtype=object), "cell": cell[at:at + step].astype("int32")}
                yield pd.DataFrame(out | ({"q": pdf["q"].to_numpy()[q[at:at + step]]} if numbered else {}))

    return (bounds if bounded else queries).mapInPandas(run, "x array<double>, cell int" + ", q long" * numbered)


def _search(routed: DataFrame, dealt: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
    """Up to ``k`` nearest rows of every routed (query, cell), in blocks of bounded size on both sides.

    Numbered queries come back as their number q, not as their values: there are ``k`` rows for each cell a query sees.
    """
    key, kind = ("q", "long") if "q" in routed.columns else ("x", "array<double>")
    parts = np.maximum(1, -(-sizes[:, 0] // KNN_BLOCK)).astype(int)
    per = dict(routed.groupBy("cell").count().collect())  # one row a cell
    asks = [max(1, -(-per.get(c, 0) // KNN_BLOCK)) for c in range(len(sizes))]
    of = lambda n: F.array(*[F.lit(int(v)) for v in n])[F.col("cell")]
    left = routed.select(*dict.fromkeys(["x", key]), "cell", F.pmod(F.xxhash64(key), of(asks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), of(parts) - 1)).alias("tb"))
    right = dealt.select("x", "y", "w", "cell", F.explode(F.sequence(F.lit(0), of(asks) - 1)).alias("qb"), F.pmod(F.xxhash64("x", "y"), of(parts)).cast("int").alias("tb"))
    return left.groupBy("cell", "qb", "tb").cogroup(right.groupBy("cell", "qb", "tb")).applyInPandas(_nearest(k, key), f"{key} {kind}, y string, w long, d double")


def knn_predict(f: Fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    """Exact k-nearest-neighbour vote (Euclidean, NULL as 0; nearer rows
    first, then the smaller label; an equal vote goes to the smaller class).

    Equal training rows are counted once with a weight and equal queries are
    answered once, so copies make no hot block. Training rows are dealt to the
    cells of pivots. A query sees its nearest cells first; the distance of its
    k-th row there bounds the search, and it goes on only to cells that can hold
    a nearer row. Every (cell, query block, row block) is a task of bounded size.
    """
    k = f.k
    x = F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in f.features])
    label = col(f.label).cast("string")
    train = (f.knn_train.where(label.isNotNull()).groupBy(x.alias("x"), label.alias("y"))
             .agg(F.count("*").alias("w")))
    dealt, pivots, sizes = knn_cells(shared_table(train, "rows"), k)
    rows = df.select(*[col(c) for c in keep], x.alias("__x"))
    if not len(pivots):
        return rows.select(*[col(c) for c in keep], F.lit(None).cast("string").alias("__prediction__"))
    queries = shared_table(df.select(x.alias("x")).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    near = shared_table(_search(shared_table(knn_route(queries, pivots, sizes, k, numbered=True), "routes"), dealt, sizes, k), "near")
    bounds = near.groupBy("q").agg(F.sort_array(F.collect_list("d")).alias("d"))  # k rows for each cell seen
    bounds = bounds.select("q", F.when(F.size("d") >= k, F.get("d", F.lit(k - 1))).otherwise(F.lit(float("inf"))).alias("bound"))
    more = shared_table(knn_route(queries, pivots, sizes, k, queries.join(bounds, "q"), numbered=True), "routes")
    near = near.unionByName(_search(more, dealt, sizes, k))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("q").orderBy("d", "y", "w").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    votes = (near.withColumn("v", F.least("w", F.lit(k) - before)).where("v > 0")
             .groupBy("q", "y").agg(F.sum("v").alias("v")))
    best = votes.groupBy("q").agg(F.min_by("y", F.struct(-F.col("v"), F.col("y"))).alias("__prediction__"))
    best = queries.join(best, "q").select(F.col("x").alias("__x"), "__prediction__")
    return rows.join(best, "__x", "left").select(*[col(c) for c in keep], "__prediction__")


CLASS_METRICS = ("accuracy", "f1", "roc_auc")
VALUE_METRICS = ("r2", "mae", "mse", "rmse", "neg_mae", "neg_mse", "neg_rmse")


def _known(metric: str, names: tuple) -> str:
    if metric not in names:
        raise ValueError(f"metric {metric!r} is not one of {', '.join(names)}")
    return metric


def score(f: Fitted, df: DataFrame, metric: str) -> float:
    """Score a fitted model on rows: accuracy, f1 (weighted) or roc_auc (one class against the rest, weighted by
    their rows; of two classes the second's) for classes, r2, mae, mse, rmse (or neg_...) for values."""
    if f.task == "classification" and metric == "roc_auc":
        return _roc_auc(f, df)
    pred = predict(f, df, keep=[f.label])
    if f.task == "classification":
        w = VM.weighted_scores(pred.withColumn(f.label, F.col(f.label).cast("string")), f.label, "__prediction__").first()
        return float(w[_known(metric, CLASS_METRICS)])
    m = VM.regression_metrics(pred.withColumn(f.label, F.col(f.label).cast("double")), f.label, "__prediction__").first()
    name = _known(metric, VALUE_METRICS)
    return float(-m[name.removeprefix("neg_")] if name.startswith("neg_") else m[name])


def _roc_auc(f: Fitted, df: DataFrame) -> float:
    """From class probabilities or, for learners without them, from raw scores; NaN where a learner has neither."""
    if f.boosted is not None or f.kernel is not None:
        out = predict(f, df, [f.label], 15)
        wide = out.select(col(f.label).cast("string").alias("label"), *[col(f"prob_{c}").alias(f"s{i}") for i, c in enumerate(f.classes)])
    elif f.model is None:
        return math.nan
    else:
        out = f.model.transform(df.withColumn(f.label, col(f.label).cast("string")))
        raw = next((c for c in ("probability", "rawPrediction") if c in out.columns), None)
        if raw is None:
            return math.nan
        s = vector_to_array(raw)
        wide = out.select(col(f.label).alias("label"), *[s[i].alias(f"s{i}") for i in range(len(f.classes))])
    if len(f.classes) == 2:
        got = VM.auc(wide, "label", "s1", f.classes[1]).first()[0]
    else:
        got = VM.auc_ovr(wide, "label", {c: f"s{i}" for i, c in enumerate(f.classes)}).first()[0]
    return math.nan if got is None else float(got)


def run_validation(df: DataFrame, features: list[str], label: str, name: str, fold_col: str | None = None,
                   test_col: str | None = None, metric: str = "accuracy", params: dict | None = None) -> dict:
    """train/test (``test_col``) or CV over ``fold_col``: scores, mean,
    std (ddof 0); CV refits on all rows for the saved model. The folds of
    linear models come from one aggregate."""
    t0 = time.perf_counter()
    if fold_col is not None and test_col is None and name in LINEAR and _known(metric, VALUE_METRICS).endswith(("r2", "mse")):
        got = GR.held_out(GR.moments(df, features, label, [fold_col]), [_alpha(name, params)])
        scores = [s[metric] for _, _, s, _ in got]
        return {"model": fit(df, features, label, name, params), "scores": scores, "mean": float(np.mean(scores)),
                "std": float(np.std(scores)), "scoring": metric, "seconds": time.perf_counter() - t0}
    df = df.persist()
    scores = []
    try:
        if test_col is not None:
            f = fit(df.where(~col(test_col)), features, label, name, params)
            scores.append(score(f, df.where(col(test_col)), metric))
        else:
            folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
            for k in folds:
                f = fit(df.where(col(fold_col) != k), features, label, name, params)
                scores.append(score(f, df.where(col(fold_col) == k), metric))
            f = fit(df, features, label, name, params)
    finally:
        df.unpersist()
    return {"model": f, "scores": scores, "mean": float(np.mean(scores)), "std": float(np.std(scores)),
            "scoring": metric, "seconds": time.perf_counter() - t0}


def cross_validate(df: DataFrame, features: list[str], label: str, name: str, fold_col: str,
                   metrics: list[str] | None = None, params: dict | None = None) -> DataFrame:
    """Fold × metric long table → (metric, mean, std, values); without
    ``metrics``, the default scores of the task. Linear models need one
    aggregate for all folds (and one more scan for mean absolute errors)."""
    spark = df.sparkSession
    metrics = metrics or default_metrics(REGISTRY[name].task)
    if name in LINEAR:
        got = GR.held_out(GR.moments(df, features, label, [fold_col]), [_alpha(name, params)])
        mae = GR.mean_absolute_errors(df, features, label, fold_col, {k: f for k, _, _, f in got}) if {"mae", "neg_mae"} & set(metrics) else {}
        rows = [(m, int(k), {**s, "mae": mae.get(k), "neg_mae": -mae[k] if mae else None}[_known(m, VALUE_METRICS)]) for k, _, s, _ in got for m in metrics]
        return _summary(spark, rows)
    df = df.persist()
    rows = []
    try:
        for k in sorted(r[0] for r in df.select(fold_col).distinct().collect()):
            f = fit(df.where(col(fold_col) != k), features, label, name, params)
            test = df.where(col(fold_col) == k)
            for m in metrics:
                rows.append((m, int(k), score(f, test, m)))
    finally:
        df.unpersist()
    return _summary(spark, rows)


def _summary(spark, rows: list[tuple]) -> DataFrame:
    long = spark.createDataFrame(rows, "metric string, fold int, value double")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.sort_array(F.collect_list(F.struct("fold", "value"))).alias("values"))


def grid_search(df: DataFrame, features: list[str], label: str, name: str, fold_col: str,
                grid: dict | None = None) -> tuple:
    """(best model, [(parameters, mean score)]) over the declared grid with
    the given fold column; r2 for values, accuracy for classes. Every penalty of
    a ridge and every fold come from one aggregate."""
    spec = REGISTRY[name]
    if spec.make is None:
        raise ValueError(f"{name} has no grid: it has no estimator to cross-validate")
    grid = grid or spec.grid
    if name == "Ridge" and set(grid) == {"alpha"}:
        got = GR.held_out(GR.moments(df, features, label, [fold_col]), [float(a) for a in grid["alpha"]])
        res = [(f"alpha={a:g}", float(np.mean([s["r2"] for _, b, s, _ in got if b == a]))) for a in map(float, grid["alpha"])]
        best = max(range(len(res)), key=lambda i: res[i][1])
        return fit(df, features, label, name, {"alpha": grid["alpha"][best]}), res
    y = col(label).cast("string" if spec.task == "classification" else "double")
    n, folds, classes, sd = df.agg(F.count(F.lit(1)), F.max(col(fold_col)) + 1, F.count_distinct(y) if spec.task == "classification" else F.lit(0),
                                   F.stddev_pop(y) if spec.task != "classification" else F.lit(1.0)).first()
    n_train = n * (folds - 1) / folds  # rows of a training split, of folds of one size
    est = spec.make({**spec.defaults}, n, classes > 2)
    est.setFeaturesCol("__features").setLabelCol("__label" if spec.task == "classification" else label)
    pgb = ParamGridBuilder()
    mapping = {"n_estimators": "numTrees" if "RandomForest" in name else "maxIter", "learning_rate": "stepSize",
               "max_depth": "maxDepth", "alpha": "regParam", "C": "regParam"}
    for k, vals in grid.items():
        pname = mapping.get(k)
        if not pname or not est.hasParam(pname):
            raise ValueError(f"{name} has no grid parameter {k!r}")
        conv = [(30 if v is None else v) if k == "max_depth" else
                1.0 / (float(v) * n_train) if k == "C" else
                float(v) * (sd or 1.0) / n_train if name == "Ridge" else v for v in vals]
        pgb = pgb.addGrid(est.getParam(pname), conv)
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    ev = (MulticlassClassificationEvaluator(labelCol="__label", predictionCol="prediction", metricName="accuracy")
          if spec.task == "classification" else RegressionEvaluator(labelCol=label, predictionCol="prediction",
                                                                    metricName="r2"))
    est.setPredictionCol("prediction")
    stages = [_assembler(features)]
    if spec.task == "classification":
        stages.insert(0, StringIndexer(inputCol=label, outputCol="__label", stringOrderType="alphabetAsc"))
    pre = Pipeline(stages=stages).fit(df)
    data = pre.transform(df).persist()  # read once for every fold and point
    cv = CrossValidator(estimator=est, estimatorParamMaps=pgb.build(), evaluator=ev, numFolds=folds, foldCol=fold_col, seed=SEED)
    try:
        model = cv.fit(data)
    finally:
        data.unpersist()
    return model, list(zip([str(m) for m in pgb.build()], model.avgMetrics))


def learning_curve(df: DataFrame, features: list[str], label: str, name: str, fold_col: str, key,
                   metric: str = "r2", sizes: int = 8) -> DataFrame:
    """Train sizes 10 %..100 % (hash-nested subsets of each training
    fold) × folds → train and validation score mean ± std. Linear models need
    one aggregate for all sizes and folds."""
    from ..functions.core import hash_u
    spark = df.sparkSession
    fracs = [0.1 + 0.9 * i / (sizes - 1) for i in range(sizes)]
    if name in LINEAR and _known(metric, VALUE_METRICS).endswith(("r2", "mse")):
        first = reduce(lambda a, i: F.when(F.col("__u") < fracs[i], F.lit(i)).otherwise(a), reversed(range(sizes)), F.lit(sizes))
        steps = df.withColumn("__u", hash_u(key, SEED, "lc")).withColumn("__step", first)
        got = GR.sizes_curve(GR.moments(steps, features, label, [fold_col, "__step"]), _alpha(name, None), sizes, metric)
        return _curve(spark, [(fracs[i], int(k), a, b) for i, k, a, b in got])
    df = df.withColumn("__u", hash_u(key, SEED, "lc")).persist()
    rows = []
    try:
        folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
        for frac in fracs:
            for k in folds:
                tr = df.where((col(fold_col) != k) & (F.col("__u") < frac))
                f = fit(tr, features, label, name)
                rows.append((frac, int(k), score(f, tr, metric), score(f, df.where(col(fold_col) == k), metric)))
    finally:
        df.unpersist()
    return _curve(spark, rows)


def _curve(spark, rows: list[tuple]) -> DataFrame:
    long = spark.createDataFrame(rows, "size double, fold int, train double, valid double")
    return long.groupBy("size").agg(F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
                                    F.avg("valid").alias("valid_mean"), F.stddev_pop("valid").alias("valid_std"))


def feature_importance(f: Fitted, spark) -> DataFrame | None:
    """Tree importances or mean |coefficient| (over classes), sorted
    descending; None when the model has neither."""
    est = f.model.stages[-1] if f.model is not None else None
    if f.boosted is not None:  # how often a feature is split on
        rows = sorted(zip(f.features, map(float, f.boosted.splits())), key=lambda r: -r[1])
        return spark.createDataFrame(rows, "feature string, importance double")
    if est is None:
        return None
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    elif hasattr(est, "coefficientMatrix"):
        vals = np.abs(est.coefficientMatrix.toArray()).mean(axis=0).tolist()
    elif hasattr(est, "coefficients"):
        vals = np.abs(est.coefficients.toArray()).tolist()
    else:
        return None
    rows = sorted(zip(f.features, [float(v) for v in vals]), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def append_run(spark, path: str, run: dict) -> None:
    """Append one run (name, params, validation, metrics) to a Parquet history."""
    import json
    row = [(run.get("name"), json.dumps(run.get("params", {}), sort_keys=True, default=str), run.get("validation"),
            float(run.get("mean", math.nan)), float(run.get("std", math.nan)), float(time.time()))]
    spark.createDataFrame(row, "name string, params string, validation string, mean double, std double, ts double") \
        .write.mode("append").parquet(path)
