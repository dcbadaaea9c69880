"""End-to-end jobs: the reference's page flows as single Spark plans.

Each job reads its input, composes operators lazily, and returns DataFrames
(or writes them); intermediate results that feed several outputs are cut
with ``checkpoint()`` into the shared ``spark.checkpoint.dir`` (reliable: a
lost executor does not force recomputation from the source).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, hash_u
from ..operators import clean as M
from ..operators import explain as N
from ..operators import features as G
from ..operators import halflife as H
from ..operators import lablog as L
from ..operators import trees as X
from ..operators import metrics as VM
from ..operators import models as T
from ..operators import performance as P
from ..operators import splits as SP
from ..session import ensure_checkpoint_dir
from ..sources import files as S


def performance_index_job(long_df: DataFrame, weights: DataFrame, cfg: P.PipelineConfig | None = None,
                          out: str | None = None) -> DataFrame:
    """P13 with the wide, renamed output (P11) and an error when no row is valid."""
    scored = P.performance_index(long_df, weights, cfg)
    if scored.where("valid").limit(1).count() == 0:
        raise ValueError("no sample has the days that the index needs")
    wide = P.day_columns(scored, (cfg or P.PipelineConfig()).num_days)
    if out:
        S.write_csv(wide, out, bom=True)
    return wide


def half_life_job(df: DataFrame, key: str, r2_threshold: float = 0.80, method: str = "best") -> DataFrame:
    """H1–H8 on a wide table of time columns (headers parsed on the driver)."""
    cols = H.find_time_columns(df.columns)
    d = df.withColumn("pts", H.points_from_columns(df, cols))
    return H.half_life(H.evaluate(d, r2_threshold), method).drop("pts", "lin", "expo", "quad")


def lablog_job(spark, path: str, ncols: int | None = None, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L10 over a folder of header-less lab logs (S4 → L1–L9 → S6)."""
    lines = L.read_log(spark, path, ncols)
    multi, single = L.extraction_job(lines, len(lines.columns) - 2)
    if out:
        S.write_csv(single, out.rstrip("/") + "/single", bom=True)
        S.write_csv(multi, out.rstrip("/") + "/multiple", bom=True)
    return multi, single


@dataclass
class AutoMLConfig:
    """T18 settings (defaults as in the reference's auto-ML page)."""
    n_estimators: int = 300
    min_samples_leaf: int = 3
    max_depth: int | None = None
    test_size: float = 0.2
    seed: int = 42
    max_target: float = 1e5  # M6: larger targets are taken for errors
    task: str = "regression"  # or "classification"


def automl(df: DataFrame, key: str, target: str, groups: dict[str, list[str]], conditions: list[str],
           pairs: list[tuple[str, str]], method_col: str | None = None, cfg: AutoMLConfig | None = None,
           null_mode: str = "fill") -> dict[str, DataFrame]:
    """Group sums (G6), pair winners (G14), role nulls (M5), target
    clean (M6), method one-hot (E1), scaling fitted on train (E6), random
    forest (T3), hold-out metrics (V9; classes: V1, V2), importance by
    exact attribution over all training rows (N1, N2): of two classes the second one's, of more the mean
    absolute attribution over classes."""
    cfg = cfg or AutoMLConfig()
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = G.group_sums(df, groups)
    d, report = G.pair_winners(d, pairs, target)
    dose_cols = [c for cs in groups.values() for c in cs if c in d.columns]
    d = M.role_nulls(d, dose_cols, conditions, null_mode)
    classes = cfg.task == "classification"
    d = M.clean_target(d, target, cfg.task, cfg.max_target)
    if method_col:
        d = M.method_one_hot(d, method_col)
    feats = [c for c in d.columns if c not in (key, target, method_col) and
             dict(d.dtypes)[c] in ("double", "int", "bigint", "float")]
    d = d.select(key, col(target).cast("string").alias(target) if classes else target, *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    d = SP.train_test(d, key, cfg.test_size, cfg.seed).checkpoint()  # reused by fit, scoring and attribution
    params = M.fit_scaler(d.where(~F.col("is_test")), feats, "standard")
    d = M.apply_scaler(d, params)
    f = T.fit(d.where(~F.col("is_test")), feats, target, "RandomForestClassifier" if classes else "RandomForestRegressor",
              {"n_estimators": cfg.n_estimators, "min_samples_leaf": cfg.min_samples_leaf, "max_depth": cfg.max_depth})
    pred = T.predict(f, d.where(F.col("is_test")), keep=[key, target])
    train = d.where(~F.col("is_test"))
    if classes:
        metrics = VM.weighted_scores(pred, target, "__prediction__")
        of = [1] if len(f.classes) == 2 else range(len(f.classes))
        parts = [X.tree_attributions(X.node_tables(f.model, spark, i), train, feats, key) for i in of]
        attr = reduce(DataFrame.unionByName, parts)  # importance() averages the absolute values over all of them
    else:
        metrics = VM.regression_metrics(pred, target, "__prediction__")
        attr = X.tree_attributions(X.node_tables(f.model, spark), train, feats, key)
    return {"metrics": metrics, "pair_report": report, "importance": N.importance(attr), "predictions": pred,
            "features": spark.createDataFrame([(c,) for c in feats], "feature string")}


def safe_region(ref: DataFrame, features: list[str], label: str, safe_class: str, n: int,
                threshold: float = 0.7, bounds: dict | None = None, model: str = "LogisticRegression"):
    """D-flow: sample → score → safe set → ranges and the top-10 table."""
    from ..operators import design as D
    f = T.fit(ref, features, label, model)
    pts = D.sample_uniform(ref.sparkSession, D.observed_bounds(ref, features, bounds), n)
    scored = D.score_classification(f.model.transform(pts), f.classes, safe_class)
    safe = D.safe_set(scored, f.classes.index(safe_class), threshold)
    top = safe.orderBy(F.desc("safe_probability"), F.desc("safety_margin"), "id").limit(10)
    return {"ranges": D.recommended_ranges(safe, features), "top": top, "scored": scored}


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible hash sample of about n rows (sampling operators only)."""
    total = df.count()
    return df if total <= n else df.where(hash_u(key, seed, "sample") < n / total)
