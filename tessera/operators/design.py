"""Design-space search: sampling, scoring, safe sets and recommendations.

Candidate points are generated by Spark (``spark.range(n)``) with hash-uniform
coordinates, so n can be millions spread over every executor, and a point's
coordinates depend only on (seed, id, feature) — a lost partition regenerates
identically. Scoring is one ``model.transform`` pass; probabilities are
handled with array functions (``vector_to_array``, ``array_max``), ranges with
one quantile search.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import col, hash_u, num
from ..functions.quantiles import quantile_values
from ..session import shared_table

DECIMALS = 2  # fixed value: rounding of reported design numbers


def observed_bounds(ref: DataFrame, features: list[str], given: dict | None = None) -> dict[str, tuple]:
    """(lo, hi) per feature from the data, overridden by ``given``."""
    r = ref.agg(*[F.min(num(c)).alias(f"lo{i}") for i, c in enumerate(features)],
                *[F.max(num(c)).alias(f"hi{i}") for i, c in enumerate(features)]).first()
    out = {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(features)}
    out.update(given or {})
    return out


def _uniform_cols(bounds: dict[str, tuple], seed: int) -> list:
    cols = []
    for c, (lo, hi) in bounds.items():
        if lo is None or hi is None:
            cols.append(F.lit(None).cast("double").alias(c))
        elif math.isclose(lo, hi, rel_tol=1e-9, abs_tol=1e-8):
            cols.append(F.lit(float(lo)).alias(c))
        else:
            cols.append((F.lit(float(lo)) + F.lit(float(hi - lo)) * hash_u("id", seed, c)).alias(c))
    return cols


def sample_uniform(spark: SparkSession, bounds: dict[str, tuple], n: int, seed: int = 42,
                   partitions: int | None = None) -> DataFrame:
    """N points, each feature uniform in [lo, hi]; constant when lo ≈ hi."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select("id", *_uniform_cols(bounds, seed))


def sample_dirichlet(spark: SparkSession, features: list[str], total: float, n: int,
                     bounds: dict | None = None, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """Compositions summing to ``total`` (flat Dirichlet: normalised
    exponentials −ln u), then clipped to bounds (clipping can break the sum).
    Other α: per-row gamma draws in ``mapInPandas`` seeded by the row id."""
    ids = spark.range(n)
    if alpha == 1.0:
        e = {c: -F.ln(F.greatest(hash_u("id", seed, "dir_" + c), F.lit(1e-300))) for c in features}
        tot = sum(e.values(), F.lit(0.0))
        df = ids.select("id", *[(e[c] / tot * F.lit(float(total))).alias(c) for c in features])
    else:
        import numpy as np
        import pandas as pd

        feats = list(features)

        def gen(batches):
            for b in batches:
                rows = []
                for i in b["id"].tolist():
                    g = np.random.default_rng([seed, int(i)]).gamma(alpha, 1.0, len(feats))
                    rows.append(g / g.sum() * total)
                out = pd.DataFrame(np.array(rows).reshape(len(b), len(feats)), columns=feats)
                out.insert(0, "id", b["id"].values)
                yield out
        df = ids.mapInPandas(gen, "id long, " + ", ".join(f"`{c}` double" for c in feats))
    for c, (lo, hi) in (bounds or {}).items():
        if c in features:
            df = df.withColumn(c, F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi))))
    return df


def mixed_design(spark: SparkSession, mix_features: list[str], total: float, other_bounds: dict, n: int,
                 mix_bounds: dict | None = None, seed: int = 42) -> DataFrame:
    """D3: flat-Dirichlet columns for the mixture and uniform columns for the
    rest, generated together in one projection over ``range(n)`` (no join)."""
    mix = sample_dirichlet(spark, mix_features, total, n, mix_bounds, 1.0, seed)
    return mix.select("*", *_uniform_cols(other_bounds, seed))


def score_classification(scored: DataFrame, classes: list[str], safe_class: str, prob_col: str = "probability",
                         digits: int | None = DECIMALS) -> DataFrame:
    """Argmax class, the safe class's probability and its margin to the
    best other class. Comparisons use unrounded values (K10); output rounded."""
    from pyspark.ml.functions import vector_to_array
    p = vector_to_array(prob_col) if dict(scored.dtypes)[prob_col] != "array<double>" else col(prob_col)
    k = classes.index(safe_class)
    lab = F.array(*[F.lit(c) for c in classes])
    out = scored.withColumn("__p", p)
    idx = F.array_position(F.col("__p"), F.array_max("__p")) - 1
    other = F.array_max(F.filter("__p", lambda v, i: i != k))
    out = out.withColumns({"pred_class_idx": idx.cast("int"), "pred_class": lab[idx.cast("int")],
                           "safe_probability": F.col("__p")[k],
                           "safety_margin": F.col("__p")[k] - other})
    return out.drop("__p")


def score_regression(pred: DataFrame, pred_col: str = "prediction", objective: str = "maximize") -> DataFrame:
    """Predicted value and objective (± prediction)."""
    y = col(pred_col)
    return pred.withColumns({"predicted_value": y, "objective_score": y if objective == "maximize" else -y})


def safe_set(scored: DataFrame, safe_idx: int, threshold: float, fallback: int = 200) -> DataFrame:
    """Points predicted as the safe class with probability ≥ threshold;
    when none qualifies, the best ``fallback`` safe points by (probability,
    margin)."""
    safe = scored.where(F.col("pred_class_idx") == safe_idx)
    hi = safe.where(F.col("safe_probability") >= threshold)
    if hi.limit(1).count() > 0:
        return hi
    return safe.orderBy(F.desc("safe_probability"), F.desc("safety_margin"), "id").limit(fallback)


def top_fraction(scored: DataFrame, score_col: str = "objective_score", frac: float = 0.10,
                 key: str = "id") -> DataFrame:
    """The best max(1, int(N·frac)) rows by score (ties by key)."""
    n = max(1, int(scored.count() * frac))
    return scored.orderBy(F.desc(score_col), key).limit(n)


def above_quantile(scored: DataFrame, score_col: str = "objective_score", q: float = 0.9) -> DataFrame:
    """Rows scoring at or above the q-quantile."""
    cut = quantile_values(scored, [score_col], [q])[score_col][0]
    return scored.where(col(score_col) >= F.lit(cut))


def recommended_ranges(df: DataFrame, features: list[str], q_low: float = 0.05, q_high: float = 0.95,
                       digits: int = DECIMALS, approx: bool = False) -> DataFrame:
    """Per feature q05, median, q95, min, max (rounded); quantiles exact
    unless ``approx`` (a sketch in the same aggregate)."""
    ps, qs = [q_low, 0.5, q_high], {}
    if not approx:
        df = shared_table(df.select(*[num(c).alias(c) for c in features]), "ranges")  # several scans read the values: made once
        qs = quantile_values(df.select(*[num(c).alias(c) for c in features]), features, ps)
    aggs = []
    for i, c in enumerate(features):
        x = num(c)
        pq = (F.percentile_approx(x, ps, 10000).cast("array<double>") if approx
              else F.array(*[F.lit(v).cast("double") for v in qs[c]]))
        aggs += [pq.alias(f"q{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
    one = df.agg(*aggs)
    recs = [F.struct(F.lit(c).alias("feature"), F.bround(F.col(f"q{i}")[0], digits).alias("low"),
                     F.bround(F.col(f"q{i}")[1], digits).alias("median"),
                     F.bround(F.col(f"q{i}")[2], digits).alias("high"),
                     F.bround(F.col(f"lo{i}"), digits).alias("observed_min"),
                     F.bround(F.col(f"hi{i}"), digits).alias("observed_max"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(features)]
    return one.select(F.explode(F.array(*recs)).alias("r")).select("r.*").where("n > 0").drop("n")


def recommendation_lines(ranges: DataFrame, label: str) -> DataFrame:
    """One text line per feature (plus the heading as line 0)."""
    lines = ranges.select(F.format_string("  %s: %s – %s  (median ≈ %s)", "feature", F.col("low").cast("string"),
                                          F.col("high").cast("string"), F.col("median").cast("string")).alias("line"))
    head = ranges.sparkSession.createDataFrame([(f"Recommended robust range for '{label}':",)], "line string")
    return head.unionByName(lines)


def uncertainty(prob: Column, method: str = "entropy") -> Column:
    """Entropy (−Σ p ln(p+1e-9)), margin (1 − (p1 − p2)) or least
    confident (1 − max p) of a probability array."""
    if method == "entropy":
        return -F.aggregate(prob, F.lit(0.0), lambda a, p: a + p * F.ln(p + F.lit(1e-9)))
    if method == "margin":
        s = F.sort_array(prob, asc=False)
        return 1.0 - (s[0] - F.coalesce(F.try_element_at(s, F.lit(2)), F.lit(0.0)))
    return 1.0 - F.array_max(prob)


def next_experiments(candidates: DataFrame, prob_col: str | None = None, pred_col: str | None = None,
                     method: str = "entropy", n: int = 5, key: str = "id") -> DataFrame:
    """The n most uncertain candidates (regression: |pred − mean pred|)."""
    if pred_col is not None:
        m = candidates.agg(F.avg(pred_col)).first()[0]
        u = F.abs(col(pred_col) - F.lit(m))
    else:
        u = uncertainty(col(prob_col), method)
    return (candidates.withColumn("uncertainty_score", u)
            .orderBy(F.desc("uncertainty_score"), key).limit(n))


def refilter(results: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Keep results inside the bounds; all of them if none would remain."""
    pred = F.lit(True)
    for c, (lo, hi) in bounds.items():
        if c in results.columns:
            pred = pred & col(c).between(lo, hi)
    kept = results.where(pred)
    return kept if kept.limit(1).count() > 0 else results
