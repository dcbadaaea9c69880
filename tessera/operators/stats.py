"""Exploratory statistics (A1–A12) as single-pass aggregates.

Correlations are written out with guarded denominators over pairwise-complete
rows (``corr`` raises on a constant column under ANSI). A k-column matrix is
ONE aggregate of k(k−1)/2 guarded correlations; histograms are a min/max pass
plus one grouped count whose size is the number of bins, never the data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, both, num, safe_corr
from ..functions.orderstats import group_quantiles
from ..functions.quantiles import quantile_values


def corr_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """A1: Pearson r for every pair (pairwise-complete rows), long form (f1, f2, r)."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    one = df.agg(*[safe_corr(num(a), num(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    recs = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*recs)).alias("x")).select("x.*")


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, r, abs_r) of each feature with the target."""
    one = df.agg(*[safe_corr(num(f), num(target)).alias(f"r{i}") for i, f in enumerate(features)])
    recs = [F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r")) for i, f in enumerate(features)]
    return (one.select(F.explode(F.array(*recs)).alias("x")).select("x.*")
            .withColumn("abs_r", F.abs("r")))


def top_by_target(df: DataFrame, features: list[str], target: str, n: int = 5) -> DataFrame:
    """A2: top-n features by |r| with the target (ties by name)."""
    return (target_correlations(df, features, target).where(F.col("r").isNotNull())
            .orderBy(F.desc("abs_r"), "feature").limit(n))


def collinear_pairs(df: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    """A3: pairs with |r| ≥ threshold."""
    return corr_long(df, columns).where(F.abs("r") >= threshold)


def feature_vs_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """A4: per feature, n, r, r², slope, intercept, x range over complete rows;
    features with fewer than 2 complete rows are skipped."""
    aggs = []
    for i, f in enumerate(features):
        x, y = both(num(f), num(target))
        aggs += [F.count(x).alias(f"n{i}"), safe_corr(x, y).alias(f"r{i}"),
                 F.regr_slope(y, x).alias(f"b{i}"), F.regr_intercept(y, x).alias(f"a{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = df.agg(*aggs)
    recs = [F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"),
                     (F.col(f"r{i}") * F.col(f"r{i}")).alias("r2"), F.col(f"b{i}").alias("slope"),
                     F.col(f"a{i}").alias("intercept"), F.col(f"lo{i}").alias("x_min"),
                     F.col(f"hi{i}").alias("x_max")) for i, f in enumerate(features)]
    return one.select(F.explode(F.array(*recs)).alias("x")).select("x.*").where(F.col("n") >= 2)


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; all bins
    reported (zeros included). With ``by``: same edges, counts per group.
    The two edges come from a min/max pass and enter the plan as literals."""
    x = num(column)
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    gcols = ["group"] if by else []
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], ("group string, " if by else "") + "bin int, left double, right double, n long")
    w = (hi - lo) / bins
    idx = (F.lit(0) if hi == lo else
           F.least(F.floor((F.col("__x") - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(bins - 1)))
    keys = [col(by).alias("group")] if by else []
    data = df.select(x.alias("__x"), *keys).where(F.col("__x").isNotNull())
    counts = data.groupBy(*gcols, idx.alias("bin")).agg(F.count("*").alias("n"))
    seq = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = (df.select(col(by).alias("group")).distinct().select("group", seq) if by
            else df.sparkSession.range(1).select(seq))
    edges = grid.select(*gcols, "bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("left"),
                        (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("right"))
    out = edges.join(counts, gcols + ["bin"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def box_stats(df: DataFrame, columns: list[str], by: str | None = None, standardise: bool = False,
              approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at the most extreme values within 1.5·IQR of
    the box, flier count; per column (and per class with ``by``). Quartiles are
    exact, by narrowing (whole columns) or by order statistics of all classes at
    once; with ``approx`` they come from a sketch of bounded memory."""
    keys = [col(by).alias("group")] if by else []
    long = df.select(*keys, *[num(c).alias(c) for c in columns]).unpivot(
        ["group"] if by else [], columns, "column", "x").where(F.col("x").isNotNull())
    g = ["column"] + (["group"] if by else [])
    if standardise:
        m = long.groupBy(*g).agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd"))
        long = long.join(m, g).withColumn("x", F.try_divide(F.col("x") - F.col("mu"), F.col("sd"))).drop("mu", "sd")
    if approx:
        q = long.groupBy(*g).agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q"))
    elif by:
        q = group_quantiles(long, g, "x", [0.25, 0.5, 0.75])
    else:
        wide = long.select(*[F.when(F.col("column") == c, F.col("x")).alias(f"x{i}") for i, c in enumerate(columns)])
        qs = quantile_values(wide, wide.columns, [0.25, 0.5, 0.75])
        q = df.sparkSession.createDataFrame([(c, qs[f"x{i}"]) for i, c in enumerate(columns)],
                                            "column string, q array<double>")
    q = q.select(*g, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = long.join(q if by else F.broadcast(q), g)  # q has one row per column, or per column and group
    return j.groupBy(*g, "q1", "median", "q3").agg(
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_hi"),
        F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("n_fliers"),
        F.count("*").alias("n"))


def kde_grid(df: DataFrame, column: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth
    (σ·n^(−1/5), σ with ddof 1). The grid spans [min − cut·bw, max + cut·bw].
    One pass computes every grid point as an aggregate (no data × grid join)."""
    x = num(column)
    s = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"),
               F.max(x).alias("hi")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    bw = s["sd"] * s["n"] ** (-0.2)
    lo, hi = s["lo"] - cut * bw, s["hi"] + cut * bw
    grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
    norm = 1.0 / (s["n"] * bw * (2 * 3.141592653589793) ** 0.5)
    one = df.where(x.isNotNull()).agg(*[
        F.sum(F.exp(-0.5 * F.pow((F.lit(g) - x) / F.lit(bw), 2))).alias(f"d{k}") for k, g in enumerate(grid)])
    recs = [F.struct(F.lit(g).alias("x"), (F.col(f"d{k}") * norm).alias("density")) for k, g in enumerate(grid)]
    return one.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def pair_plot_data(df: DataFrame, columns: list[str], hue: str | None = None, n: int | None = None,
                   key: str | None = None, seed: int = 42) -> DataFrame:
    """Null-free rows of the chosen columns (+ hue) coerced to
    numbers, optionally a reproducible hash sample of about ``n`` rows."""
    from ..functions.core import hash_u
    sel = [num(c).alias(c) for c in columns] + ([F.col(hue)] if hue else [])
    out = df.select(*sel, *([col(key)] if key else [])).dropna(subset=columns + ([hue] if hue else []))
    if n is not None and key is not None:
        total = out.count()
        if total > n:
            out = out.where(hash_u(key, seed, "sample") < n / total)
    return out


def first_pairs(columns: list[str], n: int = 10) -> list[tuple[str, str]]:
    """A10: the first n column pairs (schema only)."""
    return list(combinations(columns, 2))[:n]


def distinct_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values sorted as text."""
    return (df.select(col(column).cast("string").alias("level")).where(F.col("level").isNotNull())
            .distinct().orderBy("level"))


def residual_summary(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Residual mean and standard deviation (ddof 0)."""
    r = col(y) - col(yhat)
    return df.agg(F.avg(r).alias("resid_mean"), F.stddev_pop(r).alias("resid_std"), F.count(r).alias("n"))
