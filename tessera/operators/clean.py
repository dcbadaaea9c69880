"""Missing values, outliers, encoding and scaling.

Pattern throughout: one ``agg`` pass computes the few statistics a step needs
(means, medians, quartiles, levels); those are tiny and become literals in a
single projection or filter over the data — two scans, no per-column jobs, no
joins against the statistics. Medians/quartiles are exact (same interpolation
as pandas) by ``functions.quantiles``, whose memory is bounded at any
cardinality; ``approx=True`` takes one sketch instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, numeric_columns
from ..functions.quantiles import quantile_values
from ..functions.windows import positions

MAX_LEVELS = 1000  # one-hot width guard: more levels than this are refused


# ---------------------------------------------------------------- M1–M7

def impute(df: DataFrame, strategy: str = "mean", columns: list[str] | None = None,
           value=None, approx: bool = False) -> DataFrame:
    """M1–M4: drop (rows NULL in any column), mean, median, mode (smallest among
    ties) or constant fill of the listed (default: numeric) columns."""
    if strategy == "drop":
        return df.dropna()
    cols = columns or numeric_columns(df)
    if strategy == "constant":
        return df.fillna(value if value is not None else 0, subset=cols)
    if strategy == "median":
        stats = {c: v[0] for c, v in quantile_values(df, cols, [0.5], approx).items()}
    else:
        if strategy == "mean":
            aggs = [F.avg(c).alias(c) for c in cols]
        elif strategy == "mode":
            aggs = [F.mode(c, True).alias(c) for c in cols]
        else:
            raise ValueError(f"unknown strategy {strategy!r}")
        stats = df.agg(*aggs).first().asDict()
    return df.withColumns({c: F.coalesce(col(c), F.lit(stats[c]).cast(df.schema[c].dataType))
                           for c in cols if stats[c] is not None})


def role_nulls(df: DataFrame, fill_zero: list[str], drop_if_null: list[str], mode: str = "fill") -> DataFrame:
    """M5: dose-like groups fill 0 (or drop rows in 'drop' mode); condition
    groups always drop rows with NULL."""
    if mode == "fill":
        df = df.fillna(0, subset=fill_zero) if fill_zero else df
        drop = drop_if_null
    else:
        drop = list(fill_zero) + list(drop_if_null)
    return df.dropna(subset=drop) if drop else df


def clean_target(df: DataFrame, target: str, task: str, max_value: float = 1e5) -> DataFrame:
    """M6: regression targets become numbers, NULLs and values > max_value
    dropped; classification drops NULL targets."""
    if task == "regression":
        y = F.nullif(col(target).try_cast("double"), F.lit(float("nan")))
        return df.withColumn(target, y).filter(col(target).isNotNull() & (col(target) <= max_value))
    return df.filter(col(target).isNotNull())


# ---------------------------------------------------------------- M8–M11

def outlier_bounds(df: DataFrame, columns: list[str], method: str = "IQR", k: float = 1.5,
                   z: float = 3.0, approx: bool = False) -> dict[str, tuple]:
    """Bounds per column from one aggregate: IQR → (q1 − k·iqr, q3 + k·iqr);
    z-score → mean ± z·std (ddof 1); std 0 → no bounds (no outliers).
    ``approx``: True takes the quartiles from a sketch."""
    out = {}
    if method == "IQR":
        qs = quantile_values(df, columns, [0.25, 0.75], approx)
        for c in columns:
            q1, q3 = qs[c]
            out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        return out
    r = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
               *[F.stddev_samp(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        m, s = r[f"m{i}"], r[f"s{i}"]
        out[c] = (None, None) if (s is None or s == 0) else (m - z * s, m + z * s)
    return out


def detect_outliers(df: DataFrame, columns: list[str], method: str = "IQR", k: float = 1.5,
                    z: float = 3.0, approx: bool = False) -> DataFrame:
    """M8/M9: per column, count and % (2 dp) of non-null values strictly
    outside the bounds (a second single-pass aggregate)."""
    b = outlier_bounds(df, columns, method, k, z, approx)
    aggs = []
    for i, c in enumerate(columns):
        lo, hi = b[c]
        x = col(c).cast("double")
        hit = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        aggs += [F.count_if(x.isNotNull() & hit).alias(f"o{i}"), F.count(x).alias(f"n{i}")]
    r = df.agg(*aggs)
    recs = [F.struct(F.lit(c).alias("feature"), F.col(f"o{i}").alias("outliers"),
                     F.coalesce(F.bround(F.try_divide(F.col(f"o{i}") * 100.0, F.col(f"n{i}")), 2),
                                F.lit(0.0)).alias("pct"))
            for i, c in enumerate(columns)]
    return r.select(F.explode(F.array(*recs)).alias("r")).select("r.*")


def remove_outliers(df: DataFrame, columns: list[str], method: str = "IQR", k: float = 1.5,
                    z: float = 3.0, approx: bool = False) -> DataFrame:
    """Keep rows inside the bounds of every listed column (inclusive);
    a NULL fails. Zero spread means no bounds (nothing removed for it)."""
    b = outlier_bounds(df, columns, method, k, z, approx)
    keep = F.lit(True)
    for c in columns:
        lo, hi = b[c]
        x = col(c).cast("double")
        keep = keep & (x.between(lo, hi) if lo is not None else (x.isNotNull() if method == "IQR" else F.lit(True)))
    if method != "IQR":
        for c in columns:
            keep = keep & col(c).isNotNull()
    return df.filter(keep)


def most_affected(summary: DataFrame, n: int = 5) -> DataFrame:
    """Top-n features by outlier count (ties by name)."""
    return summary.orderBy(F.desc("outliers"), "feature").limit(n)


# ---------------------------------------------------------------- E1–E5

def levels(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null levels, refusing more than ``limit``."""
    lv = [r[0] for r in df.select(column).where(col(column).isNotNull()).distinct()
          .orderBy(column).limit(limit + 1).collect()]
    if len(lv) > limit:
        raise ValueError(f"{column} has more than {limit} levels; encode it with label codes instead")
    return lv


def levels_many(df: DataFrame, columns: list[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null text levels of several columns: the distinct
    (column, level) pairs are counted per column first (one small row per
    column) and only collected when every column is within ``limit``."""
    if not columns:
        return {}
    long = df.select(*[col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "v")
    pairs = long.where(F.col("v").isNotNull()).select("column", "v").distinct()
    for r in pairs.groupBy("column").agg(F.count("*").alias("k")).collect():
        if r["k"] > limit:
            raise ValueError(f"{r['column']} has more than {limit} levels; encode it with label codes instead")
    out = {c: [] for c in columns}
    for r in pairs.collect():  # at most limit × len(columns) rows
        out[r["column"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, columns: list[str], sep: str = "_", null_level: str | None = None,
            keep_source: bool = False) -> DataFrame:
    """One 0/1 column per level (all levels kept); NULL → all zeros,
    or its own level named ``null_level``. Levels of all columns come from
    one job."""
    srcs = {c: col(c).cast("string") for c in columns}
    if null_level is not None:
        srcs = {c: F.coalesce(s_, F.lit(null_level)) for c, s_ in srcs.items()}
    lvs = levels_many(df.select(*[s_.alias(c) for c, s_ in srcs.items()]), columns)
    out = df
    for c in columns:
        out = out.withColumns({f"{c}{sep}{v}": (srcs[c] == F.lit(v)).cast("int") for v in lvs[c]})
        if not keep_source:
            out = out.drop(c)
    return out


def label_codes(df: DataFrame, columns: list[str], null_text: str = "nan", as_double: bool = False) -> DataFrame:
    """Codes in sorted order of the text value (NULL becomes text
    'nan' and is coded like any other level). The level table is distinct
    values only; it is numbered in ranges and joined back (broadcast when
    small, shuffle join otherwise — AQE decides from its real size)."""
    out = df
    for c in columns:
        txt = F.coalesce(col(c).cast("string"), F.lit(null_text))
        lv = positions(df.select(txt.alias("__v")).distinct(), "__v", "__code")
        lv = lv.withColumn("__code", F.col("__code").cast("double" if as_double else "int"))
        out = (out.withColumn("__v", txt).join(lv, "__v", "left").drop("__v", c)
               .withColumnRenamed("__code", c))
    return out


def factorize(df: DataFrame, column: str, order_key: str, out: str | None = None) -> DataFrame:
    """Codes in first-seen order (by ``order_key``); NULL stays NULL (-1 in
    pandas). Levels first seen under one key are numbered by value."""
    first = df.where(col(column).isNotNull()).groupBy(col(column)).agg(F.min(col(order_key)).alias("__first"))
    first = first.select(column, F.struct("__first", col(column)).alias("__at"))
    coded = positions(first, "__at", "__code").select(column, F.col("__code").cast("int").alias(out or f"{column}_code"))
    return df.join(coded, column, "left")


def method_one_hot(df: DataFrame, column: str, prefix: str = "Concen_Ratio_Method_") -> DataFrame:
    """E5: whitespace collapsed and trimmed, NULL is its own level 'nan';
    one 1.0/0.0 column per level named prefix + slug (X16, 40 chars; levels
    whose slugs agree are told apart by the suffixes of S8)."""
    import re

    from ..sources.files import dedupe_names
    clean = F.coalesce(F.regexp_replace(F.trim(col(column).cast("string")), "\\s+", " "), F.lit("nan"))
    lv = levels(df.select(clean.alias("v")), "v")
    # level names are schema: the same slug rule as functions.text.slug, on the driver
    names = dedupe_names([re.sub(r"[^a-z0-9]+", "_", v.lower())[:40].strip("_") for v in lv])
    return df.withColumns({f"{prefix}{n}": (clean == F.lit(v)).cast("double") for v, n in zip(lv, names)})


# ---------------------------------------------------------------- E6–E10

def fit_scaler(train: DataFrame, columns: list[str], kind: str = "standard", approx: bool = False) -> dict:
    """E6–E8 fit: per column (centre, scale) from one aggregate over train.
    standard: mean, std ddof 0; minmax: min, range; robust: median, IQR.
    A zero scale becomes 1 (constant columns map to 0)."""
    aggs = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        if kind == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif kind == "minmax":
            aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        elif kind != "robust":
            raise ValueError(f"unknown scaler {kind!r}; choose standard, minmax or robust")
    if kind == "robust":
        qs = quantile_values(train, columns, [0.25, 0.5, 0.75], approx)
        return {c: (qs[c][1], (qs[c][2] - qs[c][0]) if qs[c][0] is not None and qs[c][2] != qs[c][0] else 1.0)
                for c in columns}
    r = train.agg(*aggs).first()
    return {c: (r[f"a{i}"], r[f"b{i}"] if r[f"b{i}"] not in (None, 0, 0.0) else 1.0)
            for i, c in enumerate(columns)}


def apply_scaler(df: DataFrame, params: dict, keep_original_suffix: str | None = None) -> DataFrame:
    """E6–E9 apply: (x − centre) / scale; optionally keep the original-unit twin."""
    cols = {}
    for c, (a, b) in params.items():
        if keep_original_suffix:
            cols[c + keep_original_suffix] = col(c)
        cols[c] = (col(c).cast("double") - F.lit(a)) / F.lit(b)
    return df.withColumns(cols)


def inverse_scaler(df: DataFrame, params: dict) -> DataFrame:
    """Back to original units: x·scale + centre."""
    return df.withColumns({c: col(c) * F.lit(b) + F.lit(a) for c, (a, b) in params.items()})


def align_to_features(df: DataFrame, features: list[str], keep=()) -> DataFrame:
    """Model schema order; missing features become 0, NULLs 0."""
    have = set(df.columns)
    return df.select(*[col(k) for k in keep],
                     *[(F.coalesce(col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
                       for f in features])
