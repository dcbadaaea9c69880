"""Profiling and data-quality checks (Q1–Q12).

Two scans at most per report:
* one global ``agg`` over all columns for counts and moments (partial
  aggregation per task, a single tiny row reaches the driver);
* one frequency table ``(column, value) -> count`` built with ``unpivot`` and
  a grouped count, for exact distinct counts, modes and shares. Its partial
  aggregation combines hot values map-side, so a value holding a third of the
  rows costs one row per task before the shuffle.

``approx=True`` swaps exact distinct counts and percentiles for HyperLogLog
and ``percentile_approx`` (bounded memory per group at any scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, categorical_columns, is_numeric, numeric_columns
from ..functions.quantiles import quantile_values

LARGE_ROWS = 1000  # fixed value: "large dataset" notice threshold


def _dtype_name(dt) -> str:
    return dt.simpleString()


def _number(df: DataFrame, c: str):
    """A numeric column as struct(d: double, w: bigint): whole numbers keep all their digits."""
    x = F.col("`" + c + "`")
    whole = df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")
    d, w = (F.lit(None), x) if whole else (x, F.lit(None))
    return F.when(x.isNotNull(), F.struct(d.cast("double").alias("d"), w.cast("bigint").alias("w")))


def _number_text(value):
    """Whole numbers below 2 ** 53 read like the doubles of other columns."""
    d, w = value["d"], value["w"]
    return F.when(w.isNull() | (w.cast("double").cast("bigint") == w), F.coalesce(d, w.cast("double")).cast("string")).otherwise(w.cast("string"))


def frequency_table(df: DataFrame, columns: list[str] | None = None, keep_null: bool = False) -> DataFrame:
    """(column, value, n): value counts of every listed column, values as text.

    Numeric columns are counted on their numeric value and only the distinct
    values are turned into text afterwards (casting every row to a string
    is the expensive part); text columns are counted as they are."""
    columns = columns or df.columns
    nums = [c for c in columns if is_numeric(df.schema[c].dataType)]
    txt = [c for c in columns if c not in nums]
    parts = []
    for cols, cell, as_text in ((nums, _number, _number_text),
                                (txt, lambda df, c: F.col("`" + c + "`").cast("string"), lambda value: value)):
        if not cols:
            continue
        long = df.select(*[cell(df, c).alias(c) for c in cols]).unpivot(
            [], cols, "column", "value")
        if not keep_null:
            long = long.filter(F.col("value").isNotNull())
        parts.append(long.groupBy("column", "value").agg(F.count("*").alias("n"))
                     .select("column", as_text(F.col("value")).alias("value"), "n"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def validate(df: DataFrame) -> DataFrame:
    """Q1: warnings as rows (check, column, value).

    checks: empty, duplicate_name, high_missing (>50 % null, value = null %),
    constant (≤1 distinct value with NULL counted as a value, value = count of
    values), large (>1000 rows, value = rows). Distinct counts come from the
    frequency table, not from one COUNT(DISTINCT) per column (which would
    expand every row once per column before the shuffle).
    """
    spark = df.sparkSession
    cols = df.columns
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    per = (frequency_table(df, cols, keep_null=True).groupBy("column")
           .agg(F.count("*").alias("n_values"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls")))
    per = per.crossJoin(n)  # one-row side
    miss = per.select(F.lit("high_missing").alias("check"), "column",
                      F.bround(F.col("nulls") * 100.0 / F.col("n_rows"), 2).alias("value")
                      ).where(F.col("nulls") * 2 > F.col("n_rows"))
    const = per.select(F.lit("constant").alias("check"), "column",
                       F.col("n_values").cast("double").alias("value")).where(F.col("n_values") <= 1)
    glob = n.select(F.explode(F.array(
        F.struct(F.lit("empty").alias("check"), F.lit(None).cast("string").alias("column"),
                 F.lit(0.0).alias("value"), (F.col("n_rows") == 0).alias("hit")),
        F.struct(F.lit("large").alias("check"), F.lit(None).cast("string").alias("column"),
                 F.col("n_rows").cast("double").alias("value"), (F.col("n_rows") > LARGE_ROWS).alias("hit"))
    )).alias("w")).select("w.*").filter("hit").drop("hit")
    out = glob.unionByName(miss).unionByName(const)
    dup = sorted({c for c in cols if cols.count(c) > 1})
    if dup:
        out = out.unionByName(spark.createDataFrame(
            [("duplicate_name", c, float(cols.count(c))) for c in dup], "check string, column string, value double"))
    return out


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q2: one row per column: counts, null %, dtype, distinct count and a
    describe block (numeric: mean, std ddof 1, min, quartiles, max; text:
    top value — smallest among ties — and its frequency)."""
    cols = df.columns
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs.append(F.count(col(c)).alias(f"nn{i}"))
        if approx is True:
            aggs.append(F.approx_count_distinct(col(c)).alias(f"nd{i}"))
    quartiles = {} if approx is True else quantile_values(df, num, [0.25, 0.5, 0.75])
    for i, c in enumerate(cols):
        if c in num:
            x = col(c).cast("double")
            pct = (F.percentile_approx(x, [0.25, 0.5, 0.75], 10000) if approx is True
                   else F.array(*[F.lit(v).cast("double") for v in quartiles[c]]))
            aggs += [F.avg(x).alias(f"mu{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), pct.cast("array<double>").alias(f"q{i}")]
    stats = df.agg(*aggs)
    recs = []
    for i, c in enumerate(cols):
        isnum = c in num
        d = (lambda k: F.col(f"{k}{i}")) if isnum else (lambda k: F.lit(None).cast("double"))
        q = (lambda j: F.col(f"q{i}")[j]) if isnum else (lambda j: F.lit(None).cast("double"))
        recs.append(F.struct(
            F.lit(c).alias("column"), F.lit(_dtype_name(df.schema[c].dataType)).alias("data_type"),
            F.col("__n").alias("total_count"), F.col(f"nn{i}").alias("not_null_count"),
            (F.col("__n") - F.col(f"nn{i}")).alias("null_count"),
            F.bround((F.col("__n") - F.col(f"nn{i}")) * 100.0 / F.col("__n"), 2).alias("null_pct"),
            (F.col(f"nd{i}") if approx is True else F.lit(None).cast("long")).alias("n_unique"),
            d("mu").alias("mean"), d("sd").alias("std"), d("lo").alias("min"),
            q(0).alias("p25"), q(1).alias("p50"), q(2).alias("p75"), d("hi").alias("max")))
    base = stats.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
    if approx is True:
        cat = categorical_columns(df)
        top = _top_values(df, cat) if cat else None
    else:
        # one grouped pass over the frequency table gives distinct counts and
        # the top value (smallest among ties) of every column
        cat = categorical_columns(df)
        freq = frequency_table(df, cols)
        best = F.min_by(F.struct(F.col("value"), F.col("n")), F.struct(-F.col("n"), F.col("value")))
        per = freq.groupBy("column").agg(F.count("*").alias("n_unique_"), best.alias("b"))
        per = per.select("column", "n_unique_",
                         F.when(F.col("column").isin(cat), F.col("b.value")).alias("top"),
                         F.when(F.col("column").isin(cat), F.col("b.n")).alias("freq"))
        out = base.join(per, "column", "left")
        return (out.withColumn("n_unique", F.coalesce("n_unique_", F.lit(0)).cast("long")).drop("n_unique_")
                .select(*base.columns, "top", "freq"))
    if top is None:
        return base.withColumn("top", F.lit(None).cast("string")).withColumn("freq", F.lit(None).cast("long"))
    return base.join(top, "column", "left")


def _top_from_freq(freq: DataFrame) -> DataFrame:
    """Most frequent value per column, smallest value among ties."""
    best = F.min_by(F.struct(F.col("value"), F.col("n")), F.struct(-F.col("n"), F.col("value")))
    return freq.groupBy("column").agg(best.alias("b")).select(
        "column", F.col("b.value").alias("top"), F.col("b.n").alias("freq"))


def _top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return _top_from_freq(frequency_table(df, columns))


def dataset_card(df: DataFrame) -> DataFrame:
    """Q3: rows, columns, numeric and categorical counts, missing-cell %."""
    cols = df.columns
    n_num = len(numeric_columns(df))
    nulls = sum((F.count(F.lit(1)) - F.count(col(c)) for c in cols), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), nulls.alias("_nulls")).select(
        "n_rows", F.lit(len(cols)).cast("long").alias("n_columns"),
        F.lit(n_num).cast("long").alias("n_numeric"), F.lit(len(cols) - n_num).cast("long").alias("n_categorical"),
        F.bround(F.try_divide(F.col("_nulls") * 100.0, F.col("n_rows") * len(cols)), 2).alias("missing_pct"))


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q4: per categorical column: n_unique, top value (smallest among ties),
    top frequency, null count."""
    cols = columns or categorical_columns(df)
    freq = frequency_table(df, cols, keep_null=True)
    nn = freq.filter(F.col("value").isNotNull())
    best = F.min_by(F.struct(F.col("value"), F.col("n")), F.struct(-F.col("n"), F.col("value")))
    per = freq.groupBy("column").agg(
        F.count(F.col("value")).alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"))
    tops = nn.groupBy("column").agg(best.alias("b")).select("column", F.col("b.value").alias("top_value"),
                                                          F.col("b.n").alias("top_freq"))
    return (per.join(tops, "column", "left")
            .select("column", "n_unique", "top_value", F.coalesce("top_freq", F.lit(0)).alias("top_freq"),
                    "null_count"))


def categorical_warnings(df: DataFrame, columns: list[str] | None = None, max_levels: int = 20,
                         dominant_pct: float = 90.0) -> DataFrame:
    """Q5: 'High cardinality (k unique)' above max_levels; 'Dominant class (p %)'
    when the top share of non-null values exceeds dominant_pct."""
    cols = columns or categorical_columns(df)
    freq = frequency_table(df, cols)
    per = freq.groupBy("column").agg(F.count("*").alias("k"), F.max("n").alias("top"), F.sum("n").alias("tot"))
    share = F.col("top") * 100.0 / F.col("tot")
    hi = F.when(F.col("k") > max_levels, F.format_string("High cardinality (%d unique)", F.col("k")))
    dom = F.when(share > dominant_pct, F.format_string("Dominant class (%.1f %%)", share))
    return per.select("column", F.concat_ws("; ", hi, dom).alias("warning")).filter(F.col("warning") != "")


def categorical_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q6: share of each value among non-null values, percent with 2 decimals."""
    cols = columns or categorical_columns(df)
    freq = frequency_table(df, cols)
    tot = freq.groupBy("column").agg(F.sum("n").alias("tot"))
    return freq.join(tot, "column").select("column", "value",
                                            F.bround(F.col("n") * 100.0 / F.col("tot"), 2).alias("pct"))


def null_report(df: DataFrame) -> DataFrame:
    """Q7: columns that contain NULLs with their null fraction (descending)."""
    cols = df.columns
    one = df.agg(*[F.avg(col(c).isNull().cast("double")).alias(c) for c in cols])
    long = one.unpivot([], cols, "column", "null_frac")
    return long.filter(F.col("null_frac") > 0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Q8: class / group counts, NULL kept as its own group."""
    return df.groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))


def percent_columns_outside(df: DataFrame, groups: dict[str, list[str]]) -> list[str]:
    """Q9: columns whose name carries '%' but belong to no role group (schema only)."""
    known = {c for cs in groups.values() for c in cs}
    return [c for c in df.columns if "%" in c and c not in known]


def null_impact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q10: rows with a NULL in any chosen column, and their % of all rows."""
    anynull = F.lit(False)
    for c in columns:
        anynull = anynull | col(c).isNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(anynull).alias("n_affected")).select(
        "n_rows", "n_affected", F.bround(F.try_divide(F.col("n_affected") * 100.0, F.col("n_rows")), 2)
        .alias("pct_affected"))


def row_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q11: before/after row counts and rows removed (two counts, one row)."""
    b = before.agg(F.count("*").alias("n_before"), F.lit(None).cast("long").alias("n_after"))
    a = after.agg(F.lit(None).cast("long").alias("n_before"), F.count("*").alias("n_after"))
    both = b.unionByName(a).agg(F.max("n_before").alias("n_before"), F.max("n_after").alias("n_after"))
    return both.select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"))


def model_ready_overview(df: DataFrame, target: str, features: list[str], task: str,
                         n_before: DataFrame | None = None) -> DataFrame:
    """Q12: rows, features, and target median/range (regression) or the class
    count and largest class (classification)."""
    y = col(target)
    if task == "regression":
        median = quantile_values(df, [target], [0.5])[target][0]
        return df.agg(F.count("*").alias("n_rows"), F.lit(len(features)).alias("n_features"),
                      F.lit(median).cast("double").alias("target_median"),
                      F.min(y).cast("double").alias("target_min"), F.max(y).cast("double").alias("target_max"))
    counts = df.groupBy(y.alias("cls")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.lit(len(features)).alias("n_features"),
                      F.count("*").alias("n_classes"),
                      F.min_by(F.col("cls").cast("string"), F.struct(-F.col("n"), F.col("cls"))).alias("largest_class"),
                      F.max("n").alias("largest_class_n"))
