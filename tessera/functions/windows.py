"""Running aggregates and ranks without one task per (possibly huge) partition key.

A plain ``max(v) over (partition by k order by o)`` sorts every row of a key
in one task; a key holding a third of the data then runs on one core. For
associative aggregates (max, min, sum) the running value is split in two:
a per-(key, bucket) aggregate over a coarse bucket of the ordering column —
a table with one row per bucket — gives each bucket its prefix from earlier
buckets, and a window partitioned by (key, bucket) finishes the job inside
the bucket. No window ever holds more than one bucket. ``positions`` numbers
the rows of a whole table the same way, over range partitions. ``neighbours``
gives every row values of the rows before and after it, and ``numbered`` its
number in its key, also across the edges of the buckets: each bucket's first and
last row and its row count are a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .core import col

_AGG = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: a + b)}


def running(df: DataFrame, keys: list[str], order: str, value: Column, out: str, fn: str = "max",
            bucket_width: int = 1_000_000) -> DataFrame:
    """Add ``out`` = running ``fn`` of ``value`` over rows with order ≤ current
    (ties in ``order`` are broken by row position inside the bucket)."""
    agg, combine = _AGG[fn]
    b = F.floor(col(order) / F.lit(bucket_width))
    d = df.withColumn("__v", value).withColumn("__b", b)
    per = d.groupBy(*keys, "__b").agg(agg("__v").alias("__bv"))
    wb = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__b", agg("__bv").over(wb).alias("__prefix"))
    w = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(per, keys + ["__b"], "left").withColumn("__in", agg("__v").over(w))
    res = F.when(F.col("__prefix").isNull(), F.col("__in")).when(F.col("__in").isNull(), F.col("__prefix")) \
        .otherwise(combine(F.col("__prefix"), F.col("__in")))
    return d.withColumn(out, res).drop("__v", "__b", "__bv", "__prefix", "__in")


def positions(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out`` = 0, 1, … in the order of ``order`` (distinct values, NULL first).

    Rows are dealt by ranges of ``order`` and written to the checkpoint folder
    with the number of their range; each range is numbered on its own and
    shifted by the rows of the ranges before it (one row per range).
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()).checkpoint()
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__p").count().select(
        "__p", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return (parts.withColumn("__r", inside).join(starts, "__p")
            .withColumn(out, F.col("__start") + F.col("__r") - 1).drop("__p", "__r", "__start"))


def neighbours(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[Column, int]], bucket_width: int = 100_000) -> DataFrame:
    """Add columns that hold a value of the row before (-1) or after (1) in ``order``.

    ``values`` maps a new column's name to (value, -1 or 1). Rows of one key are
    dealt to buckets of the ``order`` column; inside a bucket ``lag`` and ``lead``
    do the work, and a bucket's first and last rows look at the nearest bucket
    that has rows. At the ends of a key the new columns are null.
    """
    d = df.withColumn("__b", F.floor(col(order) / F.lit(bucket_width)))
    d = d.withColumns({f"__v_{n}": v for n, (v, _) in values.items()})
    names = {step: [n for n, (_, s) in values.items() if s == step] for step in (-1, 1)}
    edge = {-1: F.max_by, 1: F.min_by}  # the row before a bucket is the last one of an earlier bucket
    sides = [step for step in (-1, 1) if names[step]]
    per = d.groupBy(*keys, "__b").agg(*[edge[s](F.struct(*[f"__v_{n}" for n in names[s]]), order).alias(f"__e{i}") for i, s in enumerate(sides)])
    across = Window.partitionBy(*keys).orderBy("__b")
    per = per.select(*keys, "__b", *[(F.lag if s < 0 else F.lead)(f"__e{i}").over(across).alias(f"__h{i}") for i, s in enumerate(sides)])
    per = per.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), *[f"__h{i}" for i in range(len(sides))])
    d = d.join(per, _same_bucket(keys), "left")
    w = Window.partitionBy(*keys, "__b").orderBy(order)
    for i, s in enumerate(sides):
        # A row's struct of values is never null, so a null neighbour inside the bucket means its edge.
        near = (F.lag if s < 0 else F.lead)(F.struct(*[f"__v_{n}" for n in names[s]])).over(w)
        d = d.withColumn(f"__s{i}", F.coalesce(near, F.col(f"__h{i}")))
    out = {n: F.col(f"__s{i}.__v_{n}") for i, s in enumerate(sides) for n in names[s]}
    return d.select(*[col(x) for x in df.columns if x not in out], *[v.alias(n) for n, v in out.items()])


def numbered(df: DataFrame, keys: list[str], order: str, out: str, bucket_width: int = 100_000) -> DataFrame:
    """Add ``out`` = 1, 2, ... in ``order`` within each key, over buckets of the ``order`` column."""
    d = df.withColumn("__b", F.floor(col(order) / F.lit(bucket_width)))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*keys, "__b").count().select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"),
                                                 F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    d = d.join(per, _same_bucket(keys), "left")
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order))
    return d.withColumn(out, F.col("__before") + inside).select(*[col(x) for x in df.columns if x != out], out)


def _same_bucket(keys: list[str]) -> Column:
    on = F.col("__b") == F.col("__kb")
    for i, k in enumerate(keys):
        on = on & col(k).eqNullSafe(F.col(f"__k{i}"))
    return on
