"""Ordered target statistics of categories (T5, second boosted preset).

A category becomes the mean label of the rows of its level that come earlier in
a random order of the table, drawn towards the overall mean by ``weight`` rows:
no row sees its own label, nor one that sees its own. The order is a hash of the
row key. A level may hold any share of the rows: its running sums are cut into
ranges of the hash, each range cumulated in a task of its own and shifted by the
sums of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col
from .splits import hash_rank

#: Rows of one level that a task cumulates, about.
RANGE_ROWS = 500_000


def overall_mean(df: DataFrame, target: str) -> float:
    return df.agg(F.avg(F.nanvl(col(target).cast("double"), F.lit(None)))).first()[0] or 0.0


def ordered_statistics(df: DataFrame, key, levels: list[str], target: str, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """Add ``<level>_stat`` for every column of ``levels``.

    Null is a level. Rows without a label get the statistic of the rows before
    them and add nothing to later ones. Rows that share a key are in an arbitrary
    order among themselves.
    """
    n, prior = df.count(), overall_mean(df, target)
    y = F.nanvl(col(target).cast("double"), F.lit(None))
    ranges = max(1, -(-n // RANGE_ROWS))
    d = df.withColumns({"__u": hash_rank(key, seed, "permutation"), "__y": F.coalesce(y, F.lit(0.0)), "__c": y.isNotNull().cast("bigint")})
    d = d.withColumn("__r", F.floor(F.col("__u") / F.lit((1 << 60) // ranges + 1)).cast("int"))
    for level in levels:
        earlier = Window.partitionBy("__k").orderBy("__kr").rowsBetween(Window.unboundedPreceding, -1)
        per = d.groupBy(col(level).alias("__k"), F.col("__r").alias("__kr")).agg(F.sum("__y").alias("s"), F.sum("__c").alias("c"))
        per = per.select("__k", "__kr", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__n"))
        inside = Window.partitionBy(col(level), "__r").orderBy("__u").rowsBetween(Window.unboundedPreceding, -1)
        d = d.join(per, col(level).eqNullSafe(F.col("__k")) & (F.col("__r") == F.col("__kr")), "left")
        s = F.col("__s") + F.coalesce(F.sum("__y").over(inside), F.lit(0.0))
        c = F.col("__n") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
        d = d.withColumn(f"{level}_stat", (s + F.lit(weight * prior)) / (c + F.lit(weight))).drop("__k", "__kr", "__s", "__n")
    return d.drop("__u", "__y", "__c", "__r")


def level_statistics(df: DataFrame, level: str, target: str, weight: float = 1.0) -> tuple[DataFrame, float]:
    """((level, stat) over all rows, the overall mean): what rows outside the training table get, the mean where a level is unknown."""
    prior = overall_mean(df, target)
    y = F.nanvl(col(target).cast("double"), F.lit(None))
    table = df.groupBy(col(level).alias("level")).agg(((F.coalesce(F.sum(y), F.lit(0.0)) + F.lit(weight * prior)) / (F.count(y) + F.lit(weight))).alias("stat"))
    return table, prior


def apply_statistics(df: DataFrame, level: str, table: DataFrame, prior: float) -> DataFrame:
    """Add ``<level>_stat`` from a table of ``level_statistics``."""
    t = table.select(F.col("level").alias("__k"), F.col("stat").alias("__stat"))
    return df.join(t, col(level).eqNullSafe(F.col("__k")), "left").withColumn(f"{level}_stat", F.coalesce("__stat", F.lit(prior))).drop("__k", "__stat")
