"""Text-observation stability flags (H9, H10; X6, X7, X17).

Observations arrive wide (one text column per day) or long (id, day, text).
The wide form is unpivoted; the per-sample decision is a grouped aggregate —
first failing day, last observed day, any failure by day 14 / 30 — with
partial aggregation, so one sample with many observations costs one row per
task before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..functions.text import is_unstable, normalise_observation


def observation_columns(columns: list[str]) -> list[tuple[str, int]]:
    """Columns whose name holds 'observation' and a day number, by day."""
    out = []
    for c in columns:
        if "observation" in c.lower():
            m = re.search(r"\d+", c)
            if m:
                out.append((c, int(m.group())))
    return sorted(out, key=lambda x: x[1])


def wide_to_long(df: DataFrame, id_col: str) -> DataFrame:
    cols = observation_columns(df.columns)
    recs = [F.struct(F.lit(d).alias("d"), col(c).cast("string").alias("txt")) for c, d in cols]
    return df.select(col(id_col).alias("id"), F.explode(F.array(*recs)).alias("o")).select("id", "o.d", "o.txt")


def stability(long_df: DataFrame, id_col: str = "id", day_col: str = "d", text_col: str = "txt",
              limits=(14, 30)) -> DataFrame:
    """H9: per sample, shelf life = first day with an instability match;
    for each limit L: False if a match on a day ≤ L, NULL if the last
    observed day is before L (unknown), else True."""
    norm = normalise_observation(text_col)
    obs = long_df.select(col(id_col).alias("id"), col(day_col).cast("int").alias("d"), norm.alias("t"))
    bad = F.col("t").isNotNull() & is_unstable("t")
    aggs = [F.min(F.when(bad, F.col("d"))).alias("shelf_life_days"),
            F.coalesce(F.max(F.when(F.col("t").isNotNull(), F.col("d"))), F.lit(0)).alias("max_day")]
    aggs += [F.bool_or(bad & (F.col("d") <= L)).alias(f"bad_{L}") for L in limits]
    g = obs.groupBy("id").agg(*aggs)
    out = g.select("id", "shelf_life_days", *[
        F.when(F.col(f"bad_{L}"), F.lit(False)).when(F.col("max_day") < L, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True)).alias(f"stable_{L}d") for L in limits])
    return out


def normalisation_audit(long_df: DataFrame, text_col: str = "txt", source_col: str | None = None) -> DataFrame:
    """Distinct (original trimmed text → normalised text)."""
    src = [F.col(source_col).alias("source")] if source_col else []
    return (long_df.where(col(text_col).isNotNull())
            .select(*src, F.trim(col(text_col)).alias("original"),
                    normalise_observation(text_col).alias("normalised")).distinct())


def resolve_result_column(columns: list[str], wanted: str) -> str:
    """Existing column with the same name ignoring case, else ``wanted``."""
    for c in columns:
        if c.lower() == wanted.lower():
            return c
    return wanted
