"""Streaming forms of the performance index and the stability flags.

* ``performance_index_stream``: samples arrive as rows carrying their day
  arrays (``id, y: array<double>, tex: array<string>``); every step after the
  arrays is a projection, so the batch plan runs unchanged per micro-batch.
* ``stability_stream``: observations arrive as (id, d, txt); the per-sample
  decision is a keyed aggregate kept in the state store (update mode), so a
  sample's flags refine as later days arrive.

Sinks are chosen by the caller (``memory`` in tests, files/tables in
production) with a checkpoint folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import col
from ..operators import performance as P
from ..operators import stability as S

ARRAY_SCHEMA = "id long, y array<double>, tex array<string>"
OBS_SCHEMA = "id long, d int, txt string"


def score_samples(df: DataFrame, table: list[tuple[str, float]], cfg: P.PipelineConfig) -> DataFrame:
    """P3–P12 on rows that already carry their day arrays (batch or stream)."""
    df = df.withColumn("valid", F.expr(P.valid_sample_expr("y")))
    df = P.fill_curves(df, cfg)
    df = P.fill_labels(df, table)
    df = P.score(df, table, cfg)
    gated = ["r2_linear", "r2_exp", "r2_poly", "best_model", "score_volume", "score_texture", "performance_index"]
    return df.select("id", "valid", *[F.when(F.col("valid"), col(c)).alias(c) for c in gated])


def performance_index_stream(spark: SparkSession, source: str, table: list[tuple[str, float]],
                             cfg: P.PipelineConfig | None = None, fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame of scores over files arriving in ``source``."""
    cfg = cfg or P.PipelineConfig()
    stream = spark.readStream.format(fmt).schema(ARRAY_SCHEMA).load(source)
    return score_samples(stream, table, cfg)


def stability_stream(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame of per-sample stability flags (update mode)."""
    stream = spark.readStream.format(fmt).schema(OBS_SCHEMA).load(source)
    return S.stability(stream)


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory", path: str | None = None):
    """Start a query with a checkpoint (exactly-once file sinks, restartable state)."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(name)
    w = w.format(sink)
    return w.start(path) if path else w.start()
