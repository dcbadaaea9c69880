"""Command line: run the end-to-end jobs on CSV/Parquet inputs.

    python -m tessera profile INPUT OUT
    python -m tessera performance-index FOAM_CSV WEIGHTS_CSV OUT [--days 14] [--model best] [--min-r2 0]
    python -m tessera half-life INPUT OUT [--method best] [--min-r2 0.8] [--key ID_COLUMN]
    python -m tessera stability INPUT OUT --key ID_COLUMN
    python -m tessera lablog FOLDER OUT [--cols N]

INPUT is a CSV file/folder (read with encoding detection and cleaning) or a
``.parquet`` path; OUT is a folder that receives CSV (UTF-8 with BOM).
On a cluster, submit with ``spark-submit -m tessera ...`` style launchers; the
session settings come from the cluster.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame:
    from .sources import files as S
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return S.load_clean(spark, path)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tessera")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("profile")
    p.add_argument("input"), p.add_argument("out")
    p.add_argument("--approx", action="store_true")
    p = sub.add_parser("performance-index")
    p.add_argument("foam"), p.add_argument("weights"), p.add_argument("out")
    p.add_argument("--days", type=int, default=14), p.add_argument("--model", default="best")
    p.add_argument("--min-r2", type=float, default=0.0), p.add_argument("--key", default=None)
    p = sub.add_parser("half-life")
    p.add_argument("input"), p.add_argument("out")
    p.add_argument("--method", default="best"), p.add_argument("--min-r2", type=float, default=0.80)
    p.add_argument("--key", default=None)
    p = sub.add_parser("stability")
    p.add_argument("input"), p.add_argument("out"), p.add_argument("--key", required=True)
    p = sub.add_parser("lablog")
    p.add_argument("folder"), p.add_argument("out"), p.add_argument("--cols", type=int, default=None)
    a = ap.parse_args(argv)

    from .session import get_spark
    from .sources import files as S
    spark = SparkSession.getActiveSession() or get_spark("tessera-cli")

    if a.cmd == "profile":
        from .operators import profile as Q
        df = _read(spark, a.input)
        S.write_csv(Q.profile(df, approx=a.approx), a.out.rstrip("/") + "/profile", bom=True)
        S.write_csv(Q.validate(df), a.out.rstrip("/") + "/warnings", bom=True)
    elif a.cmd == "performance-index":
        from .operators import performance as P
        df = _read(spark, a.foam)
        key = a.key or "__row"
        if a.key is None:
            df = df.withColumn(key, F.monotonically_increasing_id())
        arrays = P.day_arrays_from_wide(df, key, a.days)
        weights = _read(spark, a.weights)
        wcols = weights.columns
        table = P.weight_table(weights, wcols[0], wcols[1])
        cfg = P.PipelineConfig(num_days=a.days, model=a.model, r2_threshold=a.min_r2)
        from .streaming.flows import score_samples
        S.write_csv(df.join(score_samples(arrays, table, cfg).withColumnRenamed("id", key), key, "left"),
                    a.out, bom=True)
    elif a.cmd == "half-life":
        from .plans.jobs import half_life_job
        df = _read(spark, a.input)
        S.write_csv(half_life_job(df, a.key or df.columns[0], a.min_r2, a.method), a.out, bom=True)
    elif a.cmd == "stability":
        from .operators import stability as ST
        df = _read(spark, a.input)
        S.write_csv(df.join(ST.stability(ST.wide_to_long(df, a.key)).withColumnRenamed("id", a.key), a.key, "left"),
                    a.out, bom=True)
    elif a.cmd == "lablog":
        from .plans.jobs import lablog_job
        lablog_job(spark, a.folder, a.cols, a.out)


if __name__ == "__main__":
    main()
