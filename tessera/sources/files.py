"""CSV sources and sinks.

Encoding is chosen per file before parsing (Spark would silently replace
undecodable bytes): one job over ``binaryFile`` tries strict decodes in order
and reports the first that works; each group of files is then read with its
encoding. Cleaning runs as column expressions after a plain all-string read.
"""

from __future__ import annotations

import re
import itertools
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.core import col
# Encodings tried in order.
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "cp1252"]


def detect_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Encoding → files, from strict decodes run on the executors."""
    def first_ok(b: bytes) -> str:
        for enc in ENCODINGS:
            try:
                b.decode(enc)
                return "utf-8" if enc == "utf-8-sig" else enc
            except UnicodeDecodeError:
                continue
        return "cp1252"
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "enc": [first_ok(bytes(x)) for x in b["content"]]})
    rows = (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInPandas(run, "path string, enc string").collect())
    out = defaultdict(list)
    for r in rows:
        out[r["enc"]].append(r["path"])
    return dict(out)


def dedupe_names(names: list[str]) -> list[str]:
    """A repeated name gets the next free suffix .1, .2, …; the first of its kind keeps it."""
    taken, out = set(names), []
    for i, name in enumerate(names):
        if name in names[:i]:
            name = next(x for x in (f"{name}.{k}" for k in itertools.count(1)) if x not in taken)
            taken.add(name)
        out.append(name)
    return out


def load_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Header + inferred types; per-file encoding; BOM stripped from the
    first header; duplicate header names deduplicated (S8)."""
    groups = detect_encodings(spark, path)
    frames = []
    for enc, files in groups.items():
        frames.append(spark.read.csv(files, header=True, inferSchema=infer, encoding=enc))
    if not frames:
        raise ValueError("no input files")
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    names = [re.sub("^\ufeff", "", c) for c in df.columns]
    return df.toDF(*dedupe_names(names))


def clean_name(name: str, nbsp: str = "space") -> str:
    """S2/S3 header cleaning: NBSP → space (or removed), drop 'Â' and '*',
    collapse spaces, trim."""
    s = name.replace("\u00a0", " " if nbsp == "space" else "").replace("Â", "").replace("*", "")
    return re.sub(r"\s+", " ", s).strip()


def clean_cells(df: DataFrame, nbsp: str = "space") -> DataFrame:
    """S2/S3 cell cleaning on every string column; blank → NULL."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            c = F.regexp_replace(col(f.name), "\u00a0", " " if nbsp == "space" else "")
            c = F.regexp_replace(c, "[Â*]", "")
            c = F.trim(F.regexp_replace(c, "\\s+", " "))
            cols.append(F.when(c != "", c).alias(f.name))
        else:
            cols.append(col(f.name))
    return df.select(*cols)


def load_clean(spark: SparkSession, path: str, nbsp: str = "space") -> DataFrame:
    """S2 (nbsp='space') / S3 (nbsp='remove'): all-string read, cleaned and
    deduplicated headers, cleaned cells; an empty input is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if not df.columns:
        raise ValueError("empty input")
    names = dedupe_names([clean_name(re.sub("^\ufeff", "", c), nbsp) for c in df.columns])
    return clean_cells(df.toDF(*names), nbsp)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every column is NULL."""
    return df.dropna(how="all")


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; ``bom`` prefixes the header with U+FEFF so
    spreadsheet tools detect UTF-8."""
    out = df.toDF(*(["\ufeff" + df.columns[0]] + df.columns[1:])) if bom and df.columns else df
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def preview(df: DataFrame, key: str | list[str], n: int = 1000) -> DataFrame:
    """First n rows in key order (an order is needed for a fixed answer)."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(n)
