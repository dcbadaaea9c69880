"""Ordered lines of text files, read in splits.

A file of any size is read by many tasks: Spark cuts it into byte ranges and
hands each task the lines that begin in its range, in order. Every line keeps
its file, the start of its range and its place in the task; counting the lines
of each range (one row a range) and summing over a file's earlier ranges gives
the number of the first line of each range, and so the number of every line.
The split lines are written once, so that counting and numbering see the same
ranges also when a task is run again with other settings.
"""

from __future__ import annotations

import os
import uuid
from itertools import groupby
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_table


def decoded(raw: Column, encoding: str) -> Column:
    """Bytes of a text column in ``encoding`` as text; bytes without a character become U+FFFD.

    UTF-8 passes through. For single-byte encodings the upper 128 bytes are
    looked up in the codec's own table.
    """
    if encoding.lower().replace("-", "").replace("_", "") in ("utf8", "utf8sig"):
        return raw
    codes = [bytes([b]).decode(encoding, "replace") for b in range(128, 256)]
    if bytes(range(128)).decode(encoding, "replace") != "".join(map(chr, range(128))) or any(len(c) != 1 for c in codes):
        raise ValueError(f"{encoding} is not a single-byte encoding over ASCII")
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    moved = [(chr(b), c) for b, c in zip(range(128, 256), codes) if chr(b) != c]
    return F.translate(latin, "".join(a for a, _ in moved), "".join(c for _, c in moved)) if moved else latin


def read_lines(spark: SparkSession, path, encoding: str = "utf-8") -> DataFrame:
    """(file, line_no, text): all lines of the files below ``path``, numbered from 0 in every file.

    Lines end at \\n, \\r\\n or \\r; empty lines are numbered and kept. Files
    without lines give no rows.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__place"), decoded(F.col("value"), encoding).alias("text"))
    lines = shared_table(raw, "lines")
    ranges = lines.groupBy("file", "__start").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    earlier = Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shared_table(ranges.select("file", "__start", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")), "ranges")
    return lines.join(ranges, ["file", "__start"]).select("file", (F.col("__before") + F.col("__place") - F.col("__first")).alias("line_no"), "text")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (file, value) as text files, a folder ``file=...`` for each file; the lines of one must lie side by side in a task.

    Hadoop's local file system starts a process for every folder and file that it
    makes. On it the tasks write the files themselves, under another name until
    they are whole; elsewhere Spark's writer does.
    """
    uri = urlparse(path)
    if uri.scheme not in ("", "file"):
        lines.write.partitionBy("file").option("encoding", "UTF-8").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    folder = unquote(uri.path) if uri.scheme else path

    def run(batches):
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        n = 0
        for name, own in groupby(rows, key=lambda r: r[0]):
            at = os.path.join(folder, f"file={'__HIVE_DEFAULT_PARTITION__' if name is None else name}")
            os.makedirs(at, exist_ok=True)
            part = os.path.join(at, f"_{uuid.uuid4().hex}")
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{v or ''}\n" for _, v in own)
            os.replace(part, os.path.join(at, "part-00000.txt"))
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    os.makedirs(folder, exist_ok=True)
    lines.select("file", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def count_cells(text: Column, sep: str = ",", quote: str = '"') -> Column:
    """Number of cells of a delimited line; separators inside quotes do not count."""
    q = "\\" + quote
    bare = F.regexp_replace(text, f"{q}[^{q}]*{q}", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
