"""Numbered lines of split files, and neighbours across bucket edges, against plain Python."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import windows as W
from tessera.operators import lablog as L
from tessera.sources import lines as R


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "211", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_across_splits(spark, small_splits):
    rng = random.Random(7)
    d = tempfile.mkdtemp(prefix="tessera-lines-")
    want = set()
    for name, end in (("a.txt", "\n"), ("b.txt", "\r\n"), ("c.txt", "\n"), ("empty.txt", "\n")):
        texts = [] if name == "empty.txt" else ["".join(rng.choice("ab é€–ÿ,") for _ in range(rng.choice([0, 1, 9, 300]))) for _ in range(200)]
        with open(os.path.join(d, name), "wb") as fh:
            fh.write("".join(t + end for t in texts).encode("cp1252"))
        want |= {(name, i, t) for i, t in enumerate(texts)}
    got = R.read_lines(spark, d, "cp1252").withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert spark.read.text(d).rdd.getNumPartitions() > 20
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_encodings_with_more_bytes_are_refused(spark):
    with pytest.raises(ValueError):
        R.decoded(F.col("x"), "utf-16")


def test_width_comes_from_the_data(spark, small_splits):
    d = tempfile.mkdtemp(prefix="tessera-width-")
    with open(os.path.join(d, "x.csv"), "w") as fh:
        fh.write('a,"b,c"\n\n' + ",".join(f"v{i}" for i in range(15)) + "\n1\n")
    got = L.read_log(spark, d)
    rows = {r.line_no: r for r in got.collect()}
    assert got.columns[-1] == "c14" and set(rows) == {0, 2, 3}
    assert rows[0].c1 == "b,c" and rows[0].c2 is None and rows[2].c14 == "v14" and rows[3].c0 == "1"
    with pytest.raises(ValueError):
        L.read_log(spark, d, 12)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_neighbours_and_numbers_across_buckets(spark, width):
    rng = random.Random(width)
    rows = [(k, o, rng.choice([None, "x", "y"])) for k in ("a", "b", None) for o in sorted(rng.sample(range(500), 60))]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    got = W.neighbours(df, ["k"], "o", {"p": (F.col("v"), -1), "po": (F.col("o"), -1), "n": (F.col("v"), 1)}, width)
    got = W.numbered(got, ["k"], "o", "nth", width)
    by = {(r.k, r.o): r for r in got.collect()}
    assert len(by) == len(rows)
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        for i, (_, o, v) in enumerate(own):
            r = by[(k, o)]
            before, after = own[i - 1] if i else (None,) * 3, own[i + 1] if i + 1 < len(own) else (None,) * 3
            assert (r.v, r.p, r.po, r.n, r.nth) == (v, before[2], before[1], after[2], i + 1)


def test_extract_does_not_depend_on_buckets(spark, sf, monkeypatch):
    from tessera.sources import views as V

    def records():
        samples, form, dil = L.extract(V.lab_log(spark, sf).where("file < 3"), 5)
        return [sorted(map(str, x.withColumn("doses", F.map_entries("doses")).collect() if "doses" in x.columns else x.collect())) for x in (samples, form, dil)]

    whole = records()
    monkeypatch.setattr(L, "BUCKET", 37)
    assert records() == whole and len(whole[0]) > 100


def test_no_window_by_file_alone(spark, sf):
    from tessera.sources import views as V

    plan = L.classify(V.lab_log(spark, sf), 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "line_no" in x]
    assert windows and all("__b" in x.split("], [")[1] for x in windows), plan


def test_lines_are_dealt_once(spark, sf):
    """One shuffle serves every window of the classification, and no branch reads the source again."""
    from tessera.sources import views as V

    log = V.lab_log(spark, sf)
    plan = L.classify(log, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(file") == 1 and plan.count("Window [") >= 1, plan
    samples, form, _ = L.extract(log, 5)
    for out in (samples, form):
        assert "lineitem.parquet" not in out._jdf.queryExecution().optimizedPlan().toString() and not set(out.inputFiles()) & set(log.inputFiles())


def test_unnamed_formulations_are_numbered_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET", 3)
    cells = [f"{i}% APG (S{i})" if i % 4 else f"{i} ppm SDS (" for i in range(1, 14)]
    lines = spark.createDataFrame([("f", i, c, "20X foam" if i % 5 == 0 else None) for i, c in enumerate(cells)], "file string, line_no long, c0 string, c1 string")
    _, form, _ = L.extract(lines, 2)
    got = {r.line_no: r.SampleID for r in form.collect()}
    assert got == {i: f"S{i + 1}" if (i + 1) % 4 else f"Sample_{i + 1}" for i in range(13)}


def test_written_files_hold_whole_logs(spark, tmp_path, monkeypatch):
    """Tasks write the files themselves, also where a log goes over several batches, and read_lines gives them back."""
    rows = [(None if i % 5 == 4 else i % 5, i, None if i == 7 else f"é {i},\"x\"") for i in range(400)]
    monkeypatch.setattr(type(spark.range(1).write), "text", None)  # Spark's writer makes no file
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        lines = spark.createDataFrame(rows, "file long, line_no long, value string").repartition("file").sortWithinPartitions("file", "line_no")
        R.write_lines(lines.select("file", "value"), f"file://{tmp_path}/logs one")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    names = sorted(p.relative_to(tmp_path / "logs one").as_posix() for p in (tmp_path / "logs one").rglob("*") if p.is_file())
    assert names == [f"file={x}/part-00000.txt" for x in (0, 1, 2, 3, "__HIVE_DEFAULT_PARTITION__")]
    got = {(r["file"].split("file=")[1].split("/")[0], r["line_no"]): r["text"] for r in R.read_lines(spark, f"{tmp_path}/logs one").collect()}
    want = {("__HIVE_DEFAULT_PARTITION__" if f is None else str(f), i // 5): v or "" for f, i, v in rows}
    assert got == want
