"""Removal of repeated runs of lines by winnowing over line hashes (DataFrame functions only).

The lines of a text that are not blank are hashed. In every window of
``window`` consecutive lines the least hash (the last one of equals) is the
window's fingerprint, so a run of at least ``window`` lines that occurs twice
has the same fingerprint, at the same line, in both places. Fingerprints of one
position only are dropped; around the others the match is extended both ways to
the lines of the window, and the first place of each such run of lines, in the
order of (document, line), is found by a pre-aggregated minimum. A line goes if
it lies in a run of at least ``window`` lines that starts at an earlier place as
well; longer repeated runs go whole because their windows overlap. A line of at
least ``long_words`` words is a passage, and a run, of its own. With ``pairs``
two consecutive lines that have ``long_words`` words together are one as well.

Hot lines cost one aggregated row a task; no pair of places is ever formed, only
each place and the first one of its run.

Defined cases: a null text stays null; texts with fewer lines than ``window``
lose passages only; lines are compared without white space at their ends; rows
with equal key and text are one place and are treated alike; null keys sort
first. Other columns pass through; names that clash with working columns do not
matter, because those are kept in a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as c

BLANK = c.SPACE.decode()


def trimmed(line):
    return F.btrim(line, F.lit(BLANK))


def windows(docs: DataFrame, key: str, text: str, window: int, long_words: int, pairs: bool) -> DataFrame:
    """(key, digest, start, lines, first_no, last_no, fingerprint): every window, every long line and, with ``pairs``, every two lines as long.

    ``start`` counts lines that are not blank; ``lines`` are their hashes, the nos places in the text.
    """
    lines = F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.struct(trimmed(x).alias("line"), i.alias("no")))
    hashed = F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(
        F.xxhash64(x["line"]).alias("hash"), x["no"].alias("no"), F.size(F.split(x["line"], "[\\x20\\x09-\\x0D]+")).alias("words")))
    frame = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), hashed.alias("hashed"))

    def run(i, parts):
        return F.struct(i.alias("start"), F.array(*[x["hash"] for x in parts]).alias("lines"), parts[0]["no"].alias("first_no"), parts[-1]["no"].alias("last_no"))

    # the array shifted against itself: element i of the result is the window that starts at line i
    def runs(size, enough):
        shifts = [F.slice(F.col("hashed"), j + 1, F.greatest(F.size("hashed") - size + 1, F.lit(0))) for j in range(size)]
        parts = lambda w: [w[f"l{j}"] for j in range(size)]
        every = F.transform(F.arrays_zip(*[x.alias(f"l{j}") for j, x in enumerate(shifts)]), lambda w, i: F.when(enough(parts(w)), run(i, parts(w))))
        return F.filter(every, lambda x: x.isNotNull())

    whole = lambda parts: F.lit(True)
    passage = lambda parts: sum((x["words"] for x in parts[1:]), parts[0]["words"]) >= long_words
    cut = frame.select("key", "digest", F.explode(F.concat(runs(window, whole), *[runs(size, passage) for size in ((1, 2) if pairs else (1,))])).alias("w"))
    return cut.select("key", "digest", "w.*").withColumn("fingerprint", F.array_min("lines"))


def later_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3, long_words: int = 50, pairs: bool = False) -> DataFrame:
    """(key, digest, runs, n_removed): by document, maximal runs (places of their first and last line) that repeat earlier ones."""
    every = c.save(windows(docs, key, text, window, long_words, pairs), "windows")
    # positions of fingerprints: the last least hash of each window
    position = F.col("start") + F.size("lines") - F.array_position(F.reverse("lines"), F.col("fingerprint"))
    places = every.select("fingerprint", F.struct("key", "digest", position.alias("at")).alias("place"))
    joined = places.groupBy("fingerprint").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("not (first <=> last)").select("fingerprint")
    # extended both ways to the window, the first place of each run of lines
    matched = every.join(joined, "fingerprint")
    place = F.struct("key", "digest", "start")
    first = matched.groupBy("lines").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not (first <=> last)").select("lines", "first")
    later = matched.join(first, "lines").where(~place.eqNullSafe(F.col("first"))).select(
        "key", "digest", "start", (F.col("start") + F.size("lines")).alias("stop"), "first_no", "last_no").distinct()
    # windows that overlap or touch are one run
    order = W.partitionBy("key", "digest").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > before, F.lit(True))
    runs = later.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "digest", "run").agg(F.min("first_no").alias("a"), F.max("last_no").alias("b"), (F.max("stop") - F.min("start")).alias("n"))
    return runs.groupBy("key", "digest").agg(F.collect_list(F.struct("a", "b")).alias("runs"), F.sum("n").cast("bigint").alias("n_removed"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3, long_words: int = 50, pairs: bool = False) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, and text (what stays), n_lines, n_removed."""
    runs = c.save(later_runs(docs, key, text, window, long_words, pairs), "line-runs").select(F.col("key").alias("k"), F.col("digest").alias("d"), "runs", "n_removed")
    col = F.col(f"row.`{text}`")
    frame = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    frame = frame.withColumns({"d0": F.xxhash64(col), "k0": F.col(f"row.`{key}`")})
    # a merge join at every size: ``runs`` grows with the input and must not become a broadcast on small ones
    joined = frame.join(runs.hint("merge"), F.col("k0").eqNullSafe(F.col("k")) & (F.col("d0") == F.col("d")), "left")
    gone = lambda x, i: (trimmed(x) != "") & F.exists("runs", lambda r: (i >= r["a"]) & (i <= r["b"]))
    stays = F.array_join(F.filter(F.split(col, "\n"), lambda x, i: ~gone(x, i)), "\n")
    return joined.select("row", F.when(F.col("runs").isNull(), col).otherwise(stays).alias("text"),
                         F.coalesce(F.size(F.filter(F.split(col, "\n"), lambda x: trimmed(x) != "")), F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"))
