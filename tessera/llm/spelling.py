"""Spelling variants of the words of a corpus, found with PartEnum signatures.

A word is seen as the set of its numbered letters (``a0``, ``a1`` for a first
and a second ``a``). One inserted or deleted letter changes that set in one
element, a replaced one in two, so words at one edit have a Hamming distance of
at most two. PartEnum deals the numbered letters to ``n1`` groups of ``n2``
parts each. Of two differences, some group holds at most ``2 // n1``; leaving
out that many parts of it, in every possible way, gives signatures of which two
near words share one for certain. Signatures are equi-joined and the pairs
verified inside the join, so that only near words leave it.

Two facts about one edit go into the join key beside the signature, which keeps
the buckets small where many words are made of the same letters: lengths differ
by at most one, and either the first or the second half of both words is equal.

Everything is DataFrame functions; groups are counted before they are shuffled,
and no bucket of words is gathered.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Letters of a word (fixed values).
LETTERS = "[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, every: int = 199) -> DataFrame:
    """``docs`` (doc_id, text) -> (word, n) of the words with ``least_length`` code points and ``least_n`` occurrences.

    A run of letters loses one letter where ``every`` divides the checksum of
    ``doc_id:run``. Null and empty texts have no words; where doc_id is null
    nothing is deleted. Repeated rows count each; other columns are not read.
    """
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS + "{%d,}" % least_length), F.lit(0))).alias("run"))
    run = run.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    run = run.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")))
    cut = F.overlay("run", F.lit(""), (F.col("h") % F.length("run") + 1).cast("int"), F.lit(1))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return run.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_n))


def signatures(word: Column, n1: int = 1, n2: int = 4, distance: int = 2) -> Column:
    """PartEnum signatures of a word's numbered letters: sets within ``distance`` share one at least."""
    letters = F.array_sort(F.split(word, ""))
    numbered = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string")))
    part = F.transform(F.sequence(F.lit(0), F.lit(n1 * n2 - 1)), lambda p: F.array_join(F.filter(numbered, lambda x: F.pmod(F.xxhash64(x), F.lit(n1 * n2)) == p), ""))
    left_out = -(-(distance + 1) // n1) - 1
    chosen = [(g, s) for g in range(n1) for s in combinations(range(n2), n2 - left_out)]
    return F.transform(F.array(part), lambda parts: F.array(*[F.xxhash64(F.lit(i), *[parts[g * n2 + j] for j in s]) for i, (g, s) in enumerate(chosen)]))[0]


def near_pairs(words: DataFrame, n1: int = 1, n2: int = 4) -> DataFrame:
    """``words`` (word, n), distinct words -> each pair (a, an, b, bn), ``a < b``, at exactly one edit."""
    w = words.select("word", "n", signatures(F.col("word"), n1, n2).alias("signatures"), F.length("word").alias("size"))
    w = w.select("*", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("longest"))
    head = ((F.col("longest") - 1) / 2).cast("int")
    halves = F.array(F.concat(F.lit("<"), F.left("word", head)), F.concat(F.lit(">"), F.right("word", F.col("longest") - 1 - head)))
    w = w.select("word", "n", "longest", "signatures", F.explode(halves).alias("half"))
    w = w.select("word", "n", "longest", F.explode(F.transform("signatures", lambda s: F.xxhash64(s, "longest", "half"))).alias("key"))
    a, b = w.toDF("a", "an", "longest", "key"), w.toDF("b", "bn", "longest", "key")
    fits = F.greatest(F.length(a.a), F.length(b.b)) == a.longest
    found = a.join(b.hint("merge"), [a.key == b.key, a.a < b.b, fits, F.levenshtein(a.a, b.b, 1) == 1])
    return found.select("a", "an", "b", "bn").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``links`` (word, form), a forest -> (word, root), by doubling the steps until none goes further."""
    step = c.save(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = c.save(step.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def group_variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """Words of ``docs`` with the much more frequent near word each is a variant of.

    Returns word, form (the near word of largest n, of equal ones the smallest in
    code-point order, where its n is at least ``ratio`` times the word's; else
    null), root (the end of the chain of forms, the word itself without one), n,
    n_near (words at one edit) and form_n. An empty table, or one without words,
    gives no rows. Along a chain n grows by ``ratio`` each step, so chains are
    short and have no cycles.
    """
    words = c.save(count_words(docs, least_length, least_n, every), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).union(pairs.select("b", "a", "an"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))
    follows = F.col("near_n") >= ratio * F.col("n")
    out = c.save(out.select("word", "n", "n_near", F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("near_n")).alias("form_n")), "variants")
    out = out.join(roots(out.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
