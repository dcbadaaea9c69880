"""Reproducible splits and folds.

Randomness is a hash of (seed, row key, tag) — independent of partitioning,
so a split is the same on a laptop and on a cluster and survives recomputation
after an executor loss. Exact sizes (stratified splits and folds, and the
``exact`` forms of the plain ones) come from order statistics of a 60-bit hash:
how many rows each class gives to each part is arithmetic on the class counts,
the hash at that rank is the cut, found for all classes at once by
``order_statistics``, and rows compare their own hash with the cuts of their
class. No class is ranked in a window or sorted in one task. Rows that share a
key share a hash and stay together.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, hash_u
from ..functions.orderstats import order_statistics

LOO_LIMIT = 500  # fixed value: leave-one-out is refused above this many rows


def row_key(*cols: str) -> Column:
    """A row key from several columns when no single column is unique."""
    return F.concat_ws("|", *[col(c).cast("string") for c in cols])


def hash_rank(key, seed: int, tag: str) -> Column:
    """60 bits of md5(seed|key|tag) as a whole number: the order in which rows are dealt to parts."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string"), F.lit(tag)))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def train_test(df: DataFrame, key, test_size: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """``is_test`` = hash-uniform(key) < test_size; with ``exact``, the
    ceil(n · test_size) rows of lowest hash rank."""
    if not exact:
        return df.withColumn("is_test", hash_u(key, seed, "split") < F.lit(test_size))
    n = df.count()
    return _part(df, key, None, [(None, [math.ceil(n * test_size - 1e-9)])], seed, "split").withColumn("is_test", F.col("__part") == 0).drop("__part")


def _class_counts(df: DataFrame, label) -> list[tuple]:
    """(class, rows) in class order, null first: one row for each class."""
    rows = df.groupBy(col(label).alias("c")).agg(F.count("*").alias("n")).orderBy("c").collect()
    return [(r["c"], r["n"]) for r in rows]


def _part(df: DataFrame, key, label: str | None, sizes: list[tuple], seed: int, tag: str) -> DataFrame:
    """``__part``: which part of its class a row falls into, the parts taking the given numbers of rows in hash order.

    ``sizes`` lists (class, [rows of part 0, of part 1, ...]); what is left is one more part.
    """
    ranked = df.withColumn("__u", hash_rank(key, seed, tag))
    kind = "string" if label is None else df.select(col(label)).schema[0].dataType.simpleString()
    cls = F.lit(None).cast(kind) if label is None else col(label)
    ends = [(c, i, e - 1) for c, parts in sizes for i, e in enumerate(accumulate(parts))]
    ends = df.sparkSession.createDataFrame(ends, f"__cls {kind}, __part int, rank bigint")
    found = order_statistics(ranked.select(cls.alias("__cls"), "__u"), ["__cls"], "__u", ends.select("__cls", "rank").distinct())
    found = found.select(F.col("__cls").alias("__k"), F.col("rank").alias("__r"), "value")
    cuts = ends.join(found, F.col("__cls").eqNullSafe(F.col("__k")) & (F.col("rank") == F.col("__r")), "left")
    cuts = cuts.groupBy("__cls").agg(F.sort_array(F.collect_list(F.struct("__part", F.coalesce("value", F.lit(-1)).alias("u")))).alias("__cuts"))
    cuts = cuts.select("__cls", F.col("__cuts.u").alias("__cuts"))  # one row for each class
    out = ranked.join(F.broadcast(cuts), cls.eqNullSafe(F.col("__cls")), "left")
    part = F.size(F.filter("__cuts", lambda c: c < F.col("__u")))
    return out.withColumn("__part", part.cast("int")).drop("__u", "__cls", "__cuts")


def stratified_train_test(df: DataFrame, key, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """T9 stratified, to the row: the test set has ceil(n · test_size) rows.

    Each class keeps the whole part of its share of the training rows; the rows
    still missing go to the classes with the largest remainders (equal ones in
    class order). Inside a class, the rows of lowest hash rank are the test set.
    """
    counts = _class_counts(df, label)
    n = sum(k for _, k in counts)
    train = n - math.ceil(n * test_size - 1e-9)
    share = [Fraction(k * train, n) for _, k in counts]
    keep = [math.floor(x) for x in share]
    order = sorted(range(len(counts)), key=lambda i: (keep[i] - share[i], i))
    for i in order[:train - sum(keep)]:
        keep[i] += 1
    sizes = [(c, [k - t]) for (c, k), t in zip(counts, keep)]
    return _part(df, key, label, sizes, seed, "split").withColumn("is_test", F.col("__part") == 0).drop("__part")


def kfold(df: DataFrame, key, k: int = 5, seed: int = 42, exact: bool = False) -> DataFrame:
    """``fold`` = floor(hash-uniform(key) · k); with ``exact``, runs of
    hash rank whose sizes differ by one at most (the first n mod k are larger)."""
    if not exact:
        return df.withColumn("fold", F.floor(hash_u(key, seed, "fold") * k).cast("int"))
    n = df.count()
    return _part(df, key, None, [(None, [n // k + (i < n % k) for i in range(k - 1)])], seed, "fold").withColumnRenamed("__part", "fold")


def stratified_kfold(df: DataFrame, key, label: str, k: int = 5, seed: int = 42, task: str = "classification") -> DataFrame:
    """Folds balanced within each class, to the row (classification only).

    With the rows sorted by class, fold i takes the places i, i + k, i + 2k, ...:
    that fixes how many rows of each class it gets, so that classes and folds
    are both balanced to one row. Inside a class, folds follow the hash rank.
    """
    if task != "classification":
        raise ValueError("balanced folds need classes; the task is not a classification")
    sizes, at = [], 0
    upto = lambda end, i: (end - i + k - 1) // k  # noqa: E731  (places i, i + k, ... below end)
    for c, n in _class_counts(df, label):
        sizes.append((c, [upto(at + n, i) - upto(at, i) for i in range(k - 1)]))
        at += n
    return _part(df, key, label, sizes, seed, "fold").withColumnRenamed("__part", "fold")


def leave_one_out(df: DataFrame, key: str, n_rows: int | None = None) -> DataFrame:
    """One fold per row; refused above LOO_LIMIT rows (use K-fold)."""
    n = n_rows if n_rows is not None else df.count()
    if n > LOO_LIMIT:
        raise ValueError(f"leave-one-out on {n} rows would fit {n} models; use K-fold")
    return df.withColumn("fold", col(key))


def row_folds(df: DataFrame, key: str) -> DataFrame:
    """T12 as fold assignment alone, at any size: the fold of a row is its key."""
    return df.withColumn("fold", col(key))


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """One fold per group value."""
    return df.withColumn("fold", col(group))


def loo_linear(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """T12 for ordinary least squares at any size: the leave-one-out residual
    of row i is e_i / (1 − h_ii) with h_ii = x̃_iᵀ (X̃ᵀX̃)⁻¹ x̃_i (x̃ = [1, x]).
    One aggregate gives X̃ᵀX̃ and X̃ᵀy (k+1 numbers squared — bounded by the
    feature count), the driver inverts it, and one projection scores every
    row: no n model fits, no data on the driver."""
    cols = [F.lit(1.0)] + [col(c).cast("double") for c in features]
    y = col(label).cast("double")
    k = len(cols)
    complete = col(label).isNotNull()
    for c in features:
        complete = complete & col(c).isNotNull()
    ok = df.where(complete)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(cols[i] * y).alias(f"b{i}") for i in range(k)]
    r = ok.agg(*aggs).first()
    G = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            G[i, j] = G[j, i] = r[f"g{i}_{j}"]
    b = np.array([r[f"b{i}"] for i in range(k)])
    Ginv = np.linalg.pinv(G)
    beta = Ginv @ b
    pred = sum((F.lit(float(beta[i])) * cols[i] for i in range(k)), F.lit(0.0))
    h = sum((F.lit(float(Ginv[i, j])) * cols[i] * cols[j] for i in range(k) for j in range(k)), F.lit(0.0))
    e = y - pred
    return ok.withColumns({"prediction": pred, "leverage": h, "loo_residual": e / (F.lit(1.0) - h)})


def logo_linear(df: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    """T13 with ordinary least squares: every row predicted by the model
    fitted on all other groups (columns prediction and residual are added;
    rows with a NULL feature or label are left out).

    Sums of products per group and over all groups give each left-out system
    as their difference, so one aggregate of (k+1)² sums per group replaces a
    fit per group; groups are solved in Arrow batches wherever they lie."""
    cols = [F.lit(1.0)] + [col(c).cast("double") for c in features]
    y, k = col(label).cast("double"), len(features) + 1
    complete = col(label).isNotNull()
    for c in features:
        complete = complete & col(c).isNotNull()
    ok = df.where(complete)
    means = ok.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    z = [cols[0]] + [cols[i] - F.lit(means[f"m{i}"]) for i in range(1, k)]  # centred sums lose fewer digits
    sums = [F.sum(a * b) for a in z for b in [*z, y]]
    total = ok.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    whole = np.array([total[f"s{i}"] or 0.0 for i in range(len(sums))]).reshape(k, k + 1)

    @F.pandas_udf("array<double>")
    def solve(own: pd.Series) -> pd.Series:
        rest = [whole - np.asarray(o, float).reshape(k, k + 1) for o in own]
        return pd.Series([np.linalg.pinv(m[:, :k]) @ m[:, k] for m in rest])

    beta = ok.groupBy(col(group).alias("__g")).agg(F.array(*sums).alias("__own")).select("__g", solve("__own").alias("__b"))
    out = ok.join(beta, col(group).eqNullSafe(F.col("__g"))).drop("__g")
    pred = sum((F.col("__b")[i] * z[i] for i in range(k)), F.lit(0.0))
    return out.withColumn("prediction", pred).withColumn("residual", y - F.col("prediction")).drop("__b")
