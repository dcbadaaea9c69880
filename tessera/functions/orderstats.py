"""Exact order statistics of many groups at once, with no value map and no sort of a group.

A state table holds one row for each (group, rank) still looked for: the closed
value interval that contains the rank, how many rows of the group lie below it
and how many inside. A round joins the rows with the state's intervals, cuts
each interval into cells with a monotone function of the value, and counts the
cells (rows, least and greatest value; combined before the shuffle, so a group
with a third of all rows is counted where it lies). Running sums over a group's
cells say which cell holds the rank; its least and greatest value are the next
interval. A rank is found

* when its interval has one value left (ties of any number), or
* when its interval has at most ``LIST_ROWS`` rows: those are sorted in one array.

Cells of the first round are steps of the logarithm of the value's magnitude, so
that one round brings any range of doubles down to values of one magnitude;
further rounds cut an interval evenly into ``CELLS``. After the first round 52
bits are left at most (63 for whole numbers), so there are six rounds at most,
and as a rule two. State and cells live in tables of the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import shared_table
from .core import col

#: Cells of an interval in the rounds after the first.
CELLS = 4096
#: Rows of an interval that are sorted in one array.
LIST_ROWS = 4096
#: Cells of the first round for each unit of the natural logarithm.
FINE = 64


def _magnitude(x: Column) -> Column:
    """Monotone cell number: zero in the middle, infinities and NaN (above all numbers) in cells of their own."""
    v = x.cast("double")
    far = 1 << 20
    step = F.floor(F.signum(v) * (F.ln(F.abs(v)) + 746) * FINE).cast("int")
    return (F.when(F.isnan(v), F.lit(far + 1)).when(v == float("inf"), F.lit(far)).when(v == float("-inf"), F.lit(-far))
            .when(v == 0, F.lit(0)).otherwise(step))


def _even(x: Column, lo: Column, hi: Column, whole: bool) -> Column:
    """Monotone cell number of ``x`` in ``[lo, hi]``, ``lo < hi``: the two ends never share a cell."""
    if whole:  # longs: differences in decimals are exact
        apart = lambda a, b: (a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")
    else:  # differences of halves do not overflow
        apart = lambda a, b: a / 2 - b / 2
    return F.least(F.floor(apart(x, lo) / apart(hi, lo) * CELLS), F.lit(CELLS - 1)).cast("int")


def _same(names: list[str], suffix: str) -> Column:
    """Equality of ``names`` with their namesakes of the other table, nulls alike."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(n + suffix)) for n in names], F.lit(True))


def _count(rows: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """Cells with their rows and ends; NaN is the greatest value."""
    return rows.groupBy(*keys, cell.alias("__cell")).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))


def _pick(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The cell of every wanted (rank, rows below its interval): the next state."""
    w = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    b = wanted.select(*[F.col(k).alias(f"{k}__w") for k in keys], "__rank", F.col("__below").alias("__base"), "__total")
    on = _same(keys, "__w")
    at = F.col("__rank") - F.col("__base")
    got = cells.join(b, on & (at >= F.col("__before")) & (at < F.col("__before") + F.col("__n")))
    return got.select(*[k for k in keys if k != "__at"], "__total", "__rank", (F.col("__base") + F.col("__before")).alias("__below"), "__n", "__lo", "__hi")


def order_statistics(rows: DataFrame, by: list[str], x, ranks: Callable[[Column], Column] | DataFrame) -> DataFrame:
    """``rows`` -> (by..., n, rank, value): the values at the zero-based ``ranks(n)`` of every group of ``by``.

    ``ranks`` maps a group's number of non-null values to an array of ranks, or
    is a table (by..., rank); ranks outside ``[0, n)`` are left out. ``x`` is a double or a whole number (returned as
    bigint). Null group keys are a group; NaN ranks above all
    numbers; groups without a value and empty tables give no rows. ``by`` may be
    empty: one group. ``rows`` is scanned once a round: cache it if it is dear.
    """
    names = [f"__g{i}" for i in range(len(by))]
    data = rows.select(*[col(b).alias(n) for b, n in zip(by, names)], col(x).alias("__x")).where(F.col("__x").isNotNull())
    whole = data.schema["__x"].dataType != DoubleType()
    if whole:
        data = data.withColumn("__x", F.col("__x").cast("bigint"))
    cells = shared_table(_count(data, names, _magnitude(F.col("__x"))), "cells")
    totals = cells.groupBy(*names).agg(F.sum("__n").alias("__total"))
    if isinstance(ranks, DataFrame):
        asked = ranks.select(*[col(b).alias(f"{n}__i") for b, n in zip(by, names)], F.col("rank").cast("bigint").alias("__rank"))
        wanted = totals.join(asked, _same(names, "__i")).select(*names, "__total", "__rank")
    else:
        wanted = totals.select(*names, "__total", F.explode(F.array_distinct(ranks(F.col("__total")).cast("array<bigint>"))).alias("__rank"))
    wanted = wanted.where("__rank >= 0 and __rank < __total").withColumn("__below", F.lit(0).cast("bigint"))
    state = shared_table(_pick(cells, wanted, names), "ranks")
    done = []
    single = F.col("__lo").eqNullSafe(F.col("__hi"))
    out = [*names, "__total", "__rank", "__value"]
    while True:
        done.append(state.where(single).withColumn("__value", F.col("__lo")).select(*out))
        state = state.where(~single)
        done.append(_listed(data, state.where(F.col("__n") <= LIST_ROWS), names).select(*out))
        state = state.where(F.col("__n") > LIST_ROWS)
        if state.isEmpty():
            break
        intervals = state.select(*[F.col(n).alias(f"{n}__i") for n in names], F.col("__lo").alias("__from"), F.col("__hi").alias("__to")).distinct()
        on = _same(names, "__i") & F.col("__x").between(F.col("__from"), F.col("__to"))
        inside = data.join(intervals, on).withColumn("__at", F.col("__from"))
        keys = [*names, "__at"]
        cells = shared_table(_count(inside, keys, _even(F.col("__x"), F.col("__from"), F.col("__to"), whole)), "cells")
        state = shared_table(_pick(cells, state.withColumn("__at", F.col("__lo")), keys), "ranks")
    found = reduce(DataFrame.unionByName, done)
    return found.select(*[F.col(n).alias(b if isinstance(b, str) else n) for n, b in zip(names, by)],
                        F.col("__total").alias("n"), F.col("__rank").alias("rank"), F.col("__value").alias("value"))


def _listed(data: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Ranks of intervals of at most ``LIST_ROWS`` rows, from the sorted rows of each interval."""
    intervals = state.select(*[F.col(n).alias(f"{n}__i") for n in names], F.col("__lo").alias("__from"), F.col("__hi").alias("__to")).distinct()
    on = _same(names, "__i") & F.col("__x").between(F.col("__from"), F.col("__to"))
    lists = data.join(intervals, on).groupBy(*names, "__from").agg(F.sort_array(F.collect_list("__x")).alias("__list"))
    lists = lists.select(*[F.col(n).alias(f"{n}__i") for n in names], F.col("__from"), "__list")
    on = _same(names, "__i") & F.col("__lo").eqNullSafe(F.col("__from"))
    return state.join(lists, on).withColumn("__value", F.col("__list")[(F.col("__rank") - F.col("__below")).cast("int")])


def group_quantiles(rows: DataFrame, by: list[str], x, probs: list[float]) -> DataFrame:
    """(by..., n, q: array<double>): quantiles of every group by linear interpolation between order statistics."""
    h = [lambda n, p=p: (n - 1).cast("double") * F.lit(float(p)) for p in probs]
    wanted = lambda n: F.flatten(F.array(*[F.array(F.floor(f(n)), F.ceil(f(n))) for f in h]))
    found = order_statistics(rows.withColumn("__v", col(x).cast("double")), by, "__v", wanted)
    one = found.groupBy(*[col(b) for b in by], "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__at"))

    def at(f):
        place = f(F.col("n"))
        a, b, share = F.col("__at")[F.floor(place)], F.col("__at")[F.ceil(place)], place - F.floor(place)
        return F.when((share == 0) | (a == b), a).otherwise((1 - share) * a + share * b)

    return one.select(*[col(b) for b in by], "n", F.array(*[at(f) for f in h]).alias("q"))
