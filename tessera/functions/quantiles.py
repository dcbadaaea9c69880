"""Exact quantiles (linear interpolation, as pandas/numpy) without value maps.

``percentile`` keeps a value → count map per column and merges those maps in
one task, which is unbounded for high-cardinality columns. Here each wanted
order statistic is found by narrowing a value interval that contains it:

1. one ``percentile_approx`` sketch a column, for all its ranks, gives two
   values ``lo <= hi`` a little below and above each rank; the first round
   counts the column's values in the same scan;
2. one count of the rows below, at and between them says which of the five
   regions holds the rank. At ``lo`` or ``hi`` the statistic is found;
   otherwise that region is the next interval. Every round leaves out at least
   the two values themselves, and as a rule all but some 6/ACCURACY of the rows;
3. intervals of at most ``LIST_ROWS`` rows are sorted in one array each, from a
   scan that first leaves out all rows outside them.

Up to some millions of rows that makes three scans whatever the columns and
ranks, beyond that two more for every round. The state of a rank is a sketch,
four counts or one array of bounded length, whatever the cardinality. Heavy
ties end the search in step 2.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import col

#: Rank error of the sketch: rows / ACCURACY.
ACCURACY = 10_000
#: Rows of an interval that are sorted in one array.
LIST_ROWS = 4096


def _inside(x, interval):
    lo, hi = interval
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x > F.lit(lo))
    return cond if hi is None else cond & (x < F.lit(hi))


def _around(at: float) -> list[float]:
    slack = 3 / ACCURACY
    return [max(0.0, at - slack), min(1.0, at + slack)]


def _sketch(x, interval, places: list[float]):
    """Two values around each relative place of the rows of an interval."""
    values = x if interval == (None, None) else F.when(_inside(x, interval), x)
    return F.percentile_approx(values, [p for at in places for p in _around(at)], ACCURACY)


def _settle(df: DataFrame, x: dict, cuts: dict) -> tuple[dict, dict]:
    """{(column, rank): (interval, rows below it, rows in it, lo, hi)} → (found values, next intervals), by one count."""
    asked = sorted({(c, iv, lo, hi) for (c, _), (iv, _, _, lo, hi) in cuts.items()}, key=str)
    counts = []
    for j, (c, (low, high), lo, hi) in enumerate(asked):
        floor = True if low is None else x[c] > F.lit(low)
        steps = (x[c] < F.lit(lo), x[c] <= F.lit(lo), x[c] < F.lit(hi), x[c] <= F.lit(hi))
        counts += [F.count_if(cond if floor is True else floor & cond).alias(f"k{j}_{i}") for i, cond in enumerate(steps)]
    got = df.agg(*counts).first()
    upto = {key: [got[f"k{j}_{i}"] for i in range(4)] for j, key in enumerate(asked)}
    found, rest = {}, {}
    for (c, r), ((low, high), below, n, lo, hi) in cuts.items():
        first, first_end, second, second_end = upto[c, (low, high), lo, hi]
        at = r - below
        if first <= at < first_end:
            found[c, r] = lo
        elif max(second, first_end) <= at < second_end:
            found[c, r] = hi
        elif at < first:
            rest[c, r] = ((low, lo), below, first)
        elif at < second:
            rest[c, r] = ((lo, hi), below + first_end, second - first_end)
        else:
            rest[c, r] = ((hi, high), below + second_end, n - second_end)
    return found, rest


def _narrow(df: DataFrame, x: dict, open_: dict) -> tuple[dict, dict]:
    """One further round for {(column, rank): (interval, rows below it, rows in it)}."""
    groups: dict = {}
    for (c, r), (iv, below, n) in open_.items():
        groups.setdefault((c, iv), []).append((r, (r - below) / max(n - 1, 1)))
    cut = df.agg(*[_sketch(x[c], iv, [at for _, at in ranks]).alias(f"a{j}") for j, ((c, iv), ranks) in enumerate(groups.items())]).first()
    cuts = {}
    for j, ((c, _), ranks) in enumerate(groups.items()):
        for i, (r, _) in enumerate(ranks):
            cuts[c, r] = (*open_[c, r], *cut[f"a{j}"][2 * i:2 * i + 2])
    return _settle(df, x, cuts)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """{column: [quantile(p) for p in probs]} (NULLs ignored; NULL if no value; NaN above all numbers)."""
    if not columns:
        return {}
    x = {c: col(c).cast("double") for c in columns}
    whole = (None, None)
    one = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[_sketch(x[c], whole, probs).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    n = {c: one[f"n{i}"] for i, c in enumerate(columns)}
    at = {c: [(n[c] - 1) * p for p in probs] for c in columns if n[c]}
    left, first = {}, {}
    for i, c in enumerate(columns):
        for j, h in enumerate(at.get(c, [])):
            for r in (math.floor(h), min(math.ceil(h), n[c] - 1)):
                if n[c] <= LIST_ROWS:
                    left[c, r] = (whole, 0, n[c])
                else:
                    first[c, r] = (whole, 0, n[c], *one[f"a{i}"][2 * j:2 * j + 2])
    values: dict = {}
    if first:
        values, rest = _settle(df, x, first)
        left |= rest
    while big := {key: s for key, s in left.items() if s[2] > LIST_ROWS}:
        found, rest = _narrow(df, x, big)
        values |= found
        left = {key: s for key, s in left.items() if s[2] <= LIST_ROWS} | rest
    if left:
        asked = list({(c, iv) for (c, _), (iv, _, _) in left.items()})
        inside = [_inside(x[c], iv) for c, iv in asked]
        lists = df.where(reduce(lambda a, b: a | b, inside)).agg(
            *[F.sort_array(F.collect_list(F.when(cond, x[c]))).alias(f"v{j}") for j, ((c, _), cond) in enumerate(zip(asked, inside))]).first()
        values |= {(c, r): lists[f"v{asked.index((c, iv))}"][r - below] for (c, r), (iv, below, _) in left.items()}
    res: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for c, hs in at.items():
        for i, h in enumerate(hs):
            a, b = values[(c, math.floor(h))], values[(c, min(math.ceil(h), n[c] - 1))]
            f = h - math.floor(h)
            res[c][i] = a if f == 0 or a == b else (1 - f) * a + f * b
    return res


def quantile_values(df: DataFrame, columns: list[str], probs: list[float], mode: str | bool = "exact") -> dict:
    """{column: [q(p)…]}: ``exact`` (default, by narrowing: bounded memory at
    any cardinality) or ``approx``/True (one sketch, rank error ≤ n/10⁴)."""
    if not columns:
        return {}
    if mode not in ("approx", True):
        return exact_quantiles(df, columns, probs)
    r = df.agg(*[F.percentile_approx(col(c).cast("double"), probs, ACCURACY).cast("array<double>").alias(f"q{i}")
                 for i, c in enumerate(columns)]).first()
    return {c: (list(r[f"q{i}"]) if r[f"q{i}"] is not None else [None] * len(probs)) for i, c in enumerate(columns)}
