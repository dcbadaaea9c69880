"""Filters, projections and name resolution.

Filters are folded into ONE predicate so Catalyst pushes what it can into the
parquet scan (``PushedFilters``); rule limits are read from the unfiltered
table in a single aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, num


@dataclass
class Rule:
    """A filter rule: numeric range [lo, hi] or a category list."""
    column: str
    lo: float | None = None
    hi: float | None = None
    values: Sequence | None = None


def range_predicate(column: str, lo: float, hi: float, numeric: bool = False) -> Column:
    """inclusive numeric range; NULL (and NaN) never pass. A numeric
    column is compared as it is, so the predicate reaches the parquet scan;
    text is coerced first (bad text → NULL)."""
    x = F.col("`" + column + "`") if numeric else num(column)
    return x.between(F.lit(lo), F.lit(hi))


def _is_num(df: DataFrame, column: str) -> bool:
    from ..functions.core import is_numeric
    return is_numeric(df.schema[column].dataType)


def range_filter(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """no-op when lo ≥ hi (a degenerate slider)."""
    return df if lo >= hi else df.where(range_predicate(column, lo, hi, _is_num(df, column)))


def category_filter(df: DataFrame, column: str, picks: Sequence, n_distinct: int | None = None) -> DataFrame:
    """keep rows whose value is one of ``picks``; NULL never passes;
    no-op when the column has at most one distinct value."""
    if n_distinct is None:
        n_distinct = df.agg(F.count_distinct(column)).first()[0]
    if n_distinct <= 1:
        return df
    return df.where(col(column).isin(list(picks)))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """AND of the rules. Range rules without limits take the full range of
    the unfiltered table (which still drops NULLs); a range with lo ≥ hi and
    a category column with ≤1 distinct value are no-ops. One aggregate
    fetches every limit needed."""
    need = [r for r in rules if r.values is None]
    cats = [r for r in rules if r.values is not None]
    aggs = []
    for i, r in enumerate(need):
        aggs += [F.min(num(r.column)).alias(f"lo{i}"), F.max(num(r.column)).alias(f"hi{i}")]
    for i, r in enumerate(cats):
        aggs.append(F.count_distinct(r.column).alias(f"k{i}"))
    lim = df.agg(*aggs).first() if aggs else None
    pred = F.lit(True)
    for i, r in enumerate(need):
        lo = r.lo if r.lo is not None else lim[f"lo{i}"]
        hi = r.hi if r.hi is not None else lim[f"hi{i}"]
        if lo is None or hi is None:
            pred = pred & F.lit(False)
        elif lo < hi:
            pred = pred & range_predicate(r.column, lo, hi, _is_num(df, r.column))
    for i, r in enumerate(cats):
        if lim[f"k{i}"] > 1:
            pred = pred & col(r.column).isin(list(r.values))
    return df.where(pred)


def find_columns(columns: list[str], keywords: list[str]) -> list[str]:
    """case-insensitive substring search; keyword order first, then column order."""
    out = []
    for k in keywords:
        for c in columns:
            if k.lower() in c.lower() and c not in out:
                out.append(c)
    return out


def normalise_name(name: str) -> str:
    """trim, lower, drop a trailing ' (%)'."""
    s = name.strip().lower()
    return re.sub(r"\s*\(%\)$", "", s).strip()


def resolve_column(columns: list[str], wanted: str) -> str | None:
    """exact match first, then normalised (the last column wins the lookup)."""
    if wanted in columns:
        return wanted
    lookup = {}
    for c in columns:
        lookup[normalise_name(c)] = c
    return lookup.get(normalise_name(wanted))


def project(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """ordered, de-duplicated projection of features (+ target)."""
    cols = list(dict.fromkeys(list(features) + ([target] if target else [])))
    return df.select(*cols)


def task_hint(df: DataFrame, target: str) -> DataFrame:
    """F8: numeric target with more than 5 distinct values → regression."""
    from ..functions.core import is_numeric
    isnum = is_numeric(df.schema[target].dataType)
    k = F.count_distinct(target)
    return df.agg(k.alias("n_distinct")).select(
        "n_distinct", F.when(F.lit(isnum) & (F.col("n_distinct") > 5), "regression")
        .otherwise("classification").alias("task"))


def constraint_predicate(bounds: dict[str, tuple[float, float]], columns_present: list[str],
                         sum_columns: list[str] | None = None, total: float | None = None,
                         tol: float = 0.5) -> Column:
    """each column within [lo, hi] and |Σ cols − total| ≤ tol. Missing
    columns are ignored; NULL counts as 0 in the sum (and fails a bound)."""
    pred = F.lit(True)
    for c, (lo, hi) in bounds.items():
        if c in columns_present:
            pred = pred & col(c).between(lo, hi)
    if sum_columns and total is not None:
        present = [c for c in sum_columns if c in columns_present]
        s = sum((F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in present), F.lit(0.0))
        pred = pred & (F.abs(s - F.lit(total)) <= tol)
    return pred


def apply_constraints(df: DataFrame, bounds: dict, sum_columns=None, total=None, tol: float = 0.5) -> DataFrame:
    return df.where(constraint_predicate(bounds, df.columns, sum_columns, total, tol))


def key_search(df: DataFrame, column: str, query: str, mode: str = "exact") -> DataFrame:
    """exact (case-insensitive) or literal 'contains' (case-insensitive);
    ``mode='regex'`` keeps the pattern semantics."""
    c = F.lower(col(column).cast("string"))
    if mode == "exact":
        return df.where(c == query.lower())
    if mode == "regex":
        return df.where(col(column).rlike("(?i)" + query))
    return df.where(c.contains(query.lower()))


def reaches_half(y: str = "y") -> Column:
    """some later value strictly inside (0.35·y0, 0.65·y0); y0 NULL or 0 fails."""
    return F.expr(f"""coalesce({y}[0] is not null and {y}[0] != 0 and
        exists(slice({y}, 2, greatest(size({y}) - 1, 1)),
               v -> v > 0.35 * {y}[0] and v < 0.65 * {y}[0]), false)""")


def drop_empty_columns(df: DataFrame, constant_too: bool = False) -> DataFrame:
    """drop columns without any non-NULL value (K2); with
    ``constant_too`` also those with a single distinct value."""
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    if constant_too:
        aggs += [F.approx_count_distinct(col(c)).alias(f"k{i}") for i, c in enumerate(df.columns)]
    r = df.agg(*aggs).first()
    drop = [c for i, c in enumerate(df.columns)
            if r[f"n{i}"] == 0 or (constant_too and r[f"k{i}"] <= 1)]
    return df.drop(*drop)
