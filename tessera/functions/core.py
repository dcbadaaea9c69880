"""Null-safe numeric building blocks shared by every operator.

Rules they encode:
* one missing value: NaN is mapped to NULL on entry (``num``);
* ANSI mode stays on: no expression here can raise on bad input
  (``try_cast``, ``try_divide``, guarded correlation);
* reproducible randomness from a hash of (seed, key, tag), independent of
  partitioning, so splits and samples are stable across cluster layouts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType, DataType, StringType


def col(c) -> Column:
    """A column by plain name (names may hold dots or parentheses, as
    spreadsheet headers do); Columns pass through."""
    if isinstance(c, str):
        return F.col(c if c.startswith("`") else "`" + c.replace("`", "``") + "`")
    return c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def num(c) -> Column:
    """Safe numeric coercion: text or number -> double, bad text/NaN -> NULL."""
    c = col(c)
    return nan_to_null(c.try_cast("double"))


def safe_div(a, b) -> Column:
    """a / b with a zero or NULL denominator giving NULL (never raises)."""
    return F.try_divide(col(a), col(b))


def both(x, y):
    """(x, y) restricted to rows where both are non-null (pairwise-complete)."""
    x, y = col(x), col(y)
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def safe_corr(x, y) -> Column:
    """Pearson r over pairwise-complete rows; NULL when a side is constant.

    ``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI, so the
    ratio is written out with a guarded denominator.
    """
    xx, yy = both(x, y)
    return safe_div(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def hash_u(key, seed: int = 42, tag: str = "") -> Column:
    """Uniform [0,1) from md5(seed|key|tag): same value wherever the row lives."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string"), F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sum_cols(cols, null_as_zero: bool = True) -> Column:
    cs = [F.coalesce(num(c), F.lit(0.0)) if null_as_zero else num(c) for c in cols]
    return reduce(lambda a, b: a + b, cs) if cs else F.lit(0.0)


def is_numeric(dt: DataType) -> bool:
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def numeric_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def q(name: str) -> str:
    """Backtick-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"
