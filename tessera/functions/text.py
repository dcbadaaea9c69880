"""String scalars (X1–X18) as Column expressions.

All are built-in regex / string functions, so they stay inside whole-stage
codegen. Java's ``\\s`` does not match NBSP, so NBSP is named explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, nan_to_null

# Character classes of the label and observation cleaners.
NBSP = "\u00a0"
WS = "[\\s\\u00a0]"
LABEL_JUNK = "[^a-z0-9 ]+"
OBSERVATION_SEPARATORS = "[._\\-\\s\\u00a0]+"
NON_NUMBER = "[^0-9.]"


def blank_to_null(c) -> Column:
    c = col(c)
    return F.when(c != "", c)


def clean_label(c) -> Column:
    """Lower, NBSP→space, non [a-z0-9 ] → space, collapse, trim; '' / 'nan' → NULL."""
    s = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), NBSP, " ")
    s = F.regexp_replace(s, LABEL_JUNK, " ")
    s = F.trim(F.regexp_replace(s, "\\s+", " "))
    return F.when((s != "") & (s != "nan"), s)


def to_volume(c) -> Column:
    """Drop NBSP, trim, blank → NULL, then safe numeric."""
    s = F.trim(F.regexp_replace(col(c).cast("string"), NBSP, ""))
    return nan_to_null(F.when(s != "", s).try_cast("double"))


def to_number(c) -> Column:
    """Pandas-style ``to_numeric(errors='coerce')``: bad text and NaN → NULL."""
    return nan_to_null(F.trim(col(c).cast("string")).try_cast("double"))


def digits_only_number(c) -> Column:
    """Strip everything but digits and '.', then number (so '-5' → 5)."""
    s = F.regexp_replace(col(c).cast("string"), NON_NUMBER, "")
    return nan_to_null(F.when(s != "", s).try_cast("double"))


# How a header names a time.
NUMBER = r"(\d+\.?\d*)"
NUMBER_AND_UNIT = NUMBER + r"\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes)\b"
TIME_WORD = r"\btime\b|\bt\s*="
TIME_HEADER = r"\btime\b|^\s*\d+\.?\d*\s*(h|m|hr|mins|minutes|min)\b"


def minutes_from_header(c) -> Column:
    """X5 as a Column: number + h/m unit → minutes (hours × 60); else the
    first number when the text reads as time ('time' word or 't='); else NULL."""
    s = F.lower(F.trim(col(c)))
    has_unit = s.rlike(NUMBER_AND_UNIT)
    val = F.regexp_extract(s, NUMBER_AND_UNIT, 1).cast("double")
    u = F.regexp_extract(s, NUMBER_AND_UNIT, 2)
    bare = F.regexp_extract(s, NUMBER, 1)
    return (F.when(has_unit, val * F.when(u.startswith("h"), 60.0).otherwise(1.0))
            .when(s.rlike(TIME_WORD) & (bare != ""), bare.cast("double")))


def normalise_observation(c) -> Column:
    """Runs of . _ - and spaces → one space, trim, lower; blank / 'nan' → NULL."""
    s = F.lower(F.trim(F.regexp_replace(col(c).cast("string"), OBSERVATION_SEPARATORS, " ")))
    return F.when((s != "") & (s != "nan"), s)


# Instability words (stem 'precip', 'gel', 'unstable') unless preceded by 'no '.
INSTABILITY_PATTERN = "(?i)(?<!no\\s)\\b(?:precip\\w*|gel|unstable)\\b"


def is_unstable(c) -> Column:
    """Observation text reports instability."""
    return col(c).rlike(INSTABILITY_PATTERN)


def pilot_tag(c) -> Column:
    """X12: 'AFC' when the text contains AFC in any case."""
    return F.when(F.upper(col(c)).contains("AFC"), F.lit("AFC"))


def slug(c, width: int = 40) -> Column:
    """X16 (feature names): lower, runs of [^a-z0-9] → '_', cut to ``width``,
    then '_' stripped from both ends."""
    s = F.regexp_replace(F.lower(col(c).cast("string")), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(s, 1, width), "^_+|_+$", "")


def slug_words(c, width: int = 60) -> Column:
    """X16 (file names): trim, drop characters other than word characters,
    whitespace and '-', whitespace runs → '_', cut to ``width``."""
    s = F.regexp_replace(F.trim(col(c).cast("string")), "(?U)[^\\w\\s\\-]", "")
    return F.substring(F.regexp_replace(s, "(?U)\\s+", "_"), 1, width)


def strip_stars(c) -> Column:
    """Remove '*' from a text cell."""
    return F.regexp_replace(col(c), "\\*", "")


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))
