"""Per-sample decay fits and half-life (H1–H8).

A sample's series is its row's time columns (wide input) or its group in a
long table; either way it becomes ``pts: array<struct<t,y>>`` sorted by t, of
bounded length (the number of time columns), and everything after is a
projection: fits from ``curves``, half-life in closed form.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..functions.text import NUMBER, NUMBER_AND_UNIT, TIME_HEADER, TIME_WORD, digits_only_number
from . import curves

def parse_minutes(header: str) -> float:
    """Minutes that a header names, with a unit or, where it speaks of time, without one; NaN for other headers."""
    text = header.strip().lower()
    unit = re.search(NUMBER_AND_UNIT, text)
    number = unit or (re.search(TIME_WORD, text) and re.search(NUMBER, text))
    if not number:
        return math.nan
    return float(number[1]) * (60.0 if unit and unit[2][0] == "h" else 1.0)


def find_time_columns(columns: list[str]) -> list[tuple[str, float]]:
    """H1: headers that name a time, with their minutes, in order of time."""
    timed = [(t, i) for i, name in enumerate(columns) if re.search(TIME_HEADER, name.lower()) and not math.isnan(t := parse_minutes(name))]
    if not timed:
        raise ValueError(f"none of the {len(columns)} column names reads as a time, such as '30 min' or 'Time (1h)'")
    return [(columns[i], t) for t, i in sorted(timed)]


def points_from_columns(df: DataFrame, time_cols: list[tuple[str, float]]) -> Column:
    """Wide → points: text cells keep only digits and '.' (X4, quirk K3);
    numeric cells are used as they are."""
    items = []
    for c, t in time_cols:
        dt = df.schema[c].dataType.simpleString()
        y = digits_only_number(c) if dt == "string" else col(c).cast("double")
        items.append(F.struct(F.lit(float(t)).alias("t"), y.alias("y")))
    return F.filter(F.array(*items), lambda p: p["y"].isNotNull())


def points_from_long(long_df: DataFrame, id_col: str = "id", t_col: str = "t", y_col: str = "y") -> DataFrame:
    """Long → one row per sample with sorted points.

    Repeated (id, t) rows are averaged first (a partial aggregation), so the
    collected group of an id is bounded by its number of distinct time
    points, however many raw rows the id has."""
    long_df = (long_df.where(col(y_col).isNotNull())
               .groupBy(col(id_col).alias(id_col), col(t_col).alias(t_col)).agg(F.avg(y_col).alias(y_col)))
    return (long_df
            .groupBy(col(id_col).alias("id"))
            .agg(F.sort_array(F.collect_list(F.struct(col(t_col).cast("double").alias("t"),
                                                      col(y_col).cast("double").alias("y")))).alias("pts")))


def evaluate(df: DataFrame, r2_threshold: float = 0.80, pts: str = "pts") -> DataFrame:
    """H2: fit linear / exp / quadratic when a sample has ≥3 points; best by
    R² (ties linear, exp, poly) if it reaches the threshold, else 'none'."""
    df = df.withColumn("__n", F.size(pts))
    df = curves.add_fits(df, pts, min_points=3)
    return df.withColumn("best_model", F.when(F.col("__n") >= 3, curves.choose_model("best", r2_threshold))
                         .otherwise(F.lit("none"))).drop("__n")


def _half_life_minutes(method: Column, pts: str = "pts") -> Column:
    y0 = f"try_element_at({pts}, 1).y"
    lin = f"case when lin.a != 0 then (0.5 * {y0} - lin.b) / lin.a end"
    exp = (f"case when expo.A > 0 and expo.B != 0 and {y0} > 0 then "
           f"(ln(0.5 * {y0}) - ln(expo.A)) / expo.B end")
    c = f"(quad.c0 - 0.5 * {y0})"
    disc = f"(quad.c1 * quad.c1 - 4 * quad.c2 * {c})"
    poly = f"""case when quad is null or {y0} is null then null
        when quad.c2 = 0 then case when quad.c1 != 0 and -{c} / quad.c1 >= 0 then -{c} / quad.c1 end
        when {disc} < 0 then null
        else array_min(filter(array((-quad.c1 - sqrt({disc})) / (2 * quad.c2),
                                    (-quad.c1 + sqrt({disc})) / (2 * quad.c2)), r -> r >= 0)) end"""
    t = (F.when(method == "linear", F.expr(lin)).when(method == "exp", F.expr(exp))
         .when(method == "poly", F.expr(poly)))
    return F.when(t >= 0, t)


def half_life(df: DataFrame, method: str = "best", unit: str = "hours", pts: str = "pts") -> DataFrame:
    """H4–H8: start value = earliest observed point; half-life of the chosen
    (or row-wise best) model; minutes → hours; infinities → NULL; 2 dp."""
    pick = F.col("best_model") if method == "best" else F.lit(method)
    scale = 60.0 if unit == "hours" else 1.0
    tmin = _half_life_minutes(pick, pts)
    hl = F.bround(F.when(~F.isnan(tmin / scale) & (F.abs(tmin) != float("inf")), tmin / scale), 2)
    return df.withColumns({"y0": F.expr(f"try_element_at({pts}, 1).y"), "half_life": hl,
                           "method_used": pick})


def _g6(x) -> str:
    return "nan" if x is None else f"{x:.6g}"


def equations(row) -> dict[str, str]:
    """H3: equation texts with 6 significant digits from one row's fitted
    coefficients (driver-side formatting of a handful of rows only)."""
    lin, expo, quad = row["lin"], row["expo"], row["quad"]
    return {
        "equ_linear": f"y = {_g6(lin['a'])} * t + {_g6(lin['b'])}" if lin else "y = a*t + b",
        "equ_exp": f"y = {_g6(expo['A'])} * exp({_g6(expo['B'])} * t)" if expo else "y = A * exp(B*t)",
        "equ_poly": (f"y = {_g6(quad['c2'])}*t^2 + {_g6(quad['c1'])}*t + {_g6(quad['c0'])}" if quad
                     else "y = poly(deg=2)"),
    }


def equation_columns(df: DataFrame) -> DataFrame:
    """H3 as columns (Java %g formatting; compare coefficients, not text)."""
    g = lambda c: F.format_string("%.6g", c)
    return df.withColumns({
        "equ_linear": F.when(F.col("lin").isNotNull(), F.concat(F.lit("y = "), g("lin.a"), F.lit(" * t + "), g("lin.b")))
        .otherwise(F.lit("y = a*t + b")),
        "equ_exp": F.when(F.col("expo").isNotNull(), F.concat(F.lit("y = "), g("expo.A"), F.lit(" * exp("), g("expo.B"),
                                                               F.lit(" * t)"))).otherwise(F.lit("y = A * exp(B*t)")),
        "equ_poly": F.when(F.col("quad").isNotNull(), F.concat(F.lit("y = "), g("quad.c2"), F.lit("*t^2 + "),
                                                               g("quad.c1"), F.lit("*t + "), g("quad.c0")))
        .otherwise(F.lit("y = poly(deg=2)")),
    })
