"""Local regression trend (N3): tricube-weighted straight-line fits with robust passes.

The trend is fitted at given points (all distinct x values if they are few, else
quantiles) and lies on straight lines between them. Each point looks at the
nearest ``frac`` of all rows; how far that reaches is an order statistic of the
rows' distances, found for all points at once (``functions.orderstats``), and the
fit follows from weighted sums, one aggregate for all points. Robust passes weigh
rows down by their residual against six times the median one. Rows meet points
through ``explode`` of the point array (bounded), are combined where they lie, and
no neighbourhood is ever gathered: the work is rows x points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..functions.orderstats import order_statistics
from ..functions.quantiles import exact_quantiles
from ..session import shared_table


def _points(data: DataFrame, points: int) -> list[float]:
    few = data.select("x").distinct().limit(points + 1).collect()
    if len(few) <= points:
        return sorted(r["x"] for r in few)
    return sorted(set(exact_quantiles(data, ["x"], [i / (points - 1) for i in range(points)])["x"]))


def _on_line(x: Column, at: list[float], fit: list[float]) -> Column:
    """The trend at ``x``: straight lines between the fitted points."""
    a, y = F.array(*[F.lit(v) for v in at]), F.array(*[F.lit(v) for v in fit])
    if len(at) == 1:
        return F.lit(fit[0])
    i = F.least(F.greatest(F.size(F.filter(a, lambda v: v <= x)), F.lit(1)), F.lit(len(at) - 1))  # 1-based left end
    x0, x1, y0, y1 = F.element_at(a, i), F.element_at(a, i + 1), F.element_at(y, i), F.element_at(y, i + 1)
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def local_trend(df: DataFrame, x: str, y: str, frac: float = 0.4, points: int = 100, robust: int = 3) -> DataFrame:
    """(x, trend, radius) at the fitted points, in order of x.

    ``k = int(frac * rows)`` rows (two at least) belong to a neighbourhood, ties at
    its edge included with weight 0. Rows with a missing x or y are left out; no
    rows give no points. A neighbourhood of one x value has the weighted mean.
    """
    spark = df.sparkSession
    schema = "x double, trend double, radius double"
    data = df.select(F.nanvl(col(x).cast("double"), F.lit(None)).alias("x"), F.nanvl(col(y).cast("double"), F.lit(None)).alias("y")).dropna()
    data = shared_table(data, "trend")
    n = data.count()
    if not n:
        return spark.createDataFrame([], schema)
    at, k = _points(data, points), min(n, max(2, int(frac * n + 1e-10)))
    each = F.explode(F.transform(F.array(*[F.lit(v) for v in at]), lambda v, i: F.struct(i.alias("i"), v.alias("at")))).alias("p")
    met = data.select("x", "y", each).select("x", "y", F.col("p.i").alias("i"), F.col("p.at").alias("at"))
    found = order_statistics(met.select("i", F.abs(F.col("x") - F.col("at")).alias("d")), ["i"], "d", lambda _: F.array(F.lit(k - 1)))
    reach = {r["i"]: r["value"] for r in found.collect()}  # a number for each point
    radius = [reach[i] for i in range(len(at))]
    weight, fit = F.lit(1.0), [0.0] * len(at)
    for step in range(robust + 1):
        rows = data.withColumn("r", weight)
        met = rows.select("x", "y", "r", each).select("y", "r", F.col("p.i").alias("i"), (F.col("x") - F.col("p.at")).alias("u"))
        h = F.array(*[F.lit(v) for v in radius])[F.col("i")]
        share = F.abs("u") / h
        w = F.col("r") * F.when(h <= 0, (F.col("u") == 0).cast("double")).otherwise(F.when(share < 1, F.pow(1 - F.pow(share, 3), 3)).otherwise(0.0))
        sums = met.where(F.abs("u") <= h).withColumn("w", w).groupBy("i").agg(
            *[F.sum(F.col("w") * e).alias(name) for name, e in (("s", F.lit(1.0)), ("u", F.col("u")), ("y", F.col("y")), ("uu", F.col("u") * F.col("u")), ("uy", F.col("u") * F.col("y")))]).collect()
        for r in sums:
            s, mu, my = r["s"], r["u"] / r["s"] if r["s"] else 0.0, r["y"] / r["s"] if r["s"] else fit[r["i"]]
            var = r["uu"] / s - mu * mu if s else 0.0
            slope = (r["uy"] / s - mu * my) / var if var > 1e-12 * max(radius[r["i"]], 1e-300) ** 2 else 0.0
            fit[r["i"]] = my - slope * mu
        if step == robust:
            break
        residual = F.abs(F.col("y") - _on_line(F.col("x"), at, fit))
        median = exact_quantiles(data.select(residual.alias("e")), ["e"], [0.5])["e"][0]
        if not median:
            break
        weight = F.when(residual < 6 * median, F.pow(1 - F.pow(residual / (6 * median), 2), 2)).otherwise(0.0)
    return spark.createDataFrame(list(zip(at, map(float, fit), map(float, radius))), schema).orderBy("x")
