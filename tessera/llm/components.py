"""Connected components of an edge table by contraction.

Every round, each node moves to the neighbour (or itself) of least random
priority, and the edges between what is left form the next graph. A round
removes a constant share of the nodes, also of long chains. All state is in
tables; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` (a, b: bigint) -> (node, component): equal components are connected; a component's name is one of its nodes."""
    edges = c.save(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names = None
    for r in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        ranked = lambda x: F.struct(F.xxhash64(F.col(x), F.lit(r)).alias("rank"), F.col(x).alias("node"))
        best = both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
        step = best.select(F.col("a").alias("node"), F.least(F.col("best"), ranked("a")).getField("node").alias("to"))
        step = c.save(step, "step")
        if names is None:
            names = step.select("node", F.col("to").alias("component"))
        else:
            names = names.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names = c.save(names, "names")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = c.save(edges.join(left, "a").join(right, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names

