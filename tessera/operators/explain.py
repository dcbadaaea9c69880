"""Model explanation by distributed scoring.

* Linear models: exact attributions β·(x − x̄) as a projection over all rows.
* Any model: Monte-Carlo permutation attributions against a mean baseline
  (Štrumbelj & Kononenko 2014). For each row the intermediate points of
  all permutations are generated with ``explode`` (at most permutations ×
  (d−1) + 2 different ones), scored in ONE ``transform`` and summed per row
  with their weights in the differences; the sums leave a task as one row.
* Partial dependence: trees count the rows that meet each leaf's conditions on
  the other features (one pass, ``trees.partial_dependence``); for other models
  each row is paired with the grid by ``explode`` of a literal array (grid size
  fixed: 50 or 30×30), scored once, averaged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import col, hash_u, safe_corr
from ..functions.quantiles import quantile_values
from ..session import spread
from . import trees as X


def linear_attributions(df: DataFrame, features: list[str], coefs: dict[str, float], key: str = "id") -> DataFrame:
    """N1 (linear): long (key, feature, value, attribution) with β·(x − mean x)."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    recs = [F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("value"),
                     (F.lit(float(coefs[c])) * (col(c) - F.lit(means[c]))).alias("attribution"))
            for c in features]
    return df.select(key, F.explode(F.array(*recs)).alias("r")).select(key, "r.*")


def permutation_attributions(model, df: DataFrame, features: list[str], key: str = "id",
                             n_perm: int = 16, seed: int = 42, output: str = "prediction",
                             class_index: int | None = None) -> DataFrame:
    """N1 (any model, all rows): long (key, feature, value, attribution, std_error), the
    standard error being that of the mean over permutations.

    ``model.transform`` must accept the feature columns and produce
    ``output`` (a number, or a probability vector with ``class_index``).
    """
    from pyspark.ml.functions import vector_to_array
    base = df.select(key, *features)
    means = base.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    d = len(features)
    # permutation p: features ordered by hash(seed, p, feature)
    order = F.transform(
        F.array_sort(F.array(*[F.struct(hash_u(F.concat_ws(":", F.col("perm"), F.lit(c)), seed, "perm").alias("h"),
                                        F.lit(j).alias("j")) for j, c in enumerate(features)])),
        lambda s: s["j"])
    orders = [r[0] for r in df.sparkSession.range(n_perm).withColumnRenamed("id", "perm").orderBy("perm").select(order).collect()]
    # the sets of known features on the way of every permutation, as bits; each is scored once
    ways = [[sum(1 << j for j in o[:step]) for step in range(d + 1)] for o in orders]
    sets = sorted({s for way in ways for s in way})
    steps = {j: [(way[o.index(j) + 1], way[o.index(j)]) for o, way in zip(orders, ways)] for j in range(d)}
    points = (spread(base.where(col(key).isNotNull())).select(key, *[col(c).cast("double").alias(f"__x{j}") for j, c in enumerate(features)], *[col(c) for c in features])
              .withColumn("__set", F.explode(F.array(*[F.lit(s) for s in sets]))))
    points = points.withColumns({c: F.when(F.col("__set").bitwiseAND(F.lit(1 << j)) != 0, col(c)).otherwise(F.lit(means[c]))
                                 for j, c in enumerate(features)})
    scored = model.transform(points)
    y = scored[output]
    if class_index is not None:
        y = vector_to_array(output)[class_index]
    own = [f"__x{j}" for j in range(d)]
    scored = scored.select(key, *own, "__set", y.cast("double").alias("__y"))
    # a row's points are made in one task, so the partial sums leave it as one row
    shares = [F.create_map(*[F.lit(v) for s in sets for v in (s, float(sum((s == hi) - (s == lo) for hi, lo in steps[j])))])[F.col("__set")] for j in range(d)]
    rows = scored.groupBy(key, *own).agg(
        F.count_if(F.col("__set") == 0).alias("__m"), *[F.sum(F.col("__y") * w).alias(f"__s{j}") for j, w in enumerate(shares)],
        *[F.avg(F.when(F.col("__set") == s, F.col("__y"))).alias(f"__y{s}") for s in sets])
    # a key on m equal rows counts them as one row and m - 1 without change
    n = F.col("__m") * n_perm
    mean = [F.col(f"__s{j}") / F.col("__m") / n for j in range(d)]
    squares = [sum((F.pow(F.col(f"__y{hi}") - F.col(f"__y{lo}"), F.lit(2)) for hi, lo in steps[j]), F.lit(0.0)) for j in range(d)]
    error = [F.when(n > 1, F.sqrt(F.greatest(q - n * m * m, F.lit(0.0)) / (n - 1) / n)) for q, m in zip(squares, mean)]  # Monte-Carlo error
    j = F.col("__j")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m")))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    return rows.select(key, F.array(*[F.lit(c) for c in features])[j].alias("feature"), F.array(*own)[j].alias("value"),
                       F.array(*mean)[j].alias("attribution"), F.array(*error)[j].alias("std_error"))


def importance(attr: DataFrame, by: str | None = None) -> DataFrame:
    """Mean |attribution| per feature (per class with ``by``), descending."""
    g = [by, "feature"] if by else ["feature"]
    return attr.groupBy(*g).agg(F.avg(F.abs("attribution")).alias("importance"))


def top_per_class(imp: DataFrame, by: str, n: int = 10) -> DataFrame:
    """Top-n features per class by importance (window per class: ≤ #features rows)."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def binned_dependence(attr: DataFrame, feature: str, bins: int = 20) -> DataFrame:
    """Equal-width right-closed bins of the feature value; mean
    attribution per bin, 0 for empty bins."""
    a = attr.where(F.col("feature") == feature)
    mm = a.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return attr.sparkSession.createDataFrame([], "bin int, mean_attribution double, n long")
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("value") - F.lit(lo)) / F.lit(w)).cast("int")))
    counts = a.groupBy(b.alias("bin")).agg(F.avg("attribution").alias("m"), F.count("*").alias("n"))
    grid = attr.sparkSession.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return (grid.join(counts, "bin", "left").select("bin", F.coalesce("m", F.lit(0.0)).alias("mean_attribution"),
                                                   F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def partner_feature(attr: DataFrame, feature: str, values: DataFrame | None, candidates: list[str],
                    key: str = "id", min_rows: int = 5) -> DataFrame:
    """The candidate whose value correlates most (|r|) with the
    feature's attribution; needs ≥ min_rows complete rows. One aggregate.
    Without ``values`` the candidates are columns of ``attr``."""
    a = attr.where(F.col("feature") == feature)
    if values is not None:
        a = a.select(key, "attribution").join(values.select(key, *candidates), key)
    aggs = []
    for i, c in enumerate(candidates):
        ok = col(c).isNotNull() & F.col("attribution").isNotNull()
        aggs += [safe_corr(col(c), F.col("attribution")).alias(f"r{i}"), F.count_if(ok).alias(f"n{i}")]
    one = a.agg(*aggs)
    recs = [F.struct(F.lit(c).alias("partner"), F.when(F.col(f"n{i}") >= min_rows, F.abs(F.col(f"r{i}"))).alias("abs_r"))
            for i, c in enumerate(candidates) if c != feature]
    return (one.select(F.explode(F.array(*recs)).alias("x")).select("x.*").where(F.col("abs_r").isNotNull())
            .orderBy(F.desc("abs_r"), "partner").limit(1))


def pdp_grid(df: DataFrame, feature: str, points: int = 50, distinct_max: int = 50) -> list[float]:
    """Grid: the sorted distinct values when few, else `points` evenly spaced
    between the 5th and 95th percentiles."""
    d = df.select(feature).where(col(feature).isNotNull()).distinct().limit(distinct_max + 1).collect()
    if len(d) <= distinct_max:
        return sorted(float(r[0]) for r in d)
    lo, hi = quantile_values(df, [feature], [0.05, 0.95])[feature]
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def _own_trees(model, df: DataFrame):
    """(trees, rows, features) of a fitted assembler and ensemble of regression trees, else None."""
    stages = getattr(model, "stages", [])
    if len(stages) != 2 or type(stages[0]).__name__ != "VectorAssembler" or type(stages[1]).__name__ not in (
            "RandomForestRegressionModel", "GBTRegressionModel", "DecisionTreeRegressionModel"):
        return None
    return X.node_tables(model, df.sparkSession), df, stages[0].getInputCols()


def partial_dependence(model, df: DataFrame, feature: str, key: str = "id", points: int = 50,
                       output: str = "prediction", class_index: int | None = None, ice: bool = False) -> DataFrame:
    """PDP (grid value, mean prediction); with ``ice`` one curve per row."""
    from pyspark.ml.functions import vector_to_array
    grid = pdp_grid(df, feature, points)
    trees = None if ice or class_index is not None else _own_trees(model, df)
    if trees:
        grid = sorted(set(grid))
        pd = X.partial_dependence(*trees, [feature], [(v,) for v in grid]) if grid else []
        return df.sparkSession.createDataFrame(list(zip(grid, pd)), "value double, pd double")
    g = F.explode(F.array(*[F.lit(v) for v in grid])).alias("__g")
    pts = df.select("*", g).withColumn(feature, F.col("__g"))
    sc = model.transform(pts)
    y = vector_to_array(output)[class_index] if class_index is not None else sc[output]
    sc = sc.select(key, "__g", y.cast("double").alias("y"))
    if ice:
        return sc.select(key, F.col("__g").alias("value"), "y")
    return sc.groupBy(F.col("__g").alias("value")).agg(F.avg("y").alias("pd"))


def partial_dependence_2d(model, df: DataFrame, f1: str, f2: str, points: int = 30,
                          output: str = "prediction", class_index: int | None = None) -> DataFrame:
    """2-D PDP on a points×points grid over all rows."""
    from pyspark.ml.functions import vector_to_array
    g1, g2 = pdp_grid(df, f1, points, points), pdp_grid(df, f2, points, points)
    trees = None if class_index is not None else _own_trees(model, df)
    if trees:
        grid = [(a, b) for a in sorted(set(g1)) for b in sorted(set(g2))]
        pd = X.partial_dependence(*trees, [f1, f2], grid) if grid else []
        return df.sparkSession.createDataFrame([(*g, v) for g, v in zip(grid, pd)], f"`{f1}` double, `{f2}` double, pd double")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in g1 for b in g2]))
    pts = df.select("*", pairs.alias("__g")).withColumns({f1: F.col("__g.a"), f2: F.col("__g.b")})
    sc = model.transform(pts)
    y = vector_to_array(output)[class_index] if class_index is not None else sc[output]
    return sc.groupBy(F.col("__g.a").alias(f1), F.col("__g.b").alias(f2)).agg(F.avg(y).alias("pd"))


_SPLIT = re.compile(r"(?:If|Else) \(feature (\d+) (<=|>|in|not in) ([^)]*)\)")
_LEAF = re.compile(r"Predict: ([-0-9.eE]+)")


def surrogate_rules(df: DataFrame, features: list[str], target: str, depth: int = 3, task: str = "regression"):
    """A depth-limited decision tree on original units, as a rule table
    (rule text, prediction) parsed from ``toDebugString``."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    depth = max(2, min(6, depth))
    va = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="skip")
    data = va.transform(df.withColumn(target, col(target).cast("double")))
    est = (DecisionTreeRegressor if task == "regression" else DecisionTreeClassifier)(
        featuresCol="__f", labelCol=target, maxDepth=depth, seed=42)
    tree = est.fit(data)
    rules, path = [], []  # path: (depth of the line, condition) of the open branches
    for line in tree.toDebugString.splitlines()[1:]:
        text = line.strip()
        split, leaf = _SPLIT.match(text), _LEAF.search(text)
        if split:
            depth_here = len(line) - len(line.lstrip())
            path = [p for p in path if p[0] < depth_here]
            path.append((depth_here, f"{features[int(split.group(1))]} {split.group(2)} {split.group(3)}"))
        elif leaf:
            rules.append((" AND ".join(p[1] for p in path), float(leaf.group(1))))
    return df.sparkSession.createDataFrame(rules, "rule string, prediction double")
