"""Exact attributions of tree ensembles (N1, N2, N4, N8), from their node tables.

The value of a set of known features is the ensemble's prediction when every
split on an unknown feature sends a row both ways, weighted by the training rows
that went there; an attribution is the Shapley value of that game. For one leaf
the game is a product over the distinct features on its path: a known feature
contributes 1 or 0 (the row satisfies all the path's conditions on it, or not),
an unknown one the share of training rows its splits send along the path. The
Shapley weights of subset sizes are integrals of powers of t and 1 - t, so

    phi_j = value * (o_j - z_j) * integral over [0, 1] of prod_{k != j} ((1 - t) z_k + t o_k) dt

with o the row's zeros and ones and z the shares: a polynomial in t, which
Gauss-Legendre points integrate exactly. There are at most 2 ** p different rows
for a leaf whose path has p features, so a batch looks its rows up in a table of
them. A row is read once, whatever the number of features: no scoring of
intermediate points, no sampling, no background rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..session import shared_path


@dataclass
class Tree:
    """One tree as arrays over its nodes, the root first; ``left`` is -1 at leaves.

    A row goes left at a node if its feature is at most ``threshold`` or, where
    ``categories`` has the node, if its value is one of those listed there.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    categories: dict = field(default_factory=dict)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        if node in self.categories:
            return np.isin(x, self.categories[node])
        return x <= self.threshold[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = self.value[node]
            else:
                left = self.goes_left(node, x[rows, self.feature[node]])
                todo += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out

    def leaves(self):
        """(value, {feature: (share, [(node, goes left), ...])}) of every leaf."""
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            if self.left[node] < 0:
                yield float(self.value[node]), path
                continue
            f = int(self.feature[node])
            share, conditions = path.get(f, (1.0, []))
            for child, left in ((self.left[node], True), (self.right[node], False)):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                todo.append((child, {**path, f: (share * part, [*conditions, (node, left)])}))

    def mean(self) -> float:
        """Prediction when no feature is known."""
        return float(sum(v * np.prod([s for s, _ in path.values()]) for v, path in self.leaves()))


def _shapley(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product game of one leaf of value 1: rows of ``known`` (0 or 1) by features."""
    p = len(share)
    points, weights = np.polynomial.legendre.leggauss((p + 1) // 2)
    out = np.zeros(known.shape)
    for t, w in zip((points + 1) / 2, weights / 2):
        factors = (1 - t) * share + t * known
        rest = np.ones_like(factors)  # products of the other factors, from both ends (a share may be 0)
        rest[:, 1:] = np.cumprod(factors[:, :-1], axis=1)
        tail = np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
        rest[:, :-1] *= tail
        out += w * rest
    return out * (known - share)


#: Most entries of the leaves' tables that are made once for all rows.
TABLES = 1 << 22


def _games(trees: list[Tree]):
    """For each tree, (value, [(feature, [(node, goes left), ...]), ...], shares) of its leaves that give attributions."""
    for tree in trees:
        yield tree, [(value, [(f, conditions) for f, (_, conditions) in path.items()], np.array([s for s, _ in path.values()]))
                     for value, path in tree.leaves() if path and value != 0]


def _table(value: float, share: np.ndarray) -> np.ndarray:
    """Attributions of a leaf's features (features by rows) for all rows there can be: bit i of a row's number is what the row has for feature i."""
    p = len(share)
    return np.ascontiguousarray((value * _shapley(((np.arange(1 << p)[:, None] & (1 << np.arange(p))) > 0).astype(float), share)).T)


class Attributions:
    """Attributions of rows by ``trees``, batch after batch; the leaves' tables are made once, up to ``TABLES`` entries."""

    def __init__(self, trees: list[Tree], entries: int = TABLES):
        self.games, self.tables = list(_games(trees)), {}
        for t, (_, leaves) in enumerate(self.games):
            for at, (value, _, share) in enumerate(leaves):
                size = len(share) << len(share)
                if size <= entries:
                    self.tables[t, at], entries = _table(value, share), entries - size

    def __call__(self, x: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(x.T)
        out = np.zeros(columns.shape)  # features by rows
        for t, (tree, leaves) in enumerate(self.games):
            goes = {int(n): tree.goes_left(n, columns[tree.feature[n]]) for n in np.flatnonzero(tree.left >= 0)}
            stays = {n: ~g for n, g in goes.items()}
            for at, (value, path, share) in enumerate(leaves):
                known = []
                for _, conditions in path:
                    node, left = conditions[0]
                    met = goes[node] if left else stays[node]
                    for node, left in conditions[1:]:
                        met = met & (goes[node] if left else stays[node])
                    known.append(met)
                if 1 << len(path) <= len(x):  # all rows there can be
                    number = known[0].astype(np.intp)
                    for i, met in enumerate(known[1:], 1):
                        number += met.astype(np.intp) << i
                    table = self.tables.get((t, at))
                    for (f, _), own in zip(path, _table(value, share) if table is None else table):
                        out[f] += own.take(number)
                else:
                    phi = value * _shapley(np.stack(known, axis=1).astype(float), share)
                    for (f, _), own in zip(path, phi.T):
                        out[f] += own
        return out.T


def shapley_values(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Attributions of every row of ``x`` and feature, summed over ``trees``."""
    return Attributions(trees, 0)(x)


def node_tables(model, spark, class_index: int | None = None) -> list[Tree]:
    """Trees of a fitted forest, boosted ensemble or single tree, of its pipeline, or of one class of a one-vs-rest model.

    Values carry the ensemble's weights: the trees' predictions add up to the
    model's prediction, to the probability of ``class_index`` (forests and single
    trees of classes) or to the log-odds margin (boosted classes). The node table
    is bounded by the model, not by the data.
    """
    if hasattr(model, "trees") and hasattr(model, "base"):  # a leaf-wise ensemble: its own trees, on the scale of its scores
        return model.trees[class_index or 0]
    if hasattr(model, "stages"):
        model = model.stages[-1]
    if hasattr(model, "models"):
        model = model.models[class_index]
    path = shared_path(spark, "model")
    model.save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    else:
        rows = rows.withColumn("treeID", F.lit(0))
    pdf = rows.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split.*").toPandas()
    boosted = type(model).__name__.startswith("GBT")
    shares = class_index is not None and not boosted and not type(model).__name__.endswith("RegressionModel")
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if not boosted:
        weights = [w / sum(weights) for w in weights]
    out = []
    for i, own in pdf.sort_values("id").groupby("treeID"):
        stats = [np.asarray(s) for s in own["impurityStats"]]
        value = np.array([s[class_index] / s.sum() for s in stats]) if shares else own["prediction"].to_numpy(float)
        cover = np.array([s.sum() for s in stats]) if shares or type(model).__name__.endswith("ClassificationModel") and not boosted else np.array([s[0] for s in stats])
        number = {n: k for k, n in enumerate(own["id"])}
        inner = own["leftChild"].to_numpy() >= 0
        first = [t[0] if len(t) else np.inf for t in own["leftCategoriesOrThreshold"]]
        categories = {number[n]: np.asarray(t) for n, t, k in zip(own["id"], own["leftCategoriesOrThreshold"], own["numCategories"]) if k >= 0}
        out.append(Tree(own["featureIndex"].to_numpy(), np.array(first, float), np.array([number.get(n, -1) for n in own["leftChild"]]),
                        np.array([number.get(n, -1) for n in own["rightChild"]]), cover, np.where(inner, 0.0, value * weights[i]), categories))
    return out


def tree_attributions(trees: list[Tree], df: DataFrame, features: list[str], key: str = "id", keep: list[str] = ()) -> DataFrame:
    """N1 for trees, all rows in one pass: long (key, feature, value, attribution), with the row's ``keep`` columns.

    A row's attributions add up to its prediction less the ensemble's mean over
    its training rows. ``features`` are the columns in the order of the model's
    feature numbers; a missing value goes right at splits on a threshold.
    """
    attributions = df.sparkSession.sparkContext.broadcast(Attributions(trees))
    kept = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {df.select(col(c)).schema[0].dataType.simpleString()}" for n, c in zip(["key", *kept], [key, *keep]))
    d = len(features)

    def run(frames):
        for pdf in frames:
            x = pdf.iloc[:, 1 + len(kept):].to_numpy(float)
            yield pd.DataFrame({**{n: pdf[n] for n in ["key", *kept]}, "a": list(attributions.value(x)), "x": list(x)})

    rows = df.select(col(key).alias("key"), *[col(c).alias(n) for n, c in zip(kept, keep)], *[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    got = rows.mapInPandas(run, f"{kinds}, a array<double>, x array<double>")
    names = F.array(*[F.lit(f) for f in features])
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(names[i].alias("feature"), F.nanvl(F.col("x")[i], F.lit(None)).alias("value"), F.col("a")[i].alias("attribution"))))
    return got.select(F.col("key").alias(key), *[F.col(n).alias(c) for n, c in zip(kept, keep)], each.alias("r")).select(col(key), "r.*", *[col(c) for c in keep])


def partial_dependence(trees: list[Tree], df: DataFrame, features: list[str], fixed: list[str], grid: list[tuple]) -> list[float]:
    """N5, N6 for trees: the mean prediction over all rows at every point of ``grid`` (values of ``fixed``).

    Whether a row reaches a leaf at a grid point is the product of two tests: the
    point meets the path's conditions on the fixed features, the row meets the
    others. One pass counts the rows that meet the others, leaf by leaf; rows are
    not paired with grid points.
    """
    where = {features.index(f): i for i, f in enumerate(fixed)}
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(frames):
        total, rows = 0, 0
        for pdf in frames:
            x = pdf.to_numpy(float)
            total = total + np.array([np.count_nonzero(m) for _, m in _reached(shared.value, x, lambda f: f if f not in where else None)])
            rows += len(x)
        if rows:
            yield pd.DataFrame({"leaf": np.arange(-1, len(total)), "n": [rows, *total]})

    rows = df.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    got = dict(map(tuple, rows.mapInPandas(run, "leaf long, n long").groupBy("leaf").agg(F.sum("n")).collect()))
    if not got:
        return []
    out = np.zeros(len(grid))
    for leaf, (value, mask) in enumerate(_reached(trees, np.array(grid, float), where.get)):
        out += value * got[leaf] / got[-1] * mask
    return out.tolist()


def _reached(trees: list[Tree], x: np.ndarray, column):
    """(value, which rows of ``x`` meet the path's conditions) of every leaf of all trees; ``column`` gives a feature's column, or None to pass it over."""
    for tree in trees:
        todo = [(0, np.ones(len(x), bool))]
        while todo:
            node, mask = todo.pop()
            if tree.left[node] < 0:
                yield float(tree.value[node]), mask
                continue
            at = column(int(tree.feature[node]))
            left = True if at is None else tree.goes_left(node, x[:, at])
            todo += [(tree.left[node], mask & left), (tree.right[node], mask if at is None else mask & ~left)]
