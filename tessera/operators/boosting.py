"""Gradient boosting with leaf-wise trees over binned features (T4, T5).

Rows are binned once: every feature to at most ``max_bin`` codes by cuts at its
quantiles (a missing value has a code of its own and goes right), written as
blocks of rows with the codes column by column, the labels and the running
scores. A pass over the blocks drops every row down the tree so far and sums
gradients, curvatures and rows by (leaf, feature, code): the histograms are all
that leaves the tasks, combined in each task, then by leaf and feature, so that
what reaches the driver is bounded by leaves x features x codes.

Trees grow leaf-wise: the leaf whose best split gains most is split next, until
there are ``num_leaves``. Symmetric trees (``symmetric``) cut all leaves of a level
at the same feature and code, the one that gains most in sum, level by level. To keep passes few, one pass prepares the splits of all
leaves that may be next: both children's histograms are got at once, the smaller
child by summing and its sibling by subtraction. A tree takes about as many passes
as it is deep, not as it has leaves. Squared error, log-loss of two classes, and
softmax of more (one tree a class and round) share all of it.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import col
from ..session import shared_path
from .trees import Tree

#: Rows of a block.
BLOCK = 16_384
#: How blocks are written: a row group, which a task reads whole, holds some blocks, however many a file has.
GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 2}


@dataclass
class Settings:
    """Learner settings; the defaults are those of the first boosted preset."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = 64
    max_bin: int = 255
    min_rows: int = 20
    min_curvature: float = 1e-3
    l2: float = 0.0
    symmetric: bool = False  # one cut for all leaves of a level, ``max_depth`` levels


@dataclass
class Node:
    """A node while its tree grows; ``split`` is (gain, feature, code): codes up to it go left."""

    total: np.ndarray  # gradient, curvature, rows
    hist: np.ndarray | None = None
    split: tuple | None = None
    depth: int = 0
    left: int = -1
    right: int = -1


@dataclass
class Boosted:
    """A fitted ensemble: ``trees[k]`` are the trees of score ``k``; scores start at ``base``."""

    features: list[str]
    trees: list[list[Tree]]
    base: np.ndarray
    classes: list | None = None

    def splits(self) -> np.ndarray:
        """How often each feature is split on."""
        used = [t.feature[t.left >= 0] for ts in self.trees for t in ts]
        return np.bincount(np.concatenate(used) if used else np.zeros(0, int), minlength=len(self.features))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.stack([b + sum((t.predict(x) for t in ts), np.zeros(len(x))) for b, ts in zip(self.base, self.trees)], axis=1)


def _expit(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def _derivatives(scores: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss at every row and score."""
    if kind == "values":
        return scores - y[:, None], np.ones_like(scores)
    if kind == "two":
        p = _expit(scores)
        return p - y[:, None], p * (1 - p)
    wide = np.ascontiguousarray(scores.T)  # a score's values side by side: few long passes, not many short ones
    e = np.exp(wide - wide.max(axis=0))
    p = e / e.sum(axis=0)
    k = len(wide)
    return (p - (y == np.arange(k)[:, None])).T, (p * (1 - p) * k / (k - 1)).T


def split_gains(hist: np.ndarray, total: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of every cut (features x codes) of a leaf, -inf where a side is too small: ``hist`` is features x codes x (gradient, curvature, rows)."""
    left = np.cumsum(hist, axis=1)[:, :-1]  # the last code is that of missing values: it stays right
    right = total - left
    ok = (left[..., 2] >= s.min_rows) & (right[..., 2] >= s.min_rows) & (left[..., 1] >= s.min_curvature) & (right[..., 1] >= s.min_curvature)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / (left[..., 1] + s.l2) + right[..., 0] ** 2 / (right[..., 1] + s.l2) - total[0] ** 2 / (total[1] + s.l2)
    return np.where(ok, gain, -np.inf)


def best_split(hist: np.ndarray, total: np.ndarray, s: Settings) -> tuple | None:
    """(gain, feature, code) of the best cut of a leaf, if one gains."""
    gain = split_gains(hist, total, s)
    f, code = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, code]), int(f), int(code)) if gain[f, code] > 1e-12 else None


def _rows_of(nodes: list, codes: np.ndarray, wanted) -> dict[int, np.ndarray]:
    """The rows of a block, in order, that come to each of the ``wanted`` nodes; ``nodes`` are (feature, code, left, right), feature -1 at leaves.

    Rows are handed from parents to children, and only on the ways to wanted nodes.
    """
    needed = set(wanted)
    for i in reversed(range(len(nodes))):  # children come after their parents
        f, _, left, right = nodes[i]
        if f >= 0 and (left in needed or right in needed):
            needed.add(i)
    out, held = {}, {0: None}  # None: all rows
    for i, (f, code, left, right) in enumerate(nodes):
        if i not in held:
            continue
        own = held.pop(i)
        if i in wanted:
            out[i] = np.arange(codes.shape[1]) if own is None else own
        if f >= 0 and (left in needed or right in needed):
            goes = (codes[f] if own is None else codes[f].take(own)) <= code
            for child, side in ((left, goes), (right, ~goes)):
                if child in needed:
                    at = np.flatnonzero(side)
                    held[child] = at if own is None else own.take(at)
    return out


def _drop(nodes: list, codes: np.ndarray) -> np.ndarray:
    """The node each row of a block ends in."""
    at = np.zeros(codes.shape[1], np.int32)
    for i, own in _rows_of(nodes, codes, {i for i, n in enumerate(nodes) if n[0] < 0}).items():
        at[own] = i
    return at


def add_sums(out: dict, trees: list[list], of: dict[int, list[int]], codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add a block's gradients, curvatures and rows by feature and code to ``out[score, node]`` for the nodes ``of`` each score."""
    d, bins = codes.shape[0], next(iter(out.values())).shape[1]
    every = None  # codes and rows of each feature over the whole block: the same for all scores
    for c, nodes in of.items():
        gc, hc = g[:, c], h[:, c]
        if len(trees[c]) == 1:
            every = every or [(x, np.bincount(x, minlength=bins)) for x in codes.astype(np.intp)]
            for n in nodes:
                for f, (x, rows) in enumerate(every):
                    out[c, n][f, :, 0] += np.bincount(x, gc, bins)
                    out[c, n][f, :, 1] += np.bincount(x, hc, bins)
                    out[c, n][f, :, 2] += rows
            continue
        rows_of = _rows_of(trees[c], codes, set(nodes))
        if not rows_of:
            continue
        own = np.concatenate(list(rows_of.values()))
        place = np.repeat(np.arange(len(rows_of)) * bins, [len(r) for r in rows_of.values()])  # each node's codes in a range of their own
        gg, hh = gc.take(own), hc.take(own)
        for f in range(d):
            x = codes[f].take(own) + place
            for i, weights in enumerate((gg, hh, None)):
                for n, sums in zip(rows_of, np.bincount(x, weights, len(rows_of) * bins).reshape(-1, bins)):
                    out[c, n][f, :, i] += sums


class _Data:
    """The binned blocks of a training table, and passes over them."""

    def __init__(self, df: DataFrame, features: list[str], label, kind: str, k: int, cuts: list[np.ndarray], base: np.ndarray):
        self.spark, self.kind, self.k, self.d = df.sparkSession, kind, k, len(features)
        self.bins = max(len(c) for c in cuts) + 2  # codes 0..len(cuts), and the last for missing values
        bins, d = self.bins, self.d
        wide = np.uint8 if bins <= 256 else np.uint16
        rows = df.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], label.alias("y")).where("y is not null and not isnan(y)")

        def run(batches):
            held = []
            for batch in batches:
                held.append(np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), dtype=float) for i in range(d + 1)]))
                if sum(h.shape[1] for h in held) >= BLOCK:
                    yield block(held)
                    held = []
            if held:
                yield block(held)

        def block(held):
            m = np.concatenate(held, axis=1)
            codes = np.stack([np.where(np.isnan(m[i]), bins - 1, np.searchsorted(cuts[i], m[i], "left")) for i in range(d)]).astype(wide)
            scores = np.tile(base, (m.shape[1], 1))
            return pa.RecordBatch.from_pydict({"n": [m.shape[1]], "codes": [codes.tobytes()], "y": [m[d].tobytes()], "scores": [scores.tobytes()]})

        self.wide = wide
        self.table = self._write(rows.mapInArrow(run, self.schema))

    schema = "n bigint, codes binary, y binary, scores binary"

    def _write(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "boosting")
        df.write.options(**GROUPS).parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def histograms(self, trees: list[list], wanted: list[tuple[int, int]]) -> dict:
        """{(score, node): features x codes x 3} of the wanted nodes of the growing trees, one a score."""
        wide, d, bins, kind, k = self.wide, self.d, self.bins, self.kind, self.k
        of: dict[int, list[int]] = {}
        for c, node in wanted:
            of.setdefault(c, []).append(node)

        def run(batches):
            out = {(c, n): np.zeros((d, bins, 3)) for c, n in wanted}
            for batch in batches:
                for r in batch.to_pylist():
                    codes = np.frombuffer(r["codes"], wide).reshape(d, r["n"])
                    g, h = _derivatives(np.frombuffer(r["scores"]).reshape(r["n"], k), np.frombuffer(r["y"]), kind)
                    add_sums(out, trees, of, codes, g, h)
            yield pa.RecordBatch.from_pydict({"score": pa.array([c for c, _ in out], pa.int32()), "node": pa.array([n for _, n in out], pa.int32()),
                                              "hist": [v.tobytes() for v in out.values()]})

        def merge(batches):
            sums: dict = {}
            for batch in batches:
                for r in batch.to_pylist():
                    part = np.frombuffer(r["hist"])
                    key = r["score"], r["node"]
                    sums[key] = sums[key] + part if key in sums else part
            if sums:
                yield pa.RecordBatch.from_pydict({"score": pa.array([c for c, _ in sums], pa.int32()), "node": pa.array([n for _, n in sums], pa.int32()),
                                                  "hist": [v.tobytes() for v in sums.values()]})

        schema = "score int, node int, hist binary"
        parts = self.table.mapInArrow(run, schema)
        if len(self.table.inputFiles()) > 8:  # few partial sums are put together here, many in tasks of their own
            parts = parts.repartition("score", "node").mapInArrow(merge, schema)
        with self.few_rows():
            got = parts.toArrow().to_batches()
        sums = [r for batch in merge(got) for r in batch.to_pylist()]
        return {(r["score"], r["node"]): np.frombuffer(r["hist"]).reshape(d, bins, 3) for r in sums}

    def add(self, trees: list[list], values: list[np.ndarray]) -> None:
        """Add the finished trees of a round to the scores."""
        wide, d, k = self.wide, self.d, self.k

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    codes = np.frombuffer(r["codes"], wide).reshape(d, r["n"])
                    scores = np.frombuffer(r["scores"]).reshape(r["n"], k).copy()
                    for c in range(k):
                        scores[:, c] += values[c][_drop(trees[c], codes)]
                    yield pa.RecordBatch.from_pydict({**{n: [r[n]] for n in ("n", "codes", "y")}, "scores": [scores.tobytes()]})

        with self.few_rows():
            self.table = self._write(self.table.mapInArrow(run, self.schema))

    @contextmanager
    def few_rows(self):
        """Arrow batches of a few blocks: a block is as large as thousands of ordinary rows."""
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "8")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)


def _grow(data: _Data, s: Settings, scores: int) -> list[list[Node]]:
    """One tree a score, leaf by leaf, with the splits of many leaves prepared in a pass."""
    trees: list[list[Node]] = [[] for _ in range(scores)]

    def shape(c):
        return [(n.split[1], n.split[2], n.left, n.right) if n.left >= 0 else (-1, 0, -1, -1) for n in trees[c]]

    first = data.histograms([[(-1, 0, -1, -1)]] * scores, [(c, 0) for c in range(scores)])
    for c in range(scores):
        hist = first.get((c, 0), np.zeros((data.d, data.bins, 3)))
        root = Node(hist[0].sum(axis=0), hist)
        root.split = best_split(hist, root.total, s)
        trees[c].append(root)
    # Splits are made ahead of need: a node that leaf-wise growth does not reach is cut off in the end.
    while True:
        smaller = []
        for c in range(scores):
            taken = _taken(trees[c], s)
            for i in taken[1]:
                node = trees[c][i]
                _, f, code = node.split
                left = node.hist[f, :code + 1].sum(axis=0)
                node.left, node.right = len(trees[c]), len(trees[c]) + 1
                trees[c] += [Node(left, depth=node.depth + 1), Node(node.total - left, depth=node.depth + 1)]
                smaller.append((c, node.left if left[2] * 2 <= node.total[2] else node.right, i))
        if not smaller:
            break
        got = data.histograms([shape(c) for c in range(scores)], [(c, n) for c, n, _ in smaller])
        for c, n, parent in smaller:
            node = trees[c][parent]
            hist = got.get((c, n), np.zeros((data.d, data.bins, 3)))
            for child in (node.left, node.right):
                own = trees[c][child]
                own.hist = hist if child == n else node.hist - hist
                own.split = best_split(own.hist, own.total, s) if own.depth < s.max_depth else None
            node.hist = None
    return trees


def _grow_symmetric(data: _Data, s: Settings, scores: int) -> list[list[Node]]:
    """One symmetric tree a score: all leaves of a level share a cut; a pass a level."""
    got = data.histograms([[(-1, 0, -1, -1)]] * scores, [(c, 0) for c in range(scores)])
    trees = [[Node(got[c, 0][0].sum(axis=0), got[c, 0])] if (c, 0) in got else [Node(np.zeros(3), np.zeros((data.d, data.bins, 3)))] for c in range(scores)]
    level = [[0] for _ in range(scores)]
    for depth in range(s.max_depth):
        smaller = []
        for c, tree in enumerate(trees):
            f, code = best_level_cut([tree[i].hist for i in level[c]], s)
            if f < 0:
                level[c] = []
                continue
            after = []
            for i in level[c]:
                node = tree[i]
                left = node.hist[f, :code + 1].sum(axis=0)
                node.split, node.left, node.right = (0.0, f, code), len(tree), len(tree) + 1
                tree += [Node(left, depth=depth + 1), Node(node.total - left, depth=depth + 1)]
                after += [node.left, node.right]
                smaller.append((c, node.left if left[2] * 2 <= node.total[2] else node.right, i))
            level[c] = after
        if not smaller or depth + 1 == s.max_depth:
            break
        shapes = [[(n.split[1], n.split[2], n.left, n.right) if n.left >= 0 else (-1, 0, -1, -1) for n in tree] for tree in trees]
        got = data.histograms(shapes, [(c, n) for c, n, _ in smaller])
        for c, n, parent in smaller:
            node = trees[c][parent]
            hist = got.get((c, n), np.zeros((data.d, data.bins, 3)))
            for child in (node.left, node.right):
                trees[c][child].hist = hist if child == n else node.hist - hist
            node.hist = None
    return trees


def best_level_cut(hists: list[np.ndarray], s: Settings) -> tuple[int, int]:
    """(feature, code) of the cut that gains most summed over the leaves of a level; feature -1 if none gains."""
    gain = 0.0
    for hist in hists:
        left = np.cumsum(hist, axis=1)[:, :-1]
        total = hist.sum(axis=1, keepdims=True)
        for part, sign in ((left, 1), (total - left, 1), (total, -1)):
            gain = gain + sign * np.where(part[..., 2] > 0.5, part[..., 0] ** 2 / np.maximum(part[..., 1] + s.l2, 1e-12), 0.0)
    f, code = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(code)) if gain[f, code] > 1e-9 else (-1, 0)


def _taken(tree: list[Node], s: Settings) -> tuple[list[int], list[int]]:
    """Nodes that leaf-wise growth splits, in order, and the unprepared ones whose children it needs to know to go on."""
    leaves, order, ahead = {0}, [], []
    while len(leaves) < s.num_leaves:
        open_ = [i for i in leaves if tree[i].split]
        if not open_:
            break
        best = max(open_, key=lambda i: (tree[i].split[0], -i))
        if tree[best].left < 0:
            # Growth stops here until this node's children are known; the next best leaves are prepared in the same pass.
            room = s.num_leaves - len(leaves)
            ahead = [i for i in sorted(open_, key=lambda i: (-tree[i].split[0], i)) if tree[i].left < 0][:room]
            break
        order.append(best)
        leaves = (leaves - {best}) | {tree[best].left, tree[best].right}
    return order, ahead


def _finished(tree: list[Node], cuts: list[np.ndarray], s: Settings) -> tuple[list, np.ndarray, Tree]:
    """The grown tree without the nodes prepared in vain: over codes, leaf values, and over feature values."""
    kept, todo = [0], [i for i, n in enumerate(tree) if n.left >= 0] if s.symmetric else _taken(tree, s)[0]
    for i in todo:
        kept += [tree[i].left, tree[i].right]
    number = {n: j for j, n in enumerate(kept)}
    inner = set(todo)
    shape, values, thresholds = [], np.zeros(len(kept)), np.zeros(len(kept))
    for j, i in enumerate(kept):
        node = tree[i]
        if i in inner:
            _, f, code = node.split
            shape.append((f, code, number[node.left], number[node.right]))
            thresholds[j] = cuts[f][code] if code < len(cuts[f]) else np.inf
        else:
            shape.append((-1, 0, -1, -1))
            values[j] = -s.learning_rate * node.total[0] / (node.total[1] + s.l2) if node.total[1] + s.l2 > 0 else 0.0
    feature, _, left, right = (np.array(x) for x in zip(*shape))
    return shape, values, Tree(feature, thresholds, left, right, np.array([tree[i].total[2] for i in kept]), values)


def bin_cuts(df: DataFrame, features: list[str], max_bin: int) -> list[np.ndarray]:
    """Cut values of every feature: its quantiles, each once (few distinct values: every one of them)."""
    probs = [i / max_bin for i in range(1, max_bin)]
    one = df.agg(*[F.percentile_approx(F.nanvl(col(f).cast("double"), F.lit(None)), probs, 20 * max_bin).alias(f"c{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(one[f"c{i}"] or [], float)) for i in range(len(features))]


def fit(df: DataFrame, features: list[str], label: str, classes: list | None = None, settings: Settings | None = None) -> Boosted:
    """Fit an ensemble: values, or ``classes`` (two: log-loss; more: softmax) when given.

    Rows with a missing label, or one that is not in ``classes``, are left out;
    missing features are a code of their own. An empty table gives an ensemble of
    no trees.
    """
    s = settings or Settings()
    y = col(label).cast("double") if classes is None else sum((F.when(col(label).cast("string") == str(c), F.lit(float(i))).otherwise(0.0) for i, c in enumerate(classes)), F.lit(0.0))
    if classes is not None:
        df = df.where(col(label).cast("string").isin([str(c) for c in classes]))
    kind, k = ("values", 1) if classes is None else ("two", 1) if len(classes) == 2 else ("many", len(classes))
    if kind == "values":
        start = df.agg(F.avg(F.nanvl(y, F.lit(None)))).first()[0]
        base = np.array([start or 0.0])
        empty = start is None
    else:
        shares = {int(r["y"]): r["count"] for r in df.groupBy(y.alias("y")).count().collect()}
        n = sum(shares.values())
        p = np.array([(shares.get(i, 0) + 1e-9) / (n + 1e-9) for i in range(len(classes))])
        base, empty = (np.array([np.log(p[1] / p[0])]) if kind == "two" else np.log(p)), not n
    if empty:
        return Boosted(features, [[] for _ in range(k)], base, classes)
    cuts = bin_cuts(df, features, s.max_bin)
    data = _Data(df, features, y, kind, k, cuts, base)
    out = Boosted(features, [[] for _ in range(k)], base, classes)
    for _ in range(s.n_estimators):
        grown = [_finished(t, cuts, s) for t in (_grow_symmetric if s.symmetric else _grow)(data, s, k)]
        if all(len(shape) == 1 for shape, _, _ in grown):
            break
        data.add([shape for shape, _, _ in grown], [values for _, values, _ in grown])
        for c, (_, _, tree) in enumerate(grown):
            out.trees[c].append(tree)
    return out


def root_gains(df: DataFrame, features: list[str], label: str, settings: Settings | None = None) -> DataFrame:
    """(feature, cut, gain) of every allowed first split for squared error: what the first tree chooses from."""
    s = settings or Settings()
    y = col(label).cast("double")
    base = np.array([df.agg(F.avg(F.nanvl(y, F.lit(None)))).first()[0] or 0.0])
    cuts = bin_cuts(df, features, s.max_bin)
    data = _Data(df, features, y, "values", 1, cuts, base)
    hist = data.histograms([[(-1, 0, -1, -1)]], [(0, 0)]).get((0, 0), np.zeros((data.d, data.bins, 3)))
    gain = split_gains(hist, hist[0].sum(axis=0), s)
    rows = [(features[f], float(cuts[f][c]), float(gain[f, c])) for f, c in zip(*np.nonzero(np.isfinite(gain))) if c < len(cuts[f])]
    return df.sparkSession.createDataFrame(rows, "feature string, cut double, gain double")


def predict(model: Boosted, df: DataFrame, keep: list[str], digits: int = 4) -> DataFrame:
    """``__prediction__`` and, for classes, ``prob_<class>`` of every row."""
    m = df.sparkSession.sparkContext.broadcast(model)
    d = len(model.features)
    rows = df.select(F.struct(*[col(c) for c in keep]).alias("keep"), *[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(model.features)])

    def run(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), dtype=float) for i in range(d)], axis=1)
            scores = m.value.scores(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], names=["keep", "s"])

    scored = rows.mapInArrow(run, f"keep {rows.schema['keep'].dataType.simpleString()}, s array<double>")
    kept = [F.col(f"keep.`{c}`").alias(c) for c in keep]
    if model.classes is None:
        return scored.select(*kept, F.col("s")[0].alias("__prediction__"))
    if len(model.classes) == 2:
        p1 = 1 / (1 + F.exp(-F.col("s")[0]))
        probs = [1 - p1, p1]
    else:
        e = F.transform("s", lambda v: F.exp(v - F.array_max("s")))
        whole = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        probs = [e[i] / whole for i in range(len(model.classes))]
    p = F.array(*probs)
    names = F.array(*[F.lit(str(c)) for c in model.classes])
    return scored.select(*kept, names[F.array_position(p, F.array_max(p)).cast("int") - 1].alias("__prediction__"),
                         *[F.bround(p[i], digits).alias(f"prob_{c}") for i, c in enumerate(model.classes)])
