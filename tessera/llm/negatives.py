"""Hard negatives by a vertical scan of the dimensions (BOND).

Scores are integer inner products of vectors whose components are scaled and
floored. Anchors are dealt to tiles of bounded size, all rows to a fixed number
of strips; a task takes the anchors of a tile and streams the rows of a strip
past them, an Arrow batch at a time. In a batch the components lie column by
column. For an anchor, columns are read in order of falling magnitude of its
own components, a few at a time. After each step the least and greatest values
of the columns still to come bound every row's final score, and the bitmap of
candidates loses the rows that can no longer matter:

* positives (same label): rows whose upper bound is below the k-th best score
  known, from earlier batches or from the lower bounds of this one;
* negatives (other labels): rows whose bounds miss every score window of the
  anchor's positives, a window being narrowed by the best rows it already has.

What is left after the last column has an exact score. Each strip hands on the
best few rows of an anchor, so that what is merged grows with the anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Anchors a task holds at a time.
TILE = 4096
_MOST = (1 << 63) - 1


def clean(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows that take part, one for each vec_id: (vec_id, label, v)."""
    fit = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fit)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def _columns(lists: pa.Array, scale: int, dims: int | None = None) -> np.ndarray:
    """Scaled and floored components, a row of the result for each dimension; shorter vectors end in zeros."""
    flat = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * scale)
    sizes = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
    width = max(int(sizes.max(initial=0)), dims or 0)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ascontiguousarray(out.T)


def _whole(x: np.ndarray) -> np.ndarray:
    """Python integers, for components whose products a double cannot hold exactly."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


class Batch:
    """Rows of one Arrow batch, by columns, with the least and greatest value of each column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low = columns.min(axis=1, initial=np.inf) if columns.size else np.zeros(len(columns))
        self.high = columns.max(axis=1, initial=-np.inf) if columns.size else np.zeros(len(columns))
        self.size = float(max(abs(self.low).max(initial=0), abs(self.high).max(initial=0)))

    def scan(self, q: np.ndarray, rows: np.ndarray, alive, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Rows among ``rows`` that ``alive(lower, upper)`` keeps to the end, with their exact scores."""
        dims = min(len(q), len(self.columns))
        q, columns, low, high = q[:dims], self.columns, self.low[:dims], self.high[:dims]
        exact = float(abs(q).max(initial=0)) * self.size * max(dims, 1) < 2.0 ** 52
        if not exact:
            q, columns, low, high = _whole(q), _whole(columns[:dims]), _whole(low), _whole(high)
        order = np.argsort(-abs(q), kind="stable")
        order = order[:np.count_nonzero(q)]
        a, b = q[order] * low[order], q[order] * high[order]
        rest_low = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
        score = np.zeros(len(rows), dtype=columns.dtype)
        for at in range(0, len(order), step):
            own = order[at:at + step]
            part = columns[own] if len(rows) == columns.shape[1] else columns[np.ix_(own, rows)]
            score = score + q[own] @ part
            end = min(at + step, len(order))
            keep = alive(score + rest_low[end], score + rest_high[end])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


def _best(found: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ``n`` first of ``found`` and the new rows: higher scores first, ties by smaller id; as (-score, id)."""
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.sort(scores)[-n])
        at = at[np.argsort(ids[at], kind="stable")]
        at = at[np.argsort(-scores[at], kind="stable")][:n]
        scores, ids = scores[at], ids[at]
    return sorted([*found, *zip((-int(s) for s in scores), (int(i) for i in ids))])[:n]


class Positives:
    """The best other rows of an anchor's label."""

    def __init__(self, row: dict, q: np.ndarray, n: int):
        self.id, self.label, self.q, self.n, self.found = row["anchor_id"], row["label"], q, n, []

    def see(self, batch: Batch) -> None:
        rows = np.flatnonzero((batch.labels == self.label) & (batch.ids != self.id))
        least = -self.found[-1][0] if len(self.found) == self.n else None

        def alive(lower, upper):
            keep = np.ones(len(upper), bool) if least is None else upper >= least
            if len(lower) > self.n:
                keep &= upper >= np.sort(lower)[-self.n]
            return keep.astype(bool)

        rows, scores = batch.scan(self.q, rows, alive)
        self.found = _best(self.found, scores, batch.ids[rows], self.n)

    def rows(self):
        yield self.id, self.label, None, self.found


class Negatives:
    """For each positive of an anchor, the best rows of other labels inside its score window."""

    def __init__(self, row: dict, q: np.ndarray, n: int, low: int, high: int):
        self.id, self.label, self.q, self.n = row["anchor_id"], row["label"], q, n
        self.windows = [[p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100, []] for p in row["positives"]]

    def see(self, batch: Batch) -> None:
        bounds = []
        for _, _, least, most, found in self.windows:
            least = max(least, -found[-1][0]) if len(found) == self.n else least
            if least <= most:
                bounds.append((least, most))
        if not bounds:
            return

        def alive(lower, upper):
            keep = np.zeros(len(upper), bool)
            for least, most in bounds:
                keep |= ((upper >= least) & (lower <= most)).astype(bool)
            return keep

        rows, scores = batch.scan(self.q, np.flatnonzero(batch.labels != self.label), alive)
        for w in self.windows:
            least = max(w[2], -w[4][-1][0]) if len(w[4]) == self.n else w[2]
            own = np.flatnonzero((scores >= least) & (scores <= w[3]))
            w[4] = _best(w[4], scores[own], batch.ids[rows[own]], self.n)

    def rows(self):
        for i, score, _, _, found in self.windows:
            if found:
                yield self.id, i, score, found


def _stream(make, scale: int, out: pa.Schema):
    """Task body: rows sorted by group, a group's anchors before its rows."""

    def lines(anchors):
        got = [r for a in anchors for r in a.rows()]
        if got:
            a, b, s, found = zip(*got)
            clip = [[{"score": max(-_MOST, min(_MOST, -x)), "id": i} for x, i in f] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, s, clip), out)], schema=out)

    def run(batches):
        group, anchors = None, []
        for batch in batches:
            g = np.stack([np.asarray(batch.column(x)) for x in ("tile", "strip")])
            kind = np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((g[:, 1:] != g[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(at, end - at)
                if group != (now := tuple(g[:, at])):
                    yield from lines(anchors)
                    group, anchors = now, []
                columns = _columns(part.column("v"), scale)
                if kind[at] == 0:
                    given = part.select(["anchor_id", "label", "positives"]).to_pylist()
                    anchors += [make(row, columns[:, i].copy()) for i, row in enumerate(given)]
                elif anchors:
                    rows = Batch(np.asarray(part.column("vec_id")), np.asarray(part.column("label")), columns)
                    for a in anchors:
                        a.see(rows)
        yield from lines(anchors)

    return run


def _meet(anchors: DataFrame, rows: DataFrame, make, scale: int, strips: int, second: str) -> DataFrame:
    """Anchors (tile, anchor_id, label, positives, v) against rows (tile, vec_id, label, v) of the same tile, strip by strip."""
    rows = rows.select("tile", F.pmod(F.xxhash64("vec_id"), F.lit(strips)).cast("int").alias("strip"), F.lit(1).alias("kind"), "vec_id",
                       F.lit(None).cast("bigint").alias("anchor_id"), "label", F.lit(None).cast("array<struct<score: bigint, id: bigint>>").alias("positives"), "v")
    anchors = anchors.select("tile", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("vec_id"),
                             "anchor_id", "label", "positives", "v")
    dealt = anchors.unionByName(rows).repartition("tile", "strip").sortWithinPartitions("tile", "strip", "kind", "label", "vec_id")
    found = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
    out = pa.schema([("anchor_id", pa.int64()), (second, pa.int64()), ("positive_score", pa.int64()), ("found", found)])
    return dealt.mapInArrow(_stream(make, scale, out), f"anchor_id bigint, {second} bigint, positive_score bigint, found array<struct<score: bigint, id: bigint>>")


def _first(n: int) -> Column:
    """The ``n`` first of all ``found`` lists of a group: higher scores first, ties by smaller id."""
    every = F.flatten(F.collect_list("found"))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct((-x["score"]).alias("order"), x["id"].alias("id"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: F.struct((-x["order"]).alias("score"), x["id"].alias("id")))


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
         strips: int = 16, tile: int = TILE) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) -> hard negatives of every anchor and positive.

    Rows for which ``anchor`` (over vec_id, label) holds are anchors. An anchor's
    positives are its ``positives`` best other rows of its label; for each, the
    ``negatives`` best rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score`` are returned: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a component that is null or (scaled)
    not finite, take no part. A vec_id on several rows counts once, with the
    smallest (label, vector). Vectors of unequal length are compared as if the
    shorter ended in zeros. Scores are exact at any magnitude; one beyond a long
    counts as the nearest long. No rows, no anchors or no positives give no
    rows. Other columns are not read. ``strips`` and ``tile`` set how the work is
    dealt, never the result.
    """
    rows = c.save(clean(vectors, scale), "vectors")
    chosen = rows.where(anchor)
    none = F.lit(None).cast("array<struct<score: bigint, id: bigint>>").alias("positives")
    # Positives: only rows of one label meet. A label's anchors fill as many tiles as their number asks for, and its rows go to each of them.
    tiles = chosen.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    name = F.xxhash64("label", "tile").alias("tile")
    own = chosen.join(tiles, "label").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("tiles")).cast("int"))
    own = own.select(name, F.col("vec_id").alias("anchor_id"), "label", none, "v")
    others = rows.join(tiles, "label").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(name, "vec_id", "label", "v")
    found = _meet(own, others, lambda row, q: Positives(row, q, positives), scale, strips, "label")
    best = found.groupBy("anchor_id").agg(_first(positives).alias("positives")).where(F.size("positives") > 0)
    best = c.save(chosen.join(best.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "anchors")
    # Negatives: every tile of anchors meets all rows.
    n = max(-(-best.count() // tile), 1)
    own = best.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n)).alias("tile"), F.col("vec_id").alias("anchor_id"), "label", "positives", "v")
    every = rows.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("tile"), "vec_id", "label", "v")
    found = _meet(own, every, lambda row, q: Negatives(row, q, negatives, low, high), scale, strips, "positive_id")
    out = found.groupBy("anchor_id", "positive_id", "positive_score").agg(_first(negatives).alias("found"))
    return out.select("*", F.posexplode("found").alias("place", "negative")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score"))
