"""Quality classifier: logistic regression over hashed word n-grams, learnt with FTRL-proximal updates.

A text's words are runs of letters, digits and non-ASCII characters, and runs of
other visible ASCII characters. Words and pairs of neighbouring words are hashed
to ``2 ** bits`` buckets (a word followed by itself is one feature of its own,
whatever the word); a bucket's value is the logarithm of one plus its count,
scaled so that a text's values have length one. One more feature is always one.

Learning: a bounded sample of labelled documents is dealt to ``shards``. In an
epoch, each shard goes through its examples one by one, each example moving the
per-coordinate sums of the follow-the-regularised-leader rule; the shards' sums
are then averaged and are where the next epoch begins. The state has a fixed
size. Scoring is one pass over all documents, a sparse dot product for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

_KIND = np.ones(256, np.int8)
_KIND[33:128] = [1 if chr(i).isalnum() else 2 for i in range(33, 128)]
_KIND[list(c.SPACE)] = 0
_PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner: ``rows`` bounds the labelled documents it reads.

    With ``balance`` both labels count alike in sum, whatever their numbers.
    """

    rows: int = 50_000
    bits: int = 18
    shards: int = 4
    epochs: int = 6
    alpha: float = 8.0
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    balance: bool = True


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and their hashes."""
    a = np.frombuffer(data, np.uint8)
    kind = _KIND[a]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(-1)))
    end = np.append(edge[1:], len(a))
    word = kind[edge] > 0
    start, end = edge[word], end[word]
    return start, c.range_hash(c.prefix_hash(a), start, end) if len(start) else np.zeros(0, np.uint64)


def _pairs(h: np.ndarray) -> np.ndarray:
    out = c.mix(h[:-1] * _PAIR + h[1:])
    out[h[:-1] == h[1:]] = 0
    return out


def _values(counts: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    x = np.log1p(counts)
    return x / np.sqrt(np.bincount(own, x * x, n))[own]


def _long(t: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text longer than a slice, piece by piece."""
    shift, counts, last, at = np.uint64(64 - bits), np.zeros(1 << bits, np.int64), np.zeros(0, np.uint64), 0
    while at < len(t):
        end = min(at + c.SLICE, len(t))
        while end < min(len(t), at + 2 * c.SLICE) and t[end] not in c.SPACE:
            end += 1
        h = _hashes(t[at:end])[1]
        for part in (h, _pairs(np.concatenate([last, h]))):
            counts += np.bincount((part >> shift).astype(np.int64), minlength=1 << bits)
        last, at = h[-1:] if len(h) else last, end
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of ``texts``, one after the other, and how many each text has.

    A text of more than ``common.SLICE`` bytes is read in pieces that end at white
    space; in one without white space, every second slice ends a word.
    """
    small = [t if t is not None and len(t) <= c.SLICE else b"" for t in texts]
    start, h = _hashes(b"\n".join([*small, b""]))
    first = np.cumsum([0] + [len(t) + 1 for t in small])
    own = np.searchsorted(first, start, "right") - 1
    inside = own[1:] == own[:-1]
    shift = np.uint64(64 - bits)
    key = np.concatenate([(own << bits) | (h >> shift).astype(np.int64), (own[1:][inside] << bits) | (_pairs(h)[inside] >> shift).astype(np.int64)])
    key, counts = np.unique(key, return_counts=True)
    own, buckets = key >> bits, key & ((1 << bits) - 1)
    for i, t in enumerate(texts):
        if t is not None and len(t) > c.SLICE:
            more, times = _long(t, bits)
            at = int(np.searchsorted(own, i))
            own, buckets, counts = (np.insert(x, at, y) for x, y in ((own, np.full(len(more), i)), (buckets, more), (counts, times)))
    return buckets, _values(counts, own, len(texts)), np.bincount(own, minlength=len(texts))


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if str(column.type) == "string" else pa.large_binary()).to_pylist()


def weights(z: np.ndarray, n: np.ndarray, how: Ftrl) -> np.ndarray:
    """The regularised leader for gradient sums ``z`` and sums of squares ``n``."""
    return np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))


def update(z: np.ndarray, n: np.ndarray, j: np.ndarray, x: np.ndarray, label: float, how: Ftrl, weight: float = 1.0) -> None:
    """One example, the buckets ``j`` with the values ``x``, counted ``weight`` times."""
    w, old = weights(z[j], n[j], how), n[j]
    g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * weight * x
    n[j] = old + g * g
    z[j] += g - (np.sqrt(n[j]) - np.sqrt(old)) / how.alpha * w


def _examples(docs: DataFrame, labelled: DataFrame, how: Ftrl) -> DataFrame:
    """(shard, turn, label, j, x) of a sample of about ``how.rows`` labelled documents."""
    one = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    one = c.save(one, "labels")
    share = min(1.0, how.rows / max(one.count(), 1))
    sample = one.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    bits = how.bits

    def run(batches):
        for part in c.slices(batches, 3):
            j, x, sizes = features(_raw(part.column(3)), bits)
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(ends, pa.array(j, pa.int32())),
                                              pa.ListArray.from_arrays(ends, pa.array(x, pa.float32()))], names=["shard", "turn", "label", "j", "x"])

    turn = F.xxhash64("doc_id", F.lit(2))
    rows = texts.select(F.pmod(turn, F.lit(how.shards)).cast("int").alias("shard"), turn.alias("turn"), "label", "text")
    return c.save(rows.mapInArrow(run, "shard int, turn bigint, label double, j array<int>, x array<float>"), "examples")


def train(docs: DataFrame, labelled: DataFrame, how: Ftrl = Ftrl()) -> np.ndarray:
    """``docs`` (doc_id, text) and ``labelled`` (doc_id, label: 0 or 1) -> weights of the buckets and of the constant.

    At most about ``how.rows`` labelled documents are read, chosen by a hash of
    their ids. Several labels of one document count by majority (a tie as 1), of
    several rows of one document the smallest text. Null ids and labels are not
    learnt from; without any example all weights are zero.
    """
    size = (1 << how.bits) + 1
    examples = _examples(docs, labelled, how)
    dealt = examples.repartition(how.shards, "shard").sortWithinPartitions("shard", "turn")
    z, n = np.zeros(size), np.zeros(size)
    times = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    counts = [sum(times.values()) / (len(times) * times[k]) if how.balance and k in times else 1.0 for k in (0.0, 1.0)]
    for _ in range(how.epochs):
        got = c.save(dealt.mapInArrow(_epoch(z, n, how, counts), "shard int, z binary, n binary"), "epoch").collect()
        if got:
            z, n = (np.mean([np.frombuffer(r[k], np.float32) for r in sorted(got)], axis=0, dtype=np.float64) for k in ("z", "n"))
    return weights(z, n, how)


def _epoch(z0: np.ndarray, n0: np.ndarray, how: Ftrl, counts: list[float]):
    constant = 1 << how.bits

    def line(shard, z, n):
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})

    def run(batches):
        shard = None
        for batch in batches:
            own, labels = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            j, x = batch.column(3), batch.column(4)
            ends = np.asarray(j.offsets)
            j, x = np.asarray(j.values), np.asarray(x.values)
            for i in range(batch.num_rows):
                if shard != own[i]:
                    if shard is not None:
                        yield line(shard, z, n)
                    shard, z, n = own[i], z0.copy(), n0.copy()
                a, b = ends[i], ends[i + 1]
                update(z, n, np.append(j[a:b], constant), np.append(x[a:b].astype(np.float64), 1.0), labels[i], how, counts[int(labels[i])])
        if shard is not None:
            yield line(shard, z, n)

    return run


def score(docs: DataFrame, w: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``docs`` -> (key, score) of every row: the likelihood of label 1. Null and empty texts have the score of the constant alone."""
    bits = int(len(w) - 1).bit_length() - 1
    w = w.astype(np.float64)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in c.slices(batches, 1):
            j, x, sizes = features(_raw(part.column(1)), bits)
            total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[j] * x, len(sizes)) + w[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether ``folds`` divides the checksum of the key as text (null: of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 0


def classify(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, label) -> doc_id, held_out, score, predicted of every row of ``docs``.

    Labels of held-out ids are not learnt from. Other columns are not read.
    """
    w = train(docs, labels.where(~held_out(F.col("doc_id"))), how)
    out = score(docs.select("doc_id", "text"), w)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
