"""Quality classifier: features and updates against plain loops, accuracy on held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier, common, queries

WORD = re.compile(rb"[0-9A-Za-z\x00-\x08\x0e-\x1f\x80-\xff]+|[!-/:-@\[-`{-~\x7f]+")


def counted(text, bits):
    """Counts by bucket, from the words one by one."""
    h = [int(common.range_hash(common.prefix_hash(a := np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(a)]))[0]) for w in WORD.findall(text.encode())]
    pairs = [0 if a == b else int(common.mix(np.array([a], np.uint64) * classifier._PAIR + np.array([b], np.uint64))[0]) for a, b in zip(h, h[1:])]
    return Counter(x >> (64 - bits) for x in h + pairs)


TEXTS = ["", " \n", "a", "One two, two two!! thrée | $5.00", "the THE the " * 40, "x" * 700, "ünï\x00cöde \x1c ok\nnew line"]


def test_features_equal_plain_counts():
    buckets, values, sizes = classifier.features([None, *[t.encode() for t in TEXTS]], 12)
    ends = np.cumsum(sizes)
    for i, t in enumerate(["", *TEXTS]):
        got = dict(zip(buckets[ends[i] - sizes[i]:ends[i]].tolist(), values[ends[i] - sizes[i]:ends[i]].tolist()))
        want = {k: math.log1p(n) for k, n in counted(t, 12).items()}
        length = math.sqrt(sum(x * x for x in want.values()))
        assert got == pytest.approx({k: x / length for k, x in want.items()})


def test_long_text_in_pieces(monkeypatch):
    """Pieces give the features of the whole, wherever they end."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "b!", "ccc", "d d", "é"]) for _ in range(n)).encode() for n in (5, 400, 3, 900)]
    whole = classifier.features(texts, 10)
    monkeypatch.setattr(common, "SLICE", 64)
    for a, b in zip(whole, classifier.features(texts, 10)):
        assert np.allclose(a, b)


def test_updates_equal_plain_rule():
    rng, how = random.Random(2), classifier.Ftrl(bits=4, alpha=0.7, beta=0.5, l1=0.05, l2=0.3)
    z, n = np.zeros(17), np.zeros(17)
    pz, pn = [0.0] * 17, [0.0] * 17
    for _ in range(60):
        j = sorted(rng.sample(range(17), 4))
        x, y = [rng.uniform(0, 1) for _ in j], rng.choice([0, 1])
        classifier.update(z, n, np.array(j), np.array(x), y, how)
        w = {k: 0.0 if abs(pz[k]) <= how.l1 else -(pz[k] - math.copysign(how.l1, pz[k])) / ((how.beta + math.sqrt(pn[k])) / how.alpha + how.l2) for k in j}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(j, x))))
        for k, v in zip(j, x):
            g = (p - y) * v
            s = (math.sqrt(pn[k] + g * g) - math.sqrt(pn[k])) / how.alpha
            pz[k], pn[k] = pz[k] + g - s * w[k], pn[k] + g * g
    assert np.allclose(z, pz) and np.allclose(n, pn)
    assert (classifier.weights(z, n, how) == 0).any() and (classifier.weights(z, n, how) != 0).any()


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.95), ("sf0.1", 0.99)])
def test_held_out_accuracy(spark, sf, least):
    sf = f"/root/testdata/{sf}"
    got = queries.op11_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    out = got[got.held_out]
    print(sf, len(out), (out.predicted == out.quality).mean(), out[out.quality == 1].predicted.mean())
    assert (out.predicted == out.quality).mean() >= least
    assert out[out.quality == 1].predicted.mean() >= 0.99
    assert (out.predicted == (out.score >= 0.3)).all()
    ranks = out.score.rank()
    n1 = int(out.quality.sum())
    assert (ranks[out.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(out) - n1)) >= least


COLUMNS = "doc_id bigint, text string, score double, label int, shard string, key string"


def test_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") * 3 + ("!!" if i % 2 else "") for _ in range(30)) for i in range(60)]
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[1]), (100, None), (101, ""), (102, "zz " * 3)]
    docs = spark.createDataFrame([(i, t, 9.0, 9, "s", "k") for i, t in rows], COLUMNS)
    labels = spark.createDataFrame([*[(i, (i + 1) % 2) for i in range(50)], (3, 1), (3, 0), (7, None), (None, 1), (999, 0)], "doc_id bigint, label int")
    how = classifier.Ftrl(bits=10, shards=3)
    got = classifier.classify(docs, labels, how).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert by.setdefault(r.doc_id, r) == r and 0 <= r.score <= 1
    assert by[100].score == by[101].score and by[None].score == by[1].score and by[None].held_out
    assert all(by[i].predicted == (i + 1) % 2 for i in range(50, 60))
    again = classifier.classify(docs.repartition(7), labels.repartition(2), how).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # Held-out labels change nothing.
    flipped = labels.withColumn("label", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("label")).otherwise(F.col("label")))
    assert sorted(map(str, classifier.classify(docs, flipped, how).collect())) == sorted(map(str, got))


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert classifier.classify(none, none).collect() == []
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [r.score for r in classifier.classify(docs, none).collect()] == [0.5]


def test_sample_bound(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = classifier._examples(docs, docs.select("doc_id", F.lit(1).alias("label")), classifier.Ftrl(rows=1000)).count()
    assert 850 <= n <= 1150
