"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling

COLUMNS = "doc_id bigint, text string, word string, run int, n int, key string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute(rows, least_length, least_n, ratio, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = None if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h is not None and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    form, near = {}, {}
    for w in n:
        near[w] = [x for x in n if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(30)]
    texts = [" ".join(rng.choice(stems[:rng.randint(1, 30)]).title() for _ in range(60)) for _ in range(40)]
    texts += [None, "", "12 !!", "×÷ËÿÀÀ ABCabc", "x" * 5000, "aaaaaa" * 3 + "\n" + "aaaaab " * 9, "𝒳abcabc𝒳 abcabca"]
    return [*enumerate(texts), (3, texts[3]), (3, texts[3]), (None, texts[5])]


@pytest.mark.parametrize("arguments", [(6, 5, 5, 199), (4, 1, 2, 3), (6, 2, 3, 10 ** 9)])
def test_groups_equal_brute_force(spark, rows, arguments):
    docs = spark.createDataFrame([(i, t, "w", 1, 2, None) for i, t in rows], COLUMNS)
    got = [tuple(r) for r in spelling.group_variants(docs, *arguments).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(rows, *arguments)
    assert len(got) == len(want) and set(got) == want
    assert len(want) > 10


def test_chain_of_forms(spark):
    """Forms of forms lead to one root, also over many steps."""
    words = ["a" * (6 + i) for i in range(6)]
    docs = spark.createDataFrame([(i, " ".join([w] * 3 ** (5 - i))) for i, w in enumerate(words)], "doc_id bigint, text string")
    got = {r.word: (r.form, r.root) for r in spelling.group_variants(docs, 6, 1, 3, 10 ** 9).collect()}
    assert got == {w: (words[i - 1] if i else None, words[0]) for i, w in enumerate(words)}


def test_one_bucket_of_anagrams(spark):
    """Hundreds of words of the same letters: whole result, and only near words leave the join."""
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(600)}
    w = spark.createDataFrame([(x, 1) for x in words], "word string, n bigint")
    got = {(r.a, r.b) for r in spelling.near_pairs(w).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


@pytest.mark.parametrize("parts", [(1, 4), (1, 5), (2, 4), (3, 2)])
def test_signatures_cover_two_differences(spark, parts):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(150)})
    w = spark.createDataFrame([(x, 1) for x in words], "word string, n bigint")
    got = {(r.a, r.b) for r in spelling.near_pairs(w, *parts).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_empty_table(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert spelling.group_variants(none).collect() == []
