"""Sums over a block of rows: rows are handed down the tree, never matched with every node."""

from __future__ import annotations

import os
from types import SimpleNamespace

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.operators import boosting as B

TREE = [(0, 5, 1, 2), (1, 3, 3, 4), (-1, 0, -1, -1), (0, 2, 5, 6), (-1, 0, -1, -1), (-1, 0, -1, -1), (-1, 0, -1, -1)]


def _leaf(row):
    at = 0
    while TREE[at][0] >= 0:
        f, code, left, right = TREE[at]
        at = left if row[f] <= code else right
    return at


@pytest.mark.parametrize("n", [0, 1, 300])
def test_rows_of_leaves_and_sums(n):
    r = np.random.default_rng(n)
    codes = r.integers(0, 10, (2, n)).astype(np.uint8)
    leaf = np.array([_leaf(x) for x in codes.T], int)
    assert (B._drop(TREE, codes) == leaf).all()
    got = B._rows_of(TREE, codes, {2, 5})
    assert {i: own.tolist() for i, own in got.items()} == {i: np.flatnonzero(leaf == i).tolist() for i in (2, 5)}
    g, h = r.normal(size=(n, 2)), r.random((n, 2))
    out = {(c, i): np.zeros((2, 10, 3)) for c, i in ((0, 0), (1, 2), (1, 6))}
    B.add_sums(out, [[(-1, 0, -1, -1)], TREE], {0: [0], 1: [2, 6]}, codes, g, h)
    for (c, i), sums in out.items():
        own = np.arange(n) if c == 0 else np.flatnonzero(leaf == i)
        for f in range(2):
            for code in range(10):
                here = own[codes[f, own] == code]
                np.testing.assert_allclose(sums[f, code], [g[here, c].sum(), h[here, c].sum(), len(here)], atol=1e-12)


def test_softmax_derivatives():
    r = np.random.default_rng(1)
    scores, y = r.normal(size=(50, 3)), r.integers(0, 3, 50).astype(float)
    g, h = B._derivatives(scores, y, "many")
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    np.testing.assert_allclose(g, p - np.eye(3)[y.astype(int)])
    np.testing.assert_allclose(h, p * (1 - p) * 1.5)


def test_blocks_are_written_in_small_row_groups(spark):
    """A task reads a row group whole: its size must not follow the number of blocks in a file."""
    rows = [(1, os.urandom(60_000), os.urandom(60_000), os.urandom(60_000)) for _ in range(150)]
    table = B._Data._write(SimpleNamespace(spark=spark, schema=B._Data.schema), spark.createDataFrame(rows, B._Data.schema).coalesce(1))
    (path,) = table.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert meta.num_rows == 150 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 8 << 20
    assert sorted(bytes(r["codes"]) for r in table.collect()) == sorted(r[1] for r in rows)
