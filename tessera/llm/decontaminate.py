"""Benchmark passages in documents by q-gram lemma filtering and banded alignment.

An item of ``m`` normalised bytes occurs in a text with at most ``e`` edits
only if the occurrence keeps ``m - q + 1 - q e`` of the item's q-grams, on
diagonals (text position minus item position) that differ by at most ``e``.
Per slice of documents all q-grams are hashed in a few vectorised passes and
looked up in the items' table; the shared ones are counted in bands of
diagonals, each ``2 (e + 1)`` wide and overlapping the next by half, so that one
band holds every kept q-gram of an occurrence. Regions whose count reaches the
bound are aligned with the item inside the band, and stay when the distance is
within the budget. The budget is ``edit_percent`` of the item, or less where the
item is too short for the lemma; items shorter than a q-gram must occur exactly,
between word ends.

Text is compared in lower case with every run of ASCII punctuation or white
space as one space; edits are counted in bytes of that form. The benchmark is
taken in blocks of about ``block_bytes`` bytes, each sent to all tasks by
itself; the documents are never shuffled.

Defined cases: null or empty texts and items match nothing; repeated rows are
reported one by one; null keys are reported as nulls; other columns pass
through ``drop_contaminated`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

Q = 12
_WORD = np.ones(256, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_TABLE_BITS = 22


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Normalised bytes of all texts, each between zero bytes, where each begins, and the lower-case bytes they are from."""
    low = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    a = np.frombuffer(b"\0".join([b"", *(x.replace(b"\0", b" ") for x in low), b""]), np.uint8)
    word = _WORD[a]
    zero = a == 0
    word[zero] = False
    keep = word | zero
    keep[1:] |= word[:-1]
    out = np.where(word | zero, a, 32)[keep].astype(np.uint8)
    return out, np.flatnonzero(out == 0), low


class Items:
    """Q-gram table of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], edit_percent: int):
        self.ids, self.text, self.edits, self.short = [], [], [], []
        grams, owner, place = [], [], []
        for item, text in items:
            a = normal([text])[0][1:-1].tobytes().strip(b" ")
            if not a:
                continue
            if len(a) < Q:
                self.short.append((item, a))
                continue
            x = np.frombuffer(a, np.uint8)
            at = np.arange(len(x) - Q + 1)
            grams.append(c.range_hash(c.prefix_hash(x), at, at + Q))
            owner.append(np.full(len(at), len(self.ids)))
            place.append(at)
            self.ids.append(item)
            self.text.append(x)
            self.edits.append(min(edit_percent * len(x) // 100, (len(x) - Q) // Q))
        self.length = np.array([len(x) for x in self.text], np.int64)
        self.budget = np.array(self.edits, np.int64)
        self.need = self.length - Q + 1 - Q * self.budget
        g = np.concatenate(grams) if grams else np.zeros(0, c.U64)
        order = np.argsort(g, kind="stable")
        self.grams, self.owner, self.place = g[order], np.concatenate(owner)[order] if grams else g.astype(np.int64), np.concatenate(place)[order] if grams else g.astype(np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> c.U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, a: np.ndarray) -> np.ndarray:
        """(item, first diagonal of a band) with enough shared q-grams."""
        if len(a) < Q or not len(self.grams):
            return np.zeros((0, 2), np.int64)
        prefix = c.prefix_hash(a)
        at = np.arange(len(a) - Q + 1)
        h = c.range_hash(prefix, at, at + Q)
        at = np.flatnonzero(self.table[(h >> c.U64(64 - _TABLE_BITS)).astype(np.int64)])
        h = h[at]
        first, last = np.searchsorted(self.grams, h, "left"), np.searchsorted(self.grams, h, "right")
        n = last - first
        at = np.repeat(at, n)
        entry = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        item = self.owner[entry]
        step = self.budget[item] + 1
        band = (at - self.place[entry]) // step
        item, band = np.concatenate([item, item]), np.concatenate([band, band - 1])  # the two bands that hold a diagonal
        order = np.lexsort((band, item))
        item, band = item[order], band[order]
        if not len(item):
            return np.zeros((0, 2), np.int64)
        head = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        count = np.diff(np.r_[head, len(item)])
        item, band = item[head], band[head]
        ok = count >= self.need[item]
        return np.stack([item[ok], band[ok] * (self.budget[item[ok]] + 1)], axis=1)


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int]:
    """Least edits of ``pattern`` against a part of ``text`` whose diagonals lie in ``[low, high]``, and where the part ends.

    Row ``i`` of the band holds the cells of text positions ``i + low .. i + high``;
    starting anywhere in the text is free. (budget + 1, -1) if there is none.
    """
    width, big = high - low + 1, budget + 1
    slope = np.arange(width)
    pos = low + slope
    row = np.where((pos >= 0) & (pos <= len(text)), 0, big)
    padded = np.concatenate([np.full(max(0, -low) + 1, 256), text.astype(np.int64), np.full(len(pattern) + width + 1, 256)])
    shift = max(0, -low) + 1
    for i, ch in enumerate(pattern.tolist()):
        at = i + low + shift
        best = row + (padded[max(at, 0):max(at, 0) + width] != ch)  # step along the diagonal
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # a pattern byte without a text byte
        pos = i + 1 + low + slope
        best = np.where((pos >= 0) & (pos <= len(text)), best, big)
        row = np.minimum(np.minimum.accumulate(best - slope) + slope, big)  # text bytes without a pattern byte
        row = np.where((pos >= 0) & (pos <= len(text)), row, big)
        if row.min() > budget:
            return big, -1
    j = int(row.argmin())
    return int(row[j]), len(pattern) + low + j


def occurrences(items: Items, texts: list[str | None]) -> list[tuple[int, int | None, int, int, int]]:
    """(row, item id, start, stop, edits) with code point positions, sorted."""
    a, zeros, low = normal(texts)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item, diagonal in items.candidates(a).tolist():
        pattern, e = items.text[item], items.edits[item]
        m = len(pattern)
        for row in range(max(0, int(np.searchsorted(zeros, diagonal - e)) - 1), len(zeros) - 1):
            x, y = int(zeros[row]) + 1, int(zeros[row + 1])
            if x > diagonal + 2 * (e + 1) + e:
                break
            if y < diagonal - e + m - e:
                continue
            edits, stop = banded(pattern, a[x:y], diagonal - x - e, diagonal - x + 2 * (e + 1) + e, e)
            if edits > e:
                continue
            back = a[max(x, x + stop - m - e):x + stop][::-1]
            _, size = banded(pattern[::-1], back, 0 - e, e, edits) if edits else (0, m)
            size = size if size > 0 else m
            found.setdefault((row, item), []).append((stop - size, stop, edits))
    out = []
    for (row, item), spans in found.items():
        spans.sort()
        best = [spans[0]]
        for s in spans[1:]:
            if s[0] < best[-1][1]:  # the same occurrence from the neighbouring band
                if s[2] < best[-1][2]:
                    best[-1] = s
            else:
                best.append(s)
        out += [(row, items.ids[item], s, e, k) for s, e, k in best]
    for item, word in items.short:
        needle = b" " + word + b" "
        data = a.tobytes().replace(b"\0", b" \0 ") if items.short else b""
        if needle in data:
            for row in range(len(texts)):
                own = b" " + a[int(zeros[row]) + 1:int(zeros[row + 1])].tobytes() + b" "
                at = own.find(needle)
                while at >= 0:
                    out.append((row, item, at, at + len(word), 0))
                    at = own.find(needle, at + 1)
    return sorted(((row, item, *original(low[row], s, e), k) for row, item, s, e, k in out), key=lambda x: (x[0], x[2], x[3], x[1] is not None, x[1] or 0))


def original(low: bytes, start: int, stop: int) -> tuple[int, int]:
    """Code point positions of normalised bytes ``[start, stop)`` in the lower-case text.

    (Lower case has the length of the text, but for the rare letters that become two.)
    """
    a = np.frombuffer(low.replace(b"\0", b" "), np.uint8)
    word = _WORD[a]
    word[a == 0] = False
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[0] = keep[0] if len(a) else False
    at = np.flatnonzero(keep)
    x, y = int(at[start]), int(at[stop - 1]) + 1
    first = len(low[:x].decode("utf-8", "replace"))
    return first, first + len(low[x:y].decode("utf-8", "replace"))


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple]]:
    """The benchmark in blocks of bounded size, one at a time on the driver."""
    rows = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for b in range(n):
        yield [(r["item"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         edit_percent: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """(key, item, start, stop, edits): every occurrence of a benchmark item in a document."""
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    kinds = frame.schema["key"].dataType.simpleString(), dict(benchmark.dtypes)[item]
    out = None
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        def run(batches, block=block):
            items = Items(block, edit_percent)
            for piece in c.slices(batches):
                hits = occurrences(items, piece.column(0).to_pylist())
                rows = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(1).take(rows), pa.array([h[1] for h in hits], pa.int64()), *(pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3, 4))],
                                                 names=["key", "item", "start", "stop", "edits"])
        part = frame.mapInArrow(run, f"key {kinds[0]}, item bigint, start bigint, stop bigint, edits bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", edit_percent: int = 6,
                      block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item occurs."""
    at = docs.columns.index(text)
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        def run(batches, block=block):
            items = Items(block, edit_percent)
            for piece in c.slices(batches, at):
                clean = np.ones(piece.num_rows, bool)
                clean[[h[0] for h in occurrences(items, piece.column(at).to_pylist())]] = False
                yield piece.filter(pa.array(clean))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
