"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

``tokenise`` cuts documents into pieces of at most ``capacity`` tokens.
``pack`` gives every piece a sequence and a place in it. Pieces that fill a
sequence alone need no search. The others are dealt by a unique number into
blocks of about ``block_pieces`` pieces, so that no task holds more, whatever
the input. Every block is searched by ``islands`` populations in tasks of
their own: the crossover copies whole well-filled bins of one parent into the
other, removes the bins that now hold copies of the same pieces, and puts the
displaced pieces back best fit, longest first. After each epoch an island sends
its elite to the next island of the block (one small shuffle); after the last,
the best solution of a block is kept. Then the bins of every block that are
badly filled are opened once more and their pieces dealt over fewer blocks, for
``rounds`` rounds, so that the loss at the edge of a block shrinks as well.

Defined cases: a null or empty text is one piece with the end token alone;
repeated rows are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import re
import weakref
import zlib
from array import array
from bisect import bisect_left, insort
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CAPACITY = 4096
END_ID = 1
#: Distinct white-space separated strings whose ids a worker remembers while it packs, and their bytes.
CACHE, CACHE_BYTES = 650_000, 128 << 20


#: Classes of bytes: letters, stop and comma, white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b".,"]] = 2
_CLASS[[*c.SPACE]] = 4
#: Letters and a run of marks behind them: the tokenizer takes each as a word of its own.
_MARKED = re.compile(rb"([a-z]+)([!-&(-/:;=?@\[-`{-~]+)")


def _byte_letters() -> dict[int, int]:
    """The letters that a byte-level vocabulary writes bytes as: printable ones as they are, the rest from U+0100 up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(rest)}


class _Known(dict):
    """Ids of strings, and their bytes. A new string is learnt when it is asked for; one that the last generation knew is carried over."""

    def __init__(self, learn, before=None):
        self.learn, self.before, self.size = learn, before or {}, 0
        self.held = before.size if before else 0

    def __missing__(self, w: bytes) -> bytes:
        ids = self.before.get(w)
        if ids is None:
            ids = self.learn()(w)
        self.size += 200 + len(w) + len(ids)  # two objects and a place in the table beside their bytes
        self[w] = ids
        return ids


class Encoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so
    a text's ids are those of its white-space separated strings; each distinct
    one is looked up once while it stays in the cache, which is bounded in strings
    and bytes and which a worker keeps until it runs another kind of task. The cache
    is two generations: when the younger has half of the bound, the older is given up,
    so that strings in use are not learnt anew. New strings of letters, with marks or
    at most one full stop or comma behind them, go to the vocabulary's own merges as one
    word and their marks; all others are encoded alone.
    """

    def __init__(self, path: str, cache: int = CACHE, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tok, self.cache, self.cache_bytes = Tokenizer.from_file(path), cache, cache_bytes
        self.known = _Known(weakref.WeakMethod(self._learn))  # no circle: an encoder given up is freed at once
        self.model, self.letters = self.tok.model, _byte_letters()
        self.tails = {t: np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ".,"} | {"": b""}

    def _word(self, word: str) -> bytes:
        as_letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(as_letters)]).tobytes()

    @staticmethod
    def _strings(texts: list[str | None]):
        """White-space separated strings of each text; where no control string can arise, in lower case, and a stop or comma between a letter and white space apart."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        plain = [b"" if b"<|" in r else r for r in raw]
        a = np.frombuffer(b"\n".join([*plain, b""]).lower(), np.uint8)
        kind = _CLASS[a]
        final = np.flatnonzero((kind[1:-1] == 2) & (kind[:-2] == 1) & (kind[2:] == 4)) + 1
        begin = np.cumsum([0] + [len(r) + 1 for r in plain])
        begin = (begin + np.searchsorted(final, begin)).tolist()
        data = np.insert(a, final, 32).tobytes()
        for r, at, end in zip(raw, begin, begin[1:]):
            yield r.split() if b"<|" in r else data[at:end].split()

    def _learn(self, w: bytes) -> bytes:
        if w.isalpha():  # letters of ASCII
            return self._word(w.lower().decode("ascii"))
        marked = _MARKED.fullmatch(w)
        if marked:
            return self._word(marked[1].decode("ascii")) + self.known[marked[2]]
        s = w.decode("utf-8", "replace")
        low = s.lower()
        tail = low[-1] if low[-1] in ".," else ""
        core = low[:-1] if tail else low
        if core.isalpha() and (core.isascii() or s.isascii() or core.islower() and "\u03a3" not in s and max(core) < "\u0250" and is_normalized("NFC", s)):
            return self._word(core) + self.tails[tail]
        return array("I", self.tok.encode(s, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.cache // 2 or self.known.size > self.cache_bytes // 2:
            self.known.before = {}
            self.known = _Known(self.known.learn, self.known)
        ids, end = self.known.__getitem__, np.array([END_ID], "<u4").tobytes()
        return [b"".join([*map(ids, ws), end]) for ws in self._strings(texts)]

    @property
    def size(self) -> int:
        """Bytes of the cached strings and ids, about."""
        return self.known.size + self.known.held


def tokenise(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces: key, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        name = f"encoder {tokenizer_path}"
        pieces = c.slices(batches, keep=name)
        encoder = c.hold(name, lambda: Encoder(tokenizer_path))
        for part in pieces:
            keys, rows, step = [], [], 4 * capacity
            for i, ids in enumerate(encoder.encode(part.column(0).to_pylist())):
                for p, at in enumerate(range(0, len(ids), step)):
                    own = ids[at:at + step]
                    keys.append(i)
                    rows.append((p, at // 4, len(own) // 4, zlib.crc32(own), *[np.frombuffer(own, "<i4")] * with_ids))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(keys)), *(pa.array(v, t) for v, (_, t) in zip(cols, fields))], names=["key", *(n for n, _ in fields)])

    frame = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return frame.mapInArrow(run, schema).withColumnRenamed("key", key)


def best_fit(items: np.ndarray, sizes: np.ndarray, capacity: int, bins: list[list[int]], free: list[int]) -> None:
    """Put ``items``, longest first, each into the open bin that it leaves least room in."""
    order = items[np.argsort(-sizes[items], kind="stable")]
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            f, b = room.pop(at)
        else:
            f, b = capacity, len(bins)
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] = f - s
        if f > s:
            insort(room, (f - s, b))


def as_bins(assigned: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(assigned, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(assigned[order])) + 1)


def fitness(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean of the squared fill of the bins; a higher one packs better."""
    fill = np.bincount(assigned, weights=sizes)
    fill = fill[fill > 0] / capacity
    return float((fill ** 2).mean()) if len(fill) else 1.0


def rebuild(bins, free, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Child of two packings: well-filled bins of ``b`` go into ``a`` whole."""
    fill = np.bincount(b, weights=sizes) / capacity
    want = (fill >= 0.98) & (rng.random(len(fill)) < rng.uniform(0.2, 0.8))
    taken = want[b]  # pieces that come with the injected bins
    spoiled = np.zeros(a.max() + 1, bool)
    spoiled[a[taken]] = True
    weak = np.bincount(a, weights=sizes, minlength=len(spoiled)) / capacity < rng.uniform(0.8, 0.99)
    spoiled |= weak  # the worst bins of the receiver are opened as well
    loose = np.flatnonzero(spoiled[a] & ~taken)
    bins, free = [], []
    for own, keep in ((b, taken), (a, ~taken & ~spoiled[a])):
        at = np.flatnonzero(keep)
        if len(at):
            for group in as_bins(own[at]):
                items = at[group]
                bins.append(items.tolist())
                free.append(capacity - int(sizes[items].sum()))
    best_fit(loose, sizes, capacity, bins, free)
    return rebuild(bins, free, len(a))


def first_packing(sizes: np.ndarray, capacity: int, rng, exact: bool) -> np.ndarray:
    """Best fit, longest first; for variety with some of the pieces put in first in random order."""
    bins, free, every = [], [], np.arange(len(sizes))
    if not exact:
        early = rng.permutation(len(sizes))[:len(sizes) // 10]
        for i in early.tolist():
            best_fit(np.array([i]), sizes, capacity, bins, free) if not bins else _drop(i, sizes, capacity, bins, free)
        every = np.setdiff1d(every, early)
    best_fit(every, sizes, capacity, bins, free)
    return rebuild(bins, free, len(sizes))


def _drop(i: int, sizes, capacity, bins, free) -> None:
    """Put one piece into the last bin if it fits there, else into a new one."""
    s = int(sizes[i])
    if free[-1] >= s:
        bins[-1].append(i)
        free[-1] -= s
    else:
        bins.append([i])
        free.append(capacity - s)


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], capacity: int, rng, population: int, children: int) -> list[np.ndarray]:
    """A population after ``children`` crossovers, best first; ``seeds`` are immigrants."""
    least = -(-int(sizes.sum()) // capacity)
    pool = [(fitness(x, sizes, capacity), x) for x in seeds]
    while len(pool) < population:
        x = first_packing(sizes, capacity, rng, exact=not pool)
        pool.append((fitness(x, sizes, capacity), x))
    pool.sort(key=lambda x: -x[0])
    for _ in range(children):
        if len(np.unique(pool[0][1])) <= least:
            break  # no packing has fewer bins
        i, j = rng.choice(len(pool), 2, replace=False)
        x = crossover(pool[min(i, j)][1], pool[max(i, j)][1], sizes, capacity, rng)
        f = fitness(x, sizes, capacity)
        if f > pool[-1][0]:
            pool[-1] = (f, x)
            pool.sort(key=lambda x: -x[0])
    return [x for _, x in pool]


def _epoch(capacity, population, children, seed):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        block, island = (int(x) for x in key)
        items = items.sort_values("uid")
        sizes = items["length"].to_numpy(np.int64)
        if not len(sizes):
            return pd.DataFrame({"block": [], "island": [], "packing": []}).astype({"block": "int64", "island": "int32", "packing": object})
        seeds = [np.frombuffer(x, np.int32) for x in sorted(elites["packing"])]
        rng = np.random.default_rng([seed, block, island, len(seeds)])
        pool = evolve(sizes, seeds, capacity, rng, population, children)
        return pd.DataFrame({"block": [block], "island": [island], "packing": [pool[0].tobytes()]})
    return run


def _settle(capacity):
    def run(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid").reset_index(drop=True)
        if not len(items):
            return items.assign(bin=[], offset=[], fill=[]).astype({"bin": "int32", "offset": "int64", "fill": "int64"})[["uid", "block", "length", "bin", "offset", "fill"]]
        sizes = items["length"].to_numpy(np.int64)
        best = max((np.frombuffer(x, np.int32) for x in sorted(elites["packing"])), key=lambda x: fitness(x, sizes, capacity))
        order = np.argsort(best, kind="stable")
        total = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(best[order]) != 0]
        start = total[first][np.cumsum(first) - 1]
        out = items.iloc[order][["uid", "block", "length"]].copy()
        out["bin"], out["offset"] = best[order], total - start
        out["fill"] = np.bincount(best, weights=sizes).astype(np.int64)[best[order]]
        return out
    return run


def _search(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, children: int, seed: int) -> DataFrame:
    """Best packing of every block: uid, block, length, bin, offset, fill."""
    spread = items.select("uid", "block", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = items.sparkSession.createDataFrame([], "block bigint, island int, packing binary")
    kept = None
    for e in range(epochs):
        found = c.save(spread.groupBy("block", "island").cogroup(elites.groupBy("block", "island"))
                       .applyInPandas(_epoch(capacity, population, children, seed + e), "block bigint, island int, packing binary"), "elites")
        kept = found
        moved = found.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        elites = found.unionByName(moved) if islands > 1 else found
    return items.groupBy("block").cogroup(kept.groupBy("block")).applyInPandas(_settle(capacity), "uid bigint, block bigint, length bigint, bin int, offset bigint, fill bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = 4096, islands: int = 2, epochs: int = 2, population: int = 4,
         children: int = 12, rounds: int = 2, good_fill: float = 0.999, seed: int = 1) -> DataFrame:
    """All columns of ``pieces`` (it must have ``length``) and sequence_id, offset."""
    taken = {"uid", "block", "bin", "fill", "offset", "sequence_id"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names that packing needs")
    # written with its numbers, so that a lost executor cannot number it anew
    numbered = c.save(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = numbered.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = numbered.where(F.col("length") < capacity).select("uid", "length")
    placed = [whole]
    for r in range(rounds):
        n = left.count()
        blocks = max(1, -(-n // block_pieces))
        items = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(r)), F.lit(blocks)))
        found = c.save(_search(items, capacity, islands, epochs, population, children, seed + 100 * r), "packed")
        last = r == rounds - 1 or blocks == 1
        done = found if last else found.where(F.col("fill") >= int(good_fill * capacity))
        # sequence numbers: round, block and bin side by side
        placed.append(done.select("uid", (F.lit(r).cast("bigint") * (1 << 60) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        left = found.where(F.col("fill") < int(good_fill * capacity)).select("uid", "length")
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    return numbered.join(every, "uid").drop("uid")
