"""Exact Jaccard join over word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct shingle sets (copies of a set
form one row), columns are the shingles. ``link`` finds the groups of documents
that are connected by pairs with ``100 * |x & y| >= percent * |x | y|``:

1. Column pass. Shingles are dealt over column blocks; a block finds the
   columns with one row only. A linked row has at least ``percent`` % of its
   shingles in shared columns, so all other rows are discarded. What a slice of
   the input knows to be shared already is counted there, and a column sends
   one entry a slice at most, however frequent it is.
2. Row blocks. Of two linked rows with ``u`` or fewer shingles each, at most
   ``H = 2 u (100 - percent) / (100 + percent)`` shingles are in one row only.
   If the hash space is cut into ``K > H`` parts, at least ``K - H`` parts
   agree, and the largest of these is among the ``H + 1`` largest parts of
   either row. So rows that share no hash of one of those parts are never
   linked; rows that do are put in one block through a star of edges (not all
   pairs). Blocks larger than a panel are cut into panels.
3. Product. For every block (or pair of panels) a task multiplies the incidence
   matrix with its transpose, column block by column block, discards pairs that
   can no longer reach the overlap that their sizes demand, and returns edges
   of a spanning forest of the linked rows.

The answer is exact up to 64-bit hash equality of shingles and 128-bit equality
of sets; there is no cap on partners or candidates.

Defined cases: null or word-less text: empty set, linked with nothing; fewer
than ``k`` words: the whole sequence is the one shingle; repeated rows and rows
with equal sets are one row of the matrix; a null key is allowed (a group of
null keys only has a null name). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components

#: Bytes of text for each column block, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 9 << 20, 32
#: Most rows, and about the most entries, of a panel.
PANEL_ROWS, PANEL_ENTRIES = 2048, 4_000_000


def _sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted shingles of all texts, how many each has, and a 128-bit name of each set."""
    s, n = c.shingles(*c.words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]), k)
    ends = np.cumsum(n)
    raw = s.tobytes()
    names = [hashlib.blake2b(raw[8 * (e - m):8 * e], digest_size=16).digest() for e, m in zip(ends.tolist(), n.tolist())]
    return s, n, names


def _documents(k: int):
    def run(batches):
        for piece in c.slices(batches):
            _, n, names = _sets(piece.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(n, pa.int64()), pa.array([x if m else None for x, m in zip(names, n)], pa.binary())],
                                             names=["key", "n_shingles", "name"])
    return run


def _columns(k: int, blocks: int):
    """Entries of each slice by column block: a column once, with its row, or without one if several rows of the slice have it."""
    def run(batches):
        for piece in c.slices(batches):
            s, n, names = _sets(piece.column(0).to_pylist(), k)
            _, first = np.unique(np.array([x.hex() for x in names], "S32"), return_index=True)
            first = first[n[first] > 0]
            if not len(first):
                continue
            own = np.repeat(np.arange(len(n)), n)
            keep = np.zeros(len(n), bool)
            keep[first] = True
            s, own = s[keep[own]], own[keep[own]]
            order = np.argsort(s)
            s, own = s[order], own[order]
            new = np.r_[True, s[1:] != s[:-1]]
            at = np.flatnonzero(new)
            size = np.diff(np.r_[at, len(s)])
            shared = np.repeat(size > 1, size)
            credit = np.bincount(own[shared], minlength=len(n))
            s, row, single = s[at], own[at], size == 1
            block = ((s >> c.U64(32)) * c.U64(blocks) >> c.U64(32)).astype(np.int64)
            place = np.cumsum(keep) - 1
            out = {"block": [], "hashes": [], "rows": [], "names": [], "sizes": [], "credit": []}
            packed = np.frombuffer(b"".join(names[i] for i in np.flatnonzero(keep)), "V16")
            sizes, credit = n[keep].astype(np.uint32), credit[keep].astype(np.uint32)
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            home = int(s[0] % c.U64(blocks))  # the block whose task passes the sizes on
            for b in range(blocks):
                x, y = cuts[b], cuts[b + 1]
                if x == y and b != home:
                    continue
                r = np.where(single[x:y], place[row[x:y]], -1)
                used = np.unique(r[r >= 0])
                out["block"].append(b)
                out["hashes"].append(s[x:y].astype(np.uint32).tobytes())  # the low half; the block and its order hold the rest
                out["rows"].append(np.where(r >= 0, np.searchsorted(used, r), -1).astype(np.int32).tobytes())
                out["names"].append(packed[used].tobytes())
                out["sizes"].append(sizes.tobytes() + packed.tobytes() if b == home else b"")
                out["credit"].append(credit.tobytes() if b == home else b"")
            yield pa.RecordBatch.from_pydict({"block": pa.array(out["block"], pa.int32())} | {f: pa.array(out[f], pa.binary()) for f in ("hashes", "rows", "names", "sizes", "credit")})
    return run


def _shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """How many columns of a block each row shares with another row; sizes and slice credits pass through."""
    hashes = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
    rows = [np.frombuffer(x, np.int32) for x in pdf["rows"]]
    names = [np.frombuffer(x, "V16") for x in pdf["names"]]
    base = np.cumsum([0] + [len(x) for x in names])
    h = np.concatenate(hashes)
    r = np.concatenate([np.where(x >= 0, x.astype(np.int64) + b, -1) for x, b in zip(rows, base)]) if rows else np.zeros(0, np.int64)
    every = np.concatenate(names)
    # copies of a set from several slices are one row
    wide = np.frombuffer(every.tobytes(), np.uint64).reshape(-1, 2)
    order = np.lexsort((wide[:, 1], wide[:, 0]))
    fresh = np.r_[True, (wide[order][1:] != wide[order][:-1]).any(axis=1)] if len(order) else np.zeros(0, bool)
    one = np.empty(len(order), np.int64)
    one[order] = np.cumsum(fresh) - 1
    r = np.where(r >= 0, one[r] if len(one) else r, -1)
    by = np.lexsort((r, h))
    h, r = h[by], r[by]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(h)])
    several = np.zeros(len(start), bool)
    if len(start):
        several = (r[start] < 0) | (r[start] != r[start + size - 1])  # marked by a slice, or two different rows
    hit = np.repeat(several, size) & (r >= 0)
    hit[1:] &= ~((h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    n = np.bincount(r[hit], minlength=int(fresh.sum()))
    uniq = every[order][fresh] if len(order) else every
    out = [pd.DataFrame({"name": [x.tobytes() for x in uniq[n > 0]], "shared": n[n > 0].astype(np.int64), "size": 0})]
    for sizes, credit in zip(pdf["sizes"], pdf["credit"]):
        if len(credit):
            m = len(credit) // 4
            out.append(pd.DataFrame({"name": [sizes[4 * m + 16 * i:4 * m + 16 * i + 16] for i in range(m)],
                                     "shared": np.frombuffer(credit, np.uint32).astype(np.int64), "size": np.frombuffer(sizes, np.uint32, count=m).astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def bounds(percent: int, upto: int = 1 << 40) -> list[int]:
    """Size intervals: a linked pair lies in one of them or in two neighbours."""
    b = [1]
    while b[-1] < upto:
        b.append(b[-1] * 100 // percent + 1)
    return b


def _signatures(percent: int):
    edges = np.array(bounds(percent), np.int64)

    def run(batches):
        for piece in c.slices(batches, limit=2 << 20):
            cid = np.array(piece.column(1).to_pylist(), np.int64)
            sets = [np.frombuffer(x, c.U64) for x in piece.column(0).to_pylist()]
            n = np.array([len(x) for x in sets])
            s = np.concatenate(sets)
            own = np.repeat(np.arange(len(n)), n)
            interval = np.searchsorted(edges, n, "right") - 1
            for group in (interval, interval + 1):  # a row takes part with its own interval's group and the next
                most = edges[group + 1] - 1
                differ = 2 * most * (100 - percent) // (100 + percent)
                parts = differ + 1 + np.maximum(1, differ // 4)
                base = np.cumsum(parts) - parts
                slot = base[own] + ((c.mix(s ^ c.U64(0xA0761D6478BD642F)) >> c.U64(32)) * parts[own].astype(c.U64) >> c.U64(32)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                filled = slot[order]
                at = np.flatnonzero(np.r_[True, filled[1:] != filled[:-1]])
                total = int(parts.sum())
                size, digest = np.zeros(total, np.int64), np.zeros(total, c.U64)
                size[filled[at]] = np.diff(np.r_[at, len(filled)])
                digest[filled[at]] = np.add.reduceat(c.mix(s[order] + c.U64(0x8BB84B93962EACC9)), at, dtype=c.U64)
                doc = np.repeat(np.arange(len(n)), parts)
                part = np.arange(total) - base[doc]
                digest = c.mix(digest ^ c.mix(part.astype(c.U64) * c.U64(0x9E3779B97F4A7C15) + group[doc].astype(c.U64)))
                rank = np.lexsort((digest, size, doc))
                from_end = np.cumsum(parts)[doc] - 1 - np.arange(total)  # position from the end inside the row, in ranked order
                keep = from_end <= differ[doc]
                chosen = rank[keep]
                yield pa.RecordBatch.from_pydict({"sig": pa.array(digest[chosen].view(np.int64)), "cid": pa.array(cid[doc[chosen]])})
    return run


def multiply(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, width: int = 2048) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (None: the same rows) are linked, as a boolean matrix.

    Columns that two rows share go through the product in blocks of ``width``,
    frequent ones first; the overlap that a pair can still reach is what it has
    plus the columns that both have left.
    """
    rows = left if right is None else left + right
    n = np.array([len(x) for x in rows], np.int64)
    own = np.repeat(np.arange(len(rows)), n)
    cols, place, df = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    rank = np.empty(len(cols), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(cols))
    keep = df[place] > 1
    place, own = rank[place[keep]], own[keep]
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    m = len(left)
    a, b = (slice(0, m), slice(0, m)) if right is None else (slice(0, m), slice(m, len(rows)))
    need = -(-percent * (n[a][:, None] + n[b][None, :]) // (100 + percent))
    have = np.zeros(need.shape, np.float32)
    rest = np.bincount(own, minlength=len(rows))
    for x in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [x, x + width])
        block = np.zeros((len(rows), width), np.float32)
        block[own[lo:hi], place[lo:hi] - x] = 1
        have += block[a] @ block[b].T
        rest = rest - np.bincount(own[lo:hi], minlength=len(rows))
        if not (have + np.minimum(rest[a][:, None], rest[b][None, :]) >= need).any():
            break
    return have >= need


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` connects: a star for each connected group; columns count on from the rows unless ``same``."""
    m, k = linked.shape
    i, j = np.nonzero(linked)
    if not same:
        j = j + m
    if same:
        off = i != j
        i, j = i[off], j[off]
    if not len(i):
        return []
    label = np.arange(m if same else m + k)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return [(x, y) for x, y in enumerate(label.tolist()) if x != y]


def _products(percent: int):
    def solve(rows):
        """rows: (cid, side, set) of one panel or pair of panels."""
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        if len(left) + len(right) < 2 or not left:
            return []
        same = not right
        names = [r[0] for r in left + right]
        found = multiply([np.frombuffer(r[2], c.U64) for r in left], None if same else [np.frombuffer(r[2], c.U64) for r in right], percent)
        return [(names[x], names[y]) for x, y in forest(found, same)]

    def run(batches):
        open_key, rows, out = None, [], []
        for batch in batches:
            for comp, i, j, side, cid, data in zip(*(batch.column(x).to_pylist() for x in range(6))):
                if (comp, i, j) != open_key:
                    out += solve(rows)
                    open_key, rows = (comp, i, j), []
                rows.append((cid, side, data))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
                out = []
        out = solve(rows)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def panels(rows: DataFrame) -> DataFrame:
    """Rows (cid, comp, n, data) dealt to panels: a block of more than a panel's rows becomes all pairs of its panels."""
    size = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    cut = size.select("comp", F.greatest(F.ceil(F.col("m") / PANEL_ROWS), F.ceil(F.col("w") / PANEL_ENTRIES)).cast("int").alias("g"))
    dealt = rows.join(cut, "comp").withColumn("p", F.pmod(F.xxhash64("cid"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.select("comp", F.least("p", "q").cast("int").alias("i"), F.greatest("p", "q").cast("int").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"), "cid", "data")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id (smallest key of the group) for every row of ``docs``."""
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    kind = frame.schema["key"].dataType.simpleString()
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))

    every = c.save(frame.mapInArrow(_documents(k), f"key {kind}, n_shingles bigint, name binary"), "sets")
    first = every.where("name is not null").groupBy("name").agg(F.min("key").alias("first"))

    # 1. rows with enough shared columns
    entries = frame.select("text").mapInArrow(_columns(k, blocks), "block int, hashes binary, rows binary, names binary, sizes binary, credit binary")
    found = entries.groupBy("block").applyInPandas(_shared, "name binary, shared bigint, size bigint")
    alive = found.groupBy("name").agg(F.sum("shared").alias("shared"), F.max("size").alias("n")).where(f"100 * shared >= {percent} * n")
    alive = c.save(alive.select("name").join(first, "name").select("name", "first"), "alive")

    # their sets, from the texts of one document each
    def sets(batches):
        for piece in c.slices(batches):
            s, n, names = _sets(piece.column(0).to_pylist(), k)
            ends = np.cumsum(n)
            want = [i for i, (x, y) in enumerate(zip(names, piece.column(1).to_pylist())) if x == y and n[i]]
            yield pa.RecordBatch.from_pydict({"name": pa.array([names[i] for i in want], pa.binary()), "n": pa.array([int(n[i]) for i in want], pa.int64()),
                                              "data": pa.array([s[ends[i] - n[i]:ends[i]].tobytes() for i in want], pa.binary())})

    # a merge join at every size: ``alive`` grows with the input and must not become a broadcast on small ones
    texts = frame.join(alive.hint("merge"), frame["key"].eqNullSafe(alive["first"])).select("text", "name")
    rows = texts.mapInArrow(sets, "name binary, n bigint, data binary").dropDuplicates(["name"])
    rows = c.save(rows.withColumn("cid", F.monotonically_increasing_id()), "rows")

    # 2. blocks of rows
    sigs = rows.select("data", "cid").mapInArrow(_signatures(percent), "sig bigint, cid bigint")
    sigs = c.save(sigs, "signatures")
    hubs = sigs.groupBy("sig").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub != last").select("sig", "hub")
    stars = sigs.join(hubs, "sig").where("cid != hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    block = components(stars).select(F.col("node").alias("cid"), F.col("component").alias("comp"))

    # 3. products
    dealt = panels(rows.join(block, "cid").select("cid", "comp", "n", "data"))
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = components(dealt.mapInArrow(_products(percent), "a bigint, b bigint"))

    # names of the groups
    linked = links.join(rows.select(F.col("cid").alias("node"), "name"), "node").join(first, "name").select("name", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    group = linked.join(least, "component").select("name", "least")
    # written, so that the last join has a plain exchange on both sides and a name with many copies can be split
    named = c.save(first.join(group, "name", "left").select("name", F.coalesce("least", "first").alias("component_id")), "named")
    out = every.join(named, "name", "left").select("key", "n_shingles", F.when(F.col("name").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, but of each linked group only the one with the smallest key (of equal keys, the first row)."""
    rows = c.save(docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    frame = rows.select(F.struct(F.col(f"row.`{key}`").isNull().alias("unnamed"), F.col(f"row.`{key}`").alias("key"), "number").alias("place"), F.col(f"row.`{text}`").alias("text"))
    stay = link(frame, "place", "text", k, percent).where("place = component_id").select(F.col("place.number").alias("number"))
    return rows.join(stay, "number").select("row.*")
