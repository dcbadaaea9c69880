"""Removal of repeated byte strings by blockwise suffix ranks over a difference cover.

``remove_repeats`` removes each byte that lies in a string of ``length`` bytes
which also starts anywhere else, in any document or the same one. A suffix
array of all positions is never held: positions of a difference cover are
ranked first, and only suffixes that the cover cannot tell apart are ranked
further, one bucket at a time.

1. Cover ranks. ``COVER`` holds a residue pair for every distance modulo
   ``PERIOD``, so two equal strings of ``length`` bytes contain, at the same
   offset below ``PERIOD``, a cover position of either document, and from there
   ``length - PERIOD + 1`` equal bytes. These prefixes of the cover's suffixes are
   ranked in buckets (by hash; order between different strings is not needed,
   only equality). A suffix without a tied cover position in its first
   ``PERIOD`` bytes is unique at this depth and is settled.
2. Blockwise suffix buckets. The other suffixes form stretches of text. A
   stretch is cut where the least q-gram hash of the next 256 bytes changes;
   equal strings have equal least hashes and meet in the same bucket. A bucket
   holds bounded bytes of text, ranks its suffixes at depth ``length`` on its
   own and marks the tied ones. What a slice of the input can tie on its own is
   settled there, and a string goes to its bucket once a slice.
3. The marked suffixes of a document become maximal runs of bytes to remove.

Equal texts are one row in all of this and count as repeats of one another.
The result is exact up to 64-bit hash equality of strings.

Defined cases: null text: empty; texts shorter than ``length`` stay whole, also
copies of one another; repeated rows are copies; null keys are allowed; other
columns are ignored.
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

#: A perfect difference set, every distance modulo PERIOD once.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
#: Window (a power of two) and q-gram length of the anchors that choose a suffix bucket.
ANCHOR, GRAM = 256, 16
BLOCK_BYTES, LEAST_BLOCKS = 9 << 20, 32
_EMPTY = hashlib.sha256(b"").hexdigest()


def cover_positions(n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and position of every cover position with ``depth`` bytes behind it, for texts of ``n`` bytes."""
    last = n - depth
    top = int(last.max()) if len(last) else -1
    if top < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pattern = (np.arange(0, top + 1, PERIOD)[:, None] + np.array(COVER)).ravel()
    count = np.searchsorted(pattern, last, "right")
    doc = np.repeat(np.arange(len(n)), count)
    return doc, pattern[np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), n, np.cumsum(n) - n


class _Packed:
    """Rows of one slice for its buckets."""

    fields = ("hashes", "rows", "starts", "counts", "data", "names", "known")

    def __init__(self):
        self.out = {"block": []} | {f: [] for f in self.fields}

    def add(self, block: int, **values) -> None:
        self.out["block"].append(block)
        for f in self.fields:
            v = values.get(f, b"")
            self.out[f].append(v if isinstance(v, bytes) else v.tobytes())

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array(self.out["block"], pa.int32())} | {f: pa.array(self.out[f], pa.binary()) for f in self.fields})

    schema = "block int, " + ", ".join(f"{f} binary" for f in fields)


def _known(names: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    """Runs that a slice has settled, to pass through a bucket's task."""
    out = np.zeros(len(doc), _RUN)
    out["name"], out["start"], out["count"] = names[doc], start, count
    return out.tobytes()


_RUN = np.dtype([("name", "V16"), ("start", "<i8"), ("count", "<i8")])


def _blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> c.U64(32)) * c.U64(blocks) >> c.U64(32)).astype(np.int64)


def _cover_entries(length: int, blocks: int):
    depth = length - PERIOD + 1

    def run(batches):
        for piece in c.slices(batches):
            names, first = np.unique(np.array([x.hex() for x in piece.column(1).to_pylist()], "S32"), return_index=True)
            raw = piece.column(0).to_pylist()
            texts = [raw[i] for i in first if len(raw[i]) >= length]
            if not texts:
                continue
            names = np.frombuffer(bytes.fromhex("".join(x.decode() for x, i in zip(names, first) if len(raw[i]) >= length)), "V16")
            a, n, base = _joined(texts)
            doc, pos = cover_positions(n, depth)
            at = base[doc] + pos
            h = c.range_hash(c.prefix_hash(a), at, at + depth)
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            new = np.r_[True, h[1:] != h[:-1]]
            head = np.flatnonzero(new)
            size = np.diff(np.r_[head, len(h)])
            tied = np.repeat(size > 1, size)
            known = _known(names, doc[tied], pos[tied], np.ones(int(tied.sum()), np.int64))
            h, doc, pos, single = h[head], doc[head], pos[head], size == 1
            cuts = np.searchsorted(_blocks_of(h, blocks), np.arange(blocks + 1))
            home, packed = int(h[0] % c.U64(blocks)), _Packed()
            for b in range(blocks):
                x, y = cuts[b], cuts[b + 1]
                if x == y and b != home:
                    continue
                r = np.where(single[x:y], doc[x:y], -1)
                used = np.unique(r[r >= 0])
                packed.add(b, hashes=h[x:y].astype(np.uint32), rows=np.where(r >= 0, np.searchsorted(used, r), -1).astype(np.int32),
                           starts=pos[x:y].astype(np.uint32), names=names[used], known=known if b == home else b"")
            yield packed.batch()
    return run


def _tied(h: np.ndarray, name: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which of the entries have an equal hash at another place; name -1 marks one that is tied already."""
    order = np.lexsort((pos, name, h))
    s, r, p = h[order], name[order], pos[order]
    if not len(s):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[head, len(s)])
    last = head + size - 1
    several = (r[head] < 0) | (r[head] != r[last]) | (p[head] != p[last])
    out = np.zeros(len(s), bool)
    out[order] = np.repeat(several, size) & (r >= 0)
    return out


def _names_of(columns) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All names, a number for each that equal names share, and where each row's names begin."""
    parts = [np.frombuffer(x, "V16") for x in columns]
    every = np.concatenate(parts) if parts else np.zeros(0, "V16")
    wide = np.frombuffer(every.tobytes(), np.uint64).reshape(-1, 2)
    order = np.lexsort((wide[:, 1], wide[:, 0]))
    one = np.zeros(len(order), np.int64)
    if len(order):
        one[order] = np.cumsum(np.r_[True, (wide[order][1:] != wide[order][:-1]).any(axis=1)]) - 1
    return every, one, np.cumsum([0] + [len(x) for x in parts]).tolist()


def _rows(pdf, every_one, base) -> np.ndarray:
    out = []
    for x, b in zip(pdf["rows"], base):
        r = np.frombuffer(x, np.int32).astype(np.int64)
        out.append(np.where(r >= 0, r + b, -1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _runs(every: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, known) -> pd.DataFrame:
    """(name, runs) rows: runs is packed (start, count) pairs."""
    settled = [np.frombuffer(x, _RUN) for x in known if len(x)]
    runs = np.zeros(len(row), _RUN)
    if len(row):
        runs["name"], runs["start"], runs["count"] = every[row], start, count
    runs = np.concatenate([runs, *settled])
    if not len(runs):
        return pd.DataFrame({"name": pd.Series([], dtype=object), "runs": pd.Series([], dtype=object)})
    wide = np.frombuffer(runs["name"].tobytes(), np.uint64).reshape(-1, 2)
    order = np.lexsort((runs["start"], wide[:, 1], wide[:, 0]))
    runs, wide = runs[order], wide[order]
    head = np.flatnonzero(np.r_[True, (wide[1:] != wide[:-1]).any(axis=1)])
    pairs = np.stack([runs["start"], runs["count"]], axis=1)
    ends = np.r_[head[1:], len(runs)]
    return pd.DataFrame({"name": [runs["name"][i].tobytes() for i in head], "runs": [pairs[x:y].astype("<i8").tobytes() for x, y in zip(head, ends)]})


def _cover_ties(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    every, one, base = _names_of(pdf["names"])
    row = _rows(pdf, one, base)
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]])
    pos = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["starts"]]).astype(np.int64)
    hit = _tied(h, np.where(row >= 0, one[row] if len(one) else row, -1), pos)
    return _runs(every, row[hit], pos[hit], np.ones(int(hit.sum()), np.int64), pdf["known"])


def merged(runs: np.ndarray) -> np.ndarray:
    """Sorted, disjoint [start, stop) rows from any [start, stop) rows."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(runs[:, 1])
    head = np.flatnonzero(np.r_[True, runs[1:, 0] > stop[:-1]])
    return np.stack([runs[head, 0], stop[np.r_[head[1:], len(runs)] - 1]], axis=1)


def _gather(parts) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in parts])


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Least value of each ``window`` (a power of two) consecutive ones."""
    step = 1
    while step < window:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h


def _suffix_entries(length: int, blocks: int):
    """Stretches of suffixes that the cover ties, cut by anchor, for their buckets."""
    def run(batches):
        for piece in c.slices(batches, limit=1 << 20):
            doc, begin, stop, texts = [], [], [], piece.column(0).to_pylist()
            for i, (t, parts) in enumerate(zip(texts, piece.column(2).to_pylist())):
                ties = _gather(parts)[:, 0]
                r = merged(np.stack([np.maximum(ties - PERIOD + 1, 0), np.minimum(ties, len(t) - length) + 1], axis=1)) if len(ties) else np.zeros((0, 2), np.int64)
                r = r[r[:, 1] > r[:, 0]]
                doc += [i] * len(r)
                begin += r[:, 0].tolist()
                stop += r[:, 1].tolist()
            if not doc:
                continue
            copied = np.array(piece.column(3).to_pylist(), bool)
            names = np.frombuffer(b"".join(piece.column(1).to_pylist()), "V16")
            a, n, base = _joined(texts)
            prefix = c.prefix_hash(a)
            starts, counts, rows, bucket = [], [], [], []
            for i, x, y in zip(doc, begin, stop):
                at = base[i] + np.arange(x, y + ANCHOR - 1)
                anchor = _least(c.range_hash(prefix, at, at + GRAM), ANCHOR)
                cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                starts.append(x + cut)
                counts.append(np.diff(np.r_[cut, len(anchor)]))
                rows.append(np.full(len(cut), i))
                bucket.append(anchor[cut])
            start, count, row = np.concatenate(starts), np.concatenate(counts), np.concatenate(rows)
            block = _blocks_of(c.mix(np.concatenate(bucket)), blocks)
            at = base[row] + start
            text_hash = c.range_hash(prefix, at, at + count + length - 1) ^ c.mix(count.astype(c.U64))
            order = np.lexsort((text_hash, block))
            start, count, row, block, text_hash = start[order], count[order], row[order], block[order], text_hash[order]
            head = np.flatnonzero(np.r_[True, text_hash[1:] != text_hash[:-1]])
            size = np.diff(np.r_[head, len(row)])
            tied = np.repeat(size > 1, size)
            known = _known(names, row[tied], start[tied], count[tied])
            several = (size > 1) | copied[row[head]]  # suffixes of a text with copies are tied as well; its rows need no marks
            start, count, row, block = start[head], count[head], row[head], block[head]
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            home, packed = int(text_hash[0] % c.U64(blocks)), _Packed()
            for b in range(blocks):
                x, y = cuts[b], cuts[b + 1]
                if x == y and b != home:
                    continue
                r = np.where(several[x:y], -1, row[x:y])
                used = np.unique(r[r >= 0])
                begin = (base[row[x:y]] + start[x:y]).tolist()
                data = b"".join(a[s:s + k + length - 1].tobytes() for s, k in zip(begin, count[x:y].tolist()))
                packed.add(b, rows=np.where(r >= 0, np.searchsorted(used, r), -1).astype(np.int32), starts=start[x:y].astype(np.int64),
                           counts=count[x:y].astype(np.int64), data=data, names=names[used], known=known if b == home else b"")
            yield packed.batch()
    return run


def _suffix_ties(length: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every, one, base = _names_of(pdf["names"])
        row = _rows(pdf, one, base)
        start = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["starts"]])
        count = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
        hashes, stretch, pos = [], [], []
        at = 0
        for data, k in zip(pdf["data"], pdf["counts"]):
            k = np.frombuffer(k, np.int64)
            if not len(k):
                continue
            prefix = c.prefix_hash(np.frombuffer(data, np.uint8))
            own = np.repeat(np.arange(len(k)), k)
            inside = np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k)
            here = np.repeat(np.cumsum(k + length - 1) - (k + length - 1), k) + inside
            hashes.append(c.range_hash(prefix, here, here + length))
            stretch.append(own + at)
            pos.append(start[own + at] + inside)
            at += len(k)
        if not hashes:
            return _runs(every, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), pdf["known"])
        h, stretch, pos = np.concatenate(hashes), np.concatenate(stretch), np.concatenate(pos)
        r = row[stretch]
        hit = np.flatnonzero(_tied(h, np.where(r >= 0, one[r] if len(one) else r, -1), pos))
        if len(hit):  # neighbours of one stretch become one run
            cut = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (stretch[hit][1:] != stretch[hit][:-1])])
            run_start, run_count = pos[hit[cut]], np.diff(np.r_[cut, len(hit)])
            run_row = r[hit[cut]]
        else:
            run_start = run_count = run_row = np.zeros(0, np.int64)
        return _runs(every, run_row, run_start, run_count, pdf["known"])
    return run


def _apply(length: int):
    """Texts without the bytes that their tied suffixes cover."""
    def run(batches):
        for piece in c.slices(batches):
            out = []
            for t, parts in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist()):
                runs = _gather(parts)
                spans = merged(np.stack([runs[:, 0], runs[:, 0] + runs[:, 1] + length - 1], axis=1))
                kept, at = [], 0
                for x, y in spans.tolist():
                    kept.append(t[at:x])
                    at = y
                out.append((int((spans[:, 1] - spans[:, 0]).sum()), len(spans), b"".join([*kept, t[at:]])))
            removed, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["name", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, with_kept: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay) for every row of ``docs``."""
    if length < ANCHOR + GRAM - 1:
        raise ValueError(f"length must be at least {ANCHOR + GRAM - 1}")
    raw = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    frame = docs.select(raw.alias("text"), F.col(f"`{key}`").alias("key"))
    frame = frame.withColumn("name", F.unhex(F.md5("text")))
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))
    copies = c.save(frame.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("copied")), "copies")

    # 1. cover positions that are tied
    entries = frame.where(F.octet_length("text") >= length).select("text", "name").mapInArrow(_cover_entries(length, blocks), _Packed.schema)
    ties = entries.groupBy("block").applyInPandas(_cover_ties, "name binary, runs binary")
    ties = c.save(ties.groupBy("name").agg(F.collect_list("runs").alias("ties")), "cover")

    # 2. texts with tied positions, one row for each different text; their suffixes by bucket
    texts = frame.where(F.octet_length("text") >= length).select("name", "text").dropDuplicates(["name"])
    texts = c.save(texts.join(ties, "name").join(copies, "name").select("text", "name", "ties", "copied"), "tied-texts")
    entries = texts.mapInArrow(_suffix_entries(length, blocks), _Packed.schema)
    runs = entries.groupBy("block").applyInPandas(_suffix_ties(length), "name binary, runs binary")
    runs = c.save(runs.groupBy("name").agg(F.collect_list("runs").alias("runs")), "suffixes")

    # 3. what stays
    cut = texts.where("not copied").join(runs, "name").select("text", "name", "runs").mapInArrow(_apply(length), "name binary, n_removed bigint, n_spans bigint, kept binary")
    cut = cut.withColumn("cut_sha256", F.sha2("kept", 256))
    if not with_kept:
        cut = cut.drop("kept")
    # written, so that the last join has a plain exchange on both sides and a text with many copies can be split
    verdict = c.save(copies.join(cut, "name", "left"), "verdict")
    whole = frame.select("key", "name", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), *["text"] * with_kept)
    every = whole.join(verdict, "name")
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    out = every.select(F.col("key").alias(key), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                       F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
                       F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha256", "text_sha256")).alias("kept_sha256"),
                       *[F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept")] * with_kept)
    return out
