"""Helpers shared by the operators of this subpackage.

* ``save``: write a DataFrame as Parquet below the cluster's shared folder
  (``spark.checkpoint.dir``) and read it again: lineage is cut at files that
  survive the loss of an executor.
* ``slices`` / ``words``: walk Arrow batches in slices of bounded size and
  hash their words with a few vectorised passes.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The six white-space bytes that separate words (fixed values of the word rule ``[^\x20\x09-\x0D]+``).
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text handled at a time inside a task.
SLICE = 512 << 10
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(d)
    return d


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lets Spark remove the shuffle files of a statement when that statement is over.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from task to task, by name (see ``hold``).
_held: dict[str, object] = {}


def hold(name: str, make):
    """``make()``, kept in this worker for further tasks that pass ``keep=name`` to ``slices``."""
    if name not in _held:
        _held[name] = make()
    return _held[name]


def release(keep: str | None = None) -> None:
    """Give up what the worker holds but for ``keep``, and hand unused memory back to the system.

    Workers outlive their tasks and stages; without this, what one stage needed
    would count against the memory of all later ones.
    """
    for name in [n for n in _held if n != keep]:
        del _held[name]
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a C library that can
        pass


def slices(batches, column: int = 0, limit: int = SLICE, keep: str | None = None):
    """Arrow batches cut into pieces whose ``column`` holds about ``limit`` bytes (one row at least).

    Before the first and after the last piece, the worker releases what it does not need.
    """
    release(keep)
    try:
        yield from _cut(batches, column, limit)
    finally:
        release(keep)


def _cut(batches, column: int, limit: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        sizes = np.frombuffer(col.buffers()[1], np.int32 if str(col.type) in ("string", "binary") else np.int64,
                              count=batch.num_rows + 1 + col.offset)[col.offset:].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps, dtype=U64)
    return got[:n]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, times ``_INV ** start``, are polynomial hashes of byte ranges."""
    out = np.zeros(len(a) + 1, U64)
    np.cumsum(_BYTE[a] * powers(_BASE, len(a)), out=out[1:], dtype=U64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)``."""
    return mix((prefix[end] - prefix[start]) * powers(_INV, len(prefix))[start])


def _piece_words(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[a].astype(np.int8), prepend=1, append=1))
    return range_hash(prefix_hash(a), edge[0::2], edge[1::2])


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the number of words of each text.

    The texts of a slice are hashed together; a longer text goes through in
    pieces that end at white space, so that memory stays near eight bytes a word.
    """
    small = [t if t is not None and len(t) <= SLICE else b"" for t in texts]
    data = b" ".join([*small, b""])
    a = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[a].astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    h = range_hash(prefix_hash(a), start, end) if len(start) else np.zeros(0, U64)
    begin = np.cumsum([0] + [len(t) + 1 for t in small])
    at = np.searchsorted(start, begin)
    n = np.diff(at)
    if any(t is not None and len(t) > SLICE for t in texts):
        parts, n = [], n.copy()
        for i, t in enumerate(texts):
            if t is not None and len(t) > SLICE:
                own = _long_words(t)
                n[i] = len(own)
                parts.append(own)
            else:
                parts.append(h[at[i]:at[i + 1]])
        h = np.concatenate(parts)
    return h, n.astype(np.int64)


def _long_words(t: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(t):
        end = at + SLICE
        if end < len(t):
            while end < len(t) and t[end] not in SPACE:
                end += 1
        out.append(_piece_words(t[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingles(h: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingle hashes of each text, sorted inside it, and how many each has.

    A text with words but fewer than ``k`` of them has its whole sequence as one shingle.
    """
    doc = np.repeat(np.arange(len(n)), n)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            s += h[j:len(h) - k + 1 + j] * powers(0xC2B2AE3D27D4EB4F, k)[j]
        own = doc[:len(s)]
        inside = own == doc[k - 1:]
        s, own = mix(s[inside]), own[inside]
    else:
        s, own = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.cumsum(n) - n
        extra = np.array([_short(h[first[i]:first[i] + n[i]]) for i in short], U64)
        s, own = np.concatenate([s, extra]), np.concatenate([own, short])
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[keep], np.bincount(own[keep], minlength=len(n))


def _short(h: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([(h * powers(0xC2B2AE3D27D4EB4F, len(h))).sum(dtype=U64) + U64(len(h)) * U64(0x165667B19E3779F9)], U64))[0]
