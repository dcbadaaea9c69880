"""WARC records in seekable Zstandard bundles.

``write_bundles`` groups records into independent Zstandard frames. A bundle
file holds, in order: the frames, a skippable frame with the index of record
identifiers (identifier, frame number, offset inside the decompressed frame)
and the seek table of the seekable format (a skippable frame with the
compressed and decompressed size of each frame and a fixed footer). Any
Zstandard tool reads the file as one stream; a reader that wants one record
decompresses one frame.

Files are written by Spark's own file writer, so they go to any file system
Spark knows, under its commit protocol: a task that is run again leaves no
second copy. (Each bundle is one row of the text writer; the writer's line end
is set to the magic number that ends a seek table.)

Of records with equal payloads of at least ``min_bytes`` bytes the one with
the smallest identifier is stored as ``response``; the others become
``revisit`` records that carry the digest and refer to it. Equal payloads are
found by SHA-256 with a pre-aggregated minimum, so a payload shared by a third
of all rows costs one aggregated row a task, and the join that brings the
minimum back is an ordinary equi-join that Spark can split when it is skewed.

Defined cases: null payload: empty; null identifier: stored as ``response``
under an empty identifier; repeated identifiers with equal payloads are all
responses; null address: empty; control characters in an address are
percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

# Fixed values of the Zstandard and seekable formats.
SKIP_INDEX = 0x184D2A50
SKIP_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CRLF = b"\r\n"


def with_types(pages: DataFrame, key: str, payload: str, min_bytes: int = 100) -> DataFrame:
    """Adds ``payload`` (binary), ``digest``, ``refers_to`` (null for responses)."""
    raw = F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8") if dict(pages.dtypes)[payload] == "string" else F.col(f"`{payload}`"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").alias("id"), (F.col("`url`") if "url" in pages.columns else F.lit(None)).cast("string").alias("uri"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long_digest", F.when(F.length("payload") >= min_bytes, F.col("digest")))
    first = (rows.where("long_digest is not null").groupBy(F.col("long_digest").alias("of")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and first is not null").select("of", "first"))
    return (rows.join(first, rows.long_digest == first.of, "left")
            .withColumn("refers_to", F.when(F.col("id") != F.col("first"), F.col("first")))
            .select("id", "uri", "payload", "digest", "refers_to"))


def record(rid, uri: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record."""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
        head = [b"WARC-Type: response"]
    else:
        block = b"HTTP/1.1 200 OK\r\nX-Payload-Length: %d\r\n\r\n" % len(payload)
        head = [b"WARC-Type: revisit", b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"WARC-Record-ID: <urn:page:%s>" % (b"" if rid is None else b"%d" % rid), b"WARC-Target-URI: " + quote(uri or "", safe="/:?#[]@!$&'()*+,;=%~").encode(),
             b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(),
             b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return CRLF.join([b"WARC/1.1", *head, b"", block, b"", b""])


def parse_record(data, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = bytes(data[at:end]).split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(b": ", 1) for x in lines[1:])
    start, size = end + 4, int(head[b"Content-Length"])
    return head, bytes(data[start:start + size]), start + size + 4


class Bundle:
    """Collects records into frames of about ``frame_bytes`` bytes."""

    def __init__(self, frame_bytes: int, level: int):
        self.zip, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames, self.sizes, self.index, self.open, self.offset, self.bytes = [], [], [], [], 0, 0

    def add(self, rid, data: bytes) -> None:
        self.index.append((-1 if rid is None else rid, rid is not None, len(self.frames), self.offset))
        self.open.append(data)
        self.offset += len(data)
        if self.offset >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            z = self.zip.compress(b"".join(self.open))
            self.frames.append(z)
            self.sizes.append((len(z), self.offset))
            self.bytes += len(z)
            self.open, self.offset = [], 0

    def seal(self) -> bytes:
        """The whole file."""
        self.flush()
        index = b"".join(struct.pack("<q?II", *x) for x in self.index)
        index = struct.pack("<II", SKIP_INDEX, len(index)) + index
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
        return b"".join([*self.frames, index, struct.pack("<II", SKIP_SEEK, len(table)), table])


class BundleReader:
    """Random access into one bundle."""

    def __init__(self, data: bytes):
        self.data, self.last, self.frame = data, None, b""
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        table = struct.iter_unpack("<II", data[len(data) - 9 - 8 * n:-9])
        self.starts, at = [], 0
        for packed, plain in table:
            self.starts.append((at, packed, plain))
            at += packed
        at, packed, _ = self.starts.pop()
        kind, size = struct.unpack("<II", data[at:at + 8])
        if kind != SKIP_INDEX or size + 8 != packed:
            raise ValueError("no record index before the seek table")
        self.index = list(struct.iter_unpack("<q?II", data[at + 8:at + packed]))

    def at(self, frame: int, offset: int) -> tuple[dict, bytes]:
        if frame != self.last:
            start, packed, plain = self.starts[frame]
            self.frame, self.last = zstandard.ZstdDecompressor().decompress(self.data[start:start + packed], max_output_size=plain), frame
        head, block, _ = parse_record(self.frame, offset)
        return head, block

    def find(self, rid: int) -> list[tuple[dict, bytes]]:
        """All records with this identifier: one frame is decompressed for each."""
        return [self.at(f, o) for r, known, f, o in self.index if known and r == rid]


def write_bundles(rows: DataFrame, path: str, bundle_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, level: int = 3,
                  date: str = "2000-01-01T00:00:00Z") -> str:
    """Write the rows of ``with_types`` as bundles of about ``bundle_bytes`` compressed bytes below ``path``."""
    def run(batches):
        bundle = Bundle(frame_bytes, level)
        for piece in c.slices(batches):
            for r in piece.to_pylist():
                bundle.add(r["id"], record(r["id"], r["uri"], r["payload"], r["digest"], r["refers_to"], date))
                if bundle.bytes >= bundle_bytes:
                    yield pa.RecordBatch.from_pydict({"value": pa.array([bundle.seal()[:-4]], pa.binary())})
                    bundle = Bundle(frame_bytes, level)
        if bundle.index:
            yield pa.RecordBatch.from_pydict({"value": pa.array([bundle.seal()[:-4]], pa.binary())})

    rows = rows.select("payload", F.col("id").cast("bigint").alias("id"), "uri", "digest", F.col("refers_to").cast("bigint").alias("refers_to"))
    end = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path))
    return path


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles below ``path``, fetched through its index entry; digests are verified."""
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, out = BundleReader(data), []
                for rid, known, frame, offset in reader.index:
                    head, block = reader.at(frame, offset)
                    http, payload = block.split(b"\r\n\r\n", 1)
                    kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    refers = head.get(b"WARC-Refers-To")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: payload of record {rid} differs from its digest")
                    size = len(payload) if kind == "response" else int(http.rsplit(b"X-Payload-Length: ", 1)[1])
                    out.append({"id": rid if known else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
                                "refers_to": int(refers[10:-1]) if refers else None, "bundle": name, "frame": frame, "offset": offset})
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[i:i + 10_000], schema=_READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame bigint, `offset` bigint")


_READ = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("offset", pa.int64())])
