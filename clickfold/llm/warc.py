"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent zstd frames of whole records, then a
skippable frame with the record index (record -> frame, offset and length
inside the decompressed frame), then the seek table of the zstd seekable
format as footer: a reader takes the table from the end of the file and
decompresses only the frames that it needs.

Of records with equal payloads the one with the largest page id is written
as response, the others as revisits that refer to it. Payloads are matched
by SHA-256 on the side, without the pages; the pages then meet their few
marks by (page id, SHA-256), keys that do not pile up.

Bundles are written by Spark's text writer, one row per file, so its commit
protocol covers lost executors. It ends each row with a separator; the
separator here is the end of the seek table itself (its last three bytes,
EA 92 8F, are one UTF-8 character), which makes every file a valid bundle.

Defined cases: null html is an empty payload; a null url gives no target
header. Control characters in urls are percent-encoded. Rows with equal page
id and payload are equal records; if they hold the largest id of their group
all are responses. A null page id is smaller than every other; records
without one revisit the group's response, or are responses if no id is left.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.llm.common import scratch
from clickfold.session import ensure_checkpoint_dir

# --- fixed values: zstd seekable format -------------------------------------
SKIPPABLE, SEEK_TABLE = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
ROW_END = "꒏"  # UTF-8: the last three bytes of the magic number as stored
# -----------------------------------------------------------------------------
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean_url(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(raw: bytes) -> dict:
    """The fields of one record; its payload digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None,
    }


class Bundle:
    """Collects records into frames; `close` gives the finished bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[int | None, int, int, int]] = []  # page, frame, offset, length
        self.open = bytearray()
        self.size = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id, len(self.frames), len(self.open), len(raw)))
        self.open += raw
        if len(self.open) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        index = self.compressor.compress(json.dumps(self.index).encode())
        index = struct.pack("<II", SKIPPABLE, len(index)) + index
        sizes = [*self.sizes, (len(index), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, index, struct.pack("<II", SEEK_TABLE, len(table)), table])


class BundleReader:
    """Reads single records of a bundle by way of its seek table."""

    def __init__(self, content: bytes):
        self.content = content
        n, _, magic = struct.unpack_from("<IBI", content, len(content) - 9)
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        entries = list(struct.iter_unpack("<II", content[len(content) - 9 - 8 * n : len(content) - 9]))
        self.frames, at = [], 0
        for size, plain in entries:
            self.frames.append((at, size, plain))
            at += size
        start, size, _ = self.frames.pop()
        self.reader = zstandard.ZstdDecompressor()
        self.index = [tuple(x) for x in json.loads(self.reader.decompress(content[start + 8 : start + size]))]
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            start, size, plain = self.frames[k]
            self.held = k, self.reader.decompress(self.content[start : start + size], max_output_size=plain)
        return self.held[1]

    def records(self, wanted: set[int] | None = None) -> Iterator[dict]:
        for page_id, k, offset, length in self.index:
            if wanted is None or page_id in wanted:
                yield parse_record(self.frame(k)[offset : offset + length])


def _bundles(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)
        out = lambda b: pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], names=["bundle"])
        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                bundle.add(page.as_py(), record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py()))
                if bundle.size + len(bundle.open) >= bundle_bytes:
                    # the writer adds the last three bytes
                    yield out(bundle.close()[:-3])
                    bundle = Bundle(frame_bytes)
        if bundle.index:
            yield out(bundle.close()[:-3])

    return run


def write_archives(
    pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> None:
    """Write one WARC record per row of `pages` (page_id, url, html) as bundles
    under `path`. Payloads below `min_revisit_bytes` are all responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("key", F.unhex(F.sha2("payload", 256)))
    slim = scratch(rows.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "key"), "payload-keys")
    again = slim.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = scratch(again.drop("n"), "payload-groups")
    marks = slim.join(again, "key").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    marks = marks.select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to").distinct()
    on = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k"))
    records = rows.join(marks, on, "left").select("page_id", "url", "payload", "refers_to")
    bundles = records.mapInArrow(_bundles(frame_bytes, bundle_bytes), "bundle binary")
    bundles.select(F.col("bundle").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", ROW_END).text(path)


def read_archives(spark: SparkSession, path: str, *, page_ids: set[int] | None = None, payloads: bool = False) -> DataFrame:
    """Records of the bundles under `path` (only those of `page_ids`, if given;
    frames without one are not decompressed), with url and payload on request."""
    names = [x.split()[0] for x in RECORD.split(", ")] + (["url", "payload"] if payloads else [])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = list(BundleReader(content.as_py()).records(page_ids))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD + (", url string, payload binary" if payloads else ""))


PLACE = "page_id long, file string, frame_start long, frame_bytes long, frame_plain long, offset long, length long"


def record_places(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of the archives under `path` lies: file, its frame's
    place and sizes, and the record's place in the decompressed frame. Save it
    beside the archives; `read_record` needs nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PLACE.split(", ")]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = BundleReader(content.as_py())
                rows = [(page, file, *reader.frames[k], offset, length) for page, k, offset, length in reader.index]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_PLACE_TYPES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PLACE)


_PLACE_TYPES = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in PLACE.split(", ")])


def read_record(spark: SparkSession, places: DataFrame, page_id: int) -> list[dict]:
    """The records of a page, read by range: one file is opened and one frame
    decompressed for each."""
    sc = spark.sparkContext
    jvm = sc._jvm
    out = []
    for r in places.where(F.col("page_id") == page_id).orderBy("file", "frame_start", "offset").collect():
        file = jvm.org.apache.hadoop.fs.Path(r["file"])
        stream = file.getFileSystem(sc._jsc.hadoopConfiguration()).open(file)
        try:
            stream.seek(r["frame_start"])
            frame = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, r["frame_bytes"]))
        finally:
            stream.close()
        plain = zstandard.ZstdDecompressor().decompress(frame, max_output_size=r["frame_plain"])
        out.append(parse_record(plain[r["offset"] : r["offset"] + r["length"]]))
    return out


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the session's shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
