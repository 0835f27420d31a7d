"""Line dedup: a line found in several documents stays in the smallest one.

Lines become 128-bit hashes of their keys, range-partitioned by (hash,
document, position) and sorted so inside each partition. One pass streams
the sorted rows: the first document of a hash keeps its lines, the others
drop theirs. A frequent line may span many partitions; each partition then
hands on the first document it saw of its outermost hashes, and the lines
of a partition's leading hash are settled against the smallest of these.
The result per document is a compressed bitmap of the lines to keep; texts
take part only when the bitmap is applied.

Defined cases: a null or empty text is one empty line. Rows with a null id
keep all lines and drop none of others. Rows with equal ids are one
document. Keys shorter than `min_chars` code points are never dropped. Other
columns of the input are ignored here and kept by `apply_bitmaps`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from clickfold.llm.common import scratch, shuffle_partitions

BLANKS = b" \t\n\x0b\x0c\r"
LINES = "h1 long, h2 long, doc long, ver long, pos int, n_lines int"
FOUND = "kind int, h1 long, h2 long, doc long, ver long, pos int, n_lines int"
DROP, OPEN, EDGE = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased key; None if shorter than `min_chars` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return key


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, vers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, doc, ver, pos, total = [], [], [], [], []
            for d, v, text in zip(docs, vers, batch.column(2), strict=True):
                lines = text.as_py().encode().split(b"\n")
                n = 0
                for i, line in enumerate(lines):
                    if (key := line_key(line, min_chars)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        pos.append(i)
                        n += 1
                doc += [d] * n
                ver += [v] * n
                total += [len(lines)] * n
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(doc, pa.int64()), pa.array(ver, pa.int64()),
                    pa.array(pos, pa.int32()), pa.array(total, pa.int32()),
                ],
                names=["h1", "h2", "doc", "ver", "pos", "n_lines"],
            )

    return run


def _stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: DROP rows (a line that goes), OPEN rows (a
    line of the leading hash that stays unless an earlier partition holds that
    hash) and EDGE rows (first document seen of the outermost hashes)."""
    names = ["kind", "h1", "h2", "doc", "ver", "pos", "n_lines"]

    def edge(h1: int, h2: int, doc: int) -> pa.RecordBatch:
        row = [EDGE, h1, h2, doc, 0, 0, 0]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    last = None  # (h1, h2, first document) of the hash in progress
    leading = True
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, ver, pos, total = (batch.column(i).to_numpy() for i in range(6))
        starts = np.empty(len(h1), bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts[0] = last is None or (h1[0], h2[0]) != last[:2]
        if last is None:
            yield edge(h1[0], h2[0], doc[0])
        at = np.flatnonzero(starts)
        group = np.cumsum(starts)
        firsts = np.concatenate([[last[2] if last else doc[0]], doc[at]])
        first = firsts[group]
        # the partition's first hash is number 1 in the batch that starts it and 0 in later ones
        lead = (group == (1 if last is None else 0)) if leading else np.zeros(len(h1), bool)
        leading = leading and bool(lead[-1])
        kind = np.where(doc != first, DROP, np.where(lead, OPEN, -1)).astype(np.int32)
        keep = kind >= 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, h1, h2, doc, ver, pos, total)], names=names)
        last = (h1[-1], h2[-1], first[-1])
    if last is not None:
        yield edge(*last)


@F.pandas_udf(BinaryType())
def _bitmap(dropped: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(positions, n):
        keep = np.ones(n, np.uint8)
        keep[positions] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(p, n) for p, n in zip(dropped, n_lines, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _kept_lines(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if b is None:
            return None
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines))
        return "\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, ver, n_dropped, keep_bitmap) for each document that loses lines.
    `ver` is the hash of the text (rows that share an id may differ in text);
    the bitmap is zlib-compressed, one bit per line, 1 = keep."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("ver"), F.col(text_col).alias("text")
    ).where("doc is not null and text is not null")
    lines = scratch(rows.mapInArrow(_hash_lines(min_chars), LINES), "lines")
    order = ["h1", "h2", "doc", "ver", "pos"]
    dealt = lines.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = scratch(dealt.mapInArrow(_stream_first, FOUND), "first-lines")
    edges = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc").alias("holder"))
    settled = found.where(F.col("kind") == OPEN).join(edges, ["h1", "h2"]).where(F.col("holder") < F.col("doc"))
    dropped = found.where(F.col("kind") == DROP).select("doc", "ver", "pos", "n_lines").unionByName(
        settled.select("doc", "ver", "pos", "n_lines")
    )
    # equal rows (same id, same text) carry the same positions: count them once
    per_doc = dropped.groupBy("doc", "ver").agg(F.collect_set("pos").alias("gone"), F.first("n_lines").alias("n_lines"))
    return per_doc.select(
        F.col("doc").alias(id_col), "ver", F.size("gone").cast("long").alias("n_dropped"),
        _bitmap("gone", "n_lines").alias("keep_bitmap"),
    )


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stats_col: str | None = "line_dedup"
) -> DataFrame:
    """`docs` with its text cut to the kept lines and, unless `stats_col` is
    None, a struct column of that name (n_lines, n_dropped). Untouched texts
    stay as they are."""
    marks = bitmaps.select(
        F.col(id_col).alias("__mark_doc"), F.col("ver").alias("__mark_ver"),
        F.col("n_dropped").alias("__mark_dropped"), F.col("keep_bitmap").alias("__mark_bitmap"),
    )
    on = (docs[id_col].cast("long") == F.col("__mark_doc")) & (F.xxhash64(docs[text_col]) == F.col("__mark_ver"))
    joined = docs.join(marks, on, "left")
    text = F.col(text_col)
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    kept = F.when(F.col("__mark_bitmap").isNull(), text).otherwise(
        _kept_lines(F.when(F.col("__mark_bitmap").isNotNull(), text), F.col("__mark_bitmap"))
    )
    stats = F.struct(n_lines.alias("n_lines"), F.coalesce("__mark_dropped", F.lit(0)).cast("long").alias("n_dropped"))
    cut = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*cut, *([stats.alias(stats_col)] if stats_col else []))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, stats_col: str | None = "line_dedup"
) -> DataFrame:
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    return apply_bitmaps(docs, bitmaps, id_col=id_col, text_col=text_col, stats_col=stats_col)
