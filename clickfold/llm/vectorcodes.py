"""Vector codes: product quantisation in whole numbers.

Each component x becomes floor(256 x); a vector is cut into `parts` equal
consecutive parts, each coded by the nearest of the `entries` of its part's
codebook (squared Euclidean distance, ties to the lower index). Codebooks
start as the vectors with the smallest ids; each round assigns all parts and
replaces every used entry by the componentwise floor of its parts' mean.

Nearest entries are found in the Walsh-Hadamard domain: parts and entries are
zero-padded to a power of two L and transformed in whole numbers, which
scales squared distances by L exactly. Squared differences are added up in
sequency order (most of a smooth part's energy comes first), and an entry is
out once its sum passes the whole distance of the best entry so far. No
floating point is used after the components are rounded down.

A round is one pass over the vectors; tasks return one sum per part and entry
and only the codebooks (`entries` vectors) reach the driver.

Defined cases: rows whose vector is null or holds null, NaN or infinite
components are dropped; a zero or empty vector is coded like any other. Every
vector length has codebooks of its own; a length that `parts` does not divide
is zero-padded to the next multiple. Codebooks start from the smallest
distinct ids (null last; of equal ids the smallest vector); with fewer ids
there are fewer entries. Whole components are clamped to +-2^30 / sqrt(length),
so that no distance can overflow. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import scratch

SCALE = 256
STRIP = 4096
Codebooks = dict[int, np.ndarray]  # vector length -> whole numbers (part, entry, position)


def is_finite(vec: Column) -> Column:
    """Not null, no null, NaN or infinite component."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Whole-number Walsh-Hadamard transform of the last axis (zero-padded to a
    power of two), in sequency order: row i of the matrix changes sign i times."""
    size = 1
    while size < x.shape[-1]:
        size *= 2
    y = np.zeros((*x.shape[:-1], size), x.dtype)
    y[..., : x.shape[-1]] = x
    step = 1
    while step < size:
        pairs = y.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        y = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(y.shape)
        step *= 2
    return y[..., sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Natural (Hadamard) index of each sequency: bit-reversed Gray code."""
    bits = size.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest of `entries` for each row
    of `x`, both given as Walsh-Hadamard transforms; ties to the lower index."""
    n, size = x.shape
    best, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if size == 0:
        return best, error
    for at in range(0, n, STRIP):
        rows = x[at : at + STRIP]
        partial = (rows[:, :1] - entries[None, :, 0]) ** 2
        # whole distance of the entry that looks best so far bounds the rest
        guess = partial.argmin(axis=1)
        bound = ((rows - entries[guess]) ** 2).sum(axis=1)
        r, e = np.nonzero(partial <= bound[:, None])
        total = partial[r, e]
        for c in range(1, size):
            total = total + (rows[r, c] - entries[e, c]) ** 2
            stay = total <= bound[r]
            if not stay.all():
                r, e, total = r[stay], e[stay], total[stay]
        # pairs are in (row, entry) order: the first of the smallest wins
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        low = np.minimum.reduceat(total, starts)
        hits = np.flatnonzero(total == np.repeat(low, np.diff(starts, append=len(r))))
        first = hits[np.flatnonzero(np.diff(r[hits], prepend=-1))]
        best[at : at + STRIP], error[at : at + STRIP] = e[first], low // size
    return best, error


def whole(vectors: pa.Array, parts: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Per vector length: row numbers, length, whole components (row, part, position)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    dims = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(dims)])
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        most = math.floor((1 << 30) / math.sqrt(max(d, 1)))
        x = np.clip(np.floor(flat[starts[at][:, None] + np.arange(d)] * SCALE), -most, most).astype(np.int64)
        yield at, d, cut(x, parts)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def _seeds(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The starting codebooks: smallest distinct ids of each length."""
    sized = rows.select("id", F.size("vec").alias("dims"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = (t if held is None else pa.concat_tables([held, t])).group_by(["dims", "id"]).aggregate([])
            order = held.sort_by([("dims", "ascending"), ("id", "ascending")])  # null last
            dims = order.column("dims").to_numpy()
            place = np.arange(len(dims)) - np.searchsorted(dims, dims)
            held = order.filter(pa.array(place < entries)).select(["id", "dims"])
        if held is not None:
            yield from held.to_batches()

    # at most `entries` ids per task and length
    few = scratch(sized.mapInArrow(smallest, sized.schema), "code-seeds").distinct()
    out: Codebooks = {}
    for dims in sorted(r["dims"] for r in few.select("dims").distinct().collect()):
        ids = few.where(F.col("dims") == dims).orderBy(F.col("id").asc_nulls_last()).limit(entries)
        match = F.col("id").eqNullSafe(F.col("seed"))
        mine = rows.where(F.size("vec") == dims).join(F.broadcast(ids.select(F.col("id").alias("seed"))), match, "left_semi")
        found = mine.groupBy("id").agg(F.min("vec").alias("vec")).orderBy(F.col("id").asc_nulls_last()).select("vec").toArrow()
        for _, _, x in whole(found.column("vec"), parts):
            out[dims] = x.transpose(1, 0, 2).copy()
    return out


def _round(rows: DataFrame, books: Codebooks, parts: int) -> Codebooks:
    """Assign all parts, then move every used entry to its floored mean."""
    spectra = {d: hadamard(b) for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((b.shape[0], b.shape[1], b.shape[2] + 1), np.int64) for d, b in books.items()}
        for batch in batches:
            for _, d, x in whole(batch.column(0), parts):
                for p in range(parts):
                    e, _ = nearest(hadamard(x[:, p]), spectra[d][p])
                    order = np.argsort(e, kind="stable")
                    used, starts = np.unique(e[order], return_index=True)
                    counted = np.concatenate([x[order, p], np.ones((len(e), 1), np.int64)], axis=1)
                    sums[d][p, used] += np.add.reduceat(counted, starts, axis=0)
        for d, s in sums.items():
            p, e = np.nonzero(s[..., -1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), d), pa.int32()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(s[p, e].tolist(), pa.list_(pa.int64()))],
                names=["dims", "part", "entry", "sums"],
            )

    found = rows.select("vec").mapInArrow(run, "dims int, part int, entry int, sums array<long>")
    spread = found.select("dims", "part", "entry", F.posexplode("sums").alias("place", "x"))
    totals = spread.groupBy("dims", "part", "entry", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = {d: b.copy() for d, b in books.items()}
    held: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in totals.collect():  # as many numbers as the codebooks hold
        held.setdefault((r["dims"], r["part"], r["entry"]), {})[r["place"]] = int(r["x"])
    for (d, p, e), s in held.items():
        width = out[d].shape[2]
        out[d][p, e] = [s[i] // s[width] for i in range(width)]
    return out


def fit(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2
) -> Codebooks:
    """Codebooks per vector length, learned from all vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(is_finite(F.col("vec")))
    books = _seeds(rows, parts, entries)
    for _ in range(rounds):
        books = _round(rows, books, parts)
    return books


def digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16
) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) per usable vector: one byte
    per part as hex digits, and the sum of the parts' squared distances."""
    spectra = {d: hadamard(b) for d, b in books.items()}
    digests = {d: digest(b) for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, sha = np.empty(batch.num_rows, object), np.empty(batch.num_rows, object)
            error = np.zeros(batch.num_rows, np.int64)
            for at, d, x in whole(batch.column(2), parts):
                codes = np.empty((len(at), parts), np.uint8)
                for p in range(parts):
                    codes[:, p], e = nearest(hadamard(x[:, p]), spectra[d][p])
                    error[at] += e
                code[at] = [c.tobytes().hex() for c in codes]
                sha[at] = digests[d]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error), pa.array(sha, pa.string())],
                names=["id", "label", "code", "error", "codebooks_sha256"],
            )

    ids, labels = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    picked = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(is_finite(F.col("vec")))
    out = picked.mapInArrow(run, f"id {ids}, label {labels}, code string, error long, codebooks_sha256 string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("label", label_col)


def with_label_error(coded: DataFrame, *, label_col: str = "label") -> DataFrame:
    """Adds `label_error`, the error summed over rows of equal label (nulls
    together; null where the sum exceeds a long)."""
    coded = scratch(coded, "codes")
    sums = scratch(coded.groupBy(F.col(label_col).alias("__label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")
