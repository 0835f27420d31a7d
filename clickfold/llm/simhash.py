"""SimHash near-dedup over a byte-position inverted index.

Two 64-bit fingerprints that differ in at most d bits share at least 8 - d of
their 8 bytes at the same positions. The index lists fingerprints under the
bytes they hold at given positions; pairs that meet in a posting are tallied
by the number of positions at which their bytes agree, those below the
guaranteed 8 - d are dropped, the rest is verified bit by bit.

A posting under a single (position, byte) would hold 1/256 of all
fingerprints, so postings are keyed by `key_bytes` positions at once: a
family of position sets such that any 4 positions contain one of them (7
pairs, 20 triples or all 70 quadruples). Every pair with 4 shared positions
still meets, in far shorter postings. Wider keys are used for more
fingerprints; the links found are the same for each width. A task lists the
fingerprints that meet under each single (position, byte) and tallies: every
posting adds one to the count of each pair in it.

Equal fingerprints are one index entry. A posting of more than BLOCK entries
is cut into blocks that meet tile by tile, in separate tasks. A task returns
a spanning forest of the links it found, not the links, so groups of copies
never expand into all pairs.

Defined cases: null, empty and blank texts have the zero fingerprint, which
links like any other. Fewer words than a shingle: the whole sequence is the
one shingle. A null id keeps its row and joins its component; it is never
the component's id unless all ids there are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clickfold.llm.common import connected_components, join_labels, scratch, shuffle_partitions
from clickfold.operators.membership import PAGE_BITS, is_set, page_words

SEED = 42
BLOCK = 2048
#: Distinct fingerprints up to which postings of 2 and 3 bytes stay short.
WIDER_AT = {2: 1 << 26, 3: 1 << 34}
CHUNK_ROWS = 50_000
#: Counts of pairs that a task holds at once.
TALLY = 1 << 20
#: Pages (4 kB, 32768 rows of a file) of kept rows that may be broadcast.
BROADCAST_PAGES = 8192


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(starts)
    for at in range(0, n, 65536):
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + 65536], ends[at + k - 1 : at + k - 1 + 65536])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def position_sets(key_bytes: int) -> list[tuple[int, ...]]:
    """Sets of `key_bytes` of the 8 byte positions such that any 4 positions
    contain one of them: the positions fall into few groups, and some group
    (or two neighbouring ones) must hold enough of the 4."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    if key_bytes == 2:
        return [p for g in groups for p in itertools.combinations(g, 2)]
    if key_bytes == 3:
        inside = [g for g in groups if len(g) == 3]
        pairs = [(*p, q) for i, g in enumerate(groups) for p in itertools.combinations(g, 2) for q in groups[(i + 1) % 3]]
        return inside + pairs
    return list(itertools.combinations(range(8), 4))


def _postings(fps: DataFrame, key_bytes: int) -> DataFrame:
    """(slot, bytes, fp): one row per position set, cut into tiles (lo, hi)."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    keys = []
    for slot, positions in enumerate(position_sets(key_bytes)):
        held = F.lit(0).cast("long")
        for p in positions:
            held = F.shiftleft(held, 8).bitwiseOR(byte(p))
        keys.append(F.struct(F.lit(slot).alias("slot"), held.alias("held")))
    rows = fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.slot", "k.held", "fp")
    # postings longer than a block, counted map-side first
    long_ = rows.groupBy("slot", "held").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    long_ = scratch(long_.select(F.col("slot").alias("s"), F.col("held").alias("h"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "long-postings")
    joined = rows.join(long_, (F.col("slot") == F.col("s")) & (F.col("held") == F.col("h")), "left").drop("s", "h")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.coalesce("blocks", F.lit(1))).cast("int")
    cut = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return cut.select("slot", "held", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")


def positional_postings(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index of a chunk: for each of the 8 positions the entries ordered
    by (group, byte there, entry); each entry's place in that order, and
    where its posting ends. Three arrays of 8 rows."""
    bytes_ = fps.view(np.uint8).reshape(-1, 8).T.astype(np.int64)
    order, place, end = (np.empty((8, len(fps)), np.int64) for _ in range(3))
    for p in range(8):
        key = group.astype(np.int64) << 8 | bytes_[p]
        order[p] = np.argsort(key, kind="stable")
        place[p, order[p]] = np.arange(len(fps))
        held = key[order[p]]
        end[p, order[p]] = np.searchsorted(held, held, side="right")
    return order, place, end


def tallied(fps: np.ndarray, group: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group that share at least `least` positional
    bytes. Each posting that an entry is in adds one to its count with every
    later entry of that posting; entries are taken in strips of about
    TALLY counts."""
    order, place, end = positional_postings(fps, group)
    later = end - place - 1
    total = np.cumsum(later.sum(axis=0))
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TALLY, side="right")))
        met = []
        for p in range(8):
            n = later[p, at:to]
            ends = np.cumsum(n)
            others = np.arange(ends[-1]) + np.repeat(place[p, at:to] + 1 - ends + n, n)
            met.append(np.repeat(np.arange(at, to), n) * len(fps) + order[p][others])
        pair, count = np.unique(np.concatenate(met), return_counts=True)
        yield np.divmod(pair[count >= least], len(fps))
        at = to


def near_pairs(fps: np.ndarray, group: np.ndarray, cross: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked pairs inside the runs of equal `group`. Where `cross`
    holds, only pairs of different `own` count."""
    left, right = [np.empty(0, int)], [np.empty(0, int)]
    for i, j in tallied(fps, group, 8 - max_bits):
        hit = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        hit &= ~cross[i] | (own[i] != own[j])
        left.append(i[hit])
        right.append(j[hit])
    return np.concatenate(left), np.concatenate(right)


def _linker(max_bits: int):
    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        slot, held, lo, hi, own, fp = cols
        new = np.ones(len(fp), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (held[1:] != held[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        u, v = near_pairs(fp.view(np.uint64), np.cumsum(new), lo != hi, own, max_bits)
        nodes, at = np.unique(fp, return_inverse=True)
        labels = np.arange(len(nodes))
        join_labels(labels, at[u], at[v])
        moved = np.flatnonzero(labels != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(6)])
            rows += batch.num_rows
            if rows < CHUNK_ROWS:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            # the last tile may go on in the next batch
            same = np.ones(rows, bool)
            for c in cols[:4]:
                same &= c == c[-1]
            cut = rows - int(same.sum())
            if cut:
                yield links([c[:cut] for c in cols])
            held, rows = [[c[cut:] for c in cols]], rows - cut
        if rows:
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def links(fps: DataFrame, *, max_bits: int = 4, key_bytes: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints at `max_bits` or
    fewer differing bits (a spanning forest per tile, not every pair)."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the position sets guarantee a meeting for at most 4 differing bits")
    distinct = fps.select("fp").distinct()
    if key_bytes is None:
        distinct = scratch(distinct, "fingerprints")
        n = distinct.count()
        key_bytes = next((k for k, most in WIDER_AT.items() if n <= most), 4)
    tile = ["slot", "held", "lo", "hi"]
    tiles = _postings(distinct, key_bytes).repartition(shuffle_partitions(fps.sparkSession), *tile)
    return tiles.sortWithinPartitions(*tile).mapInArrow(_linker(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over
    links between fingerprints, the row's own included."""
    fps = scratch(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "simhash")
    parts = connected_components(links(fps, max_bits=max_bits))
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    named = least.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = scratch(named, "fp-components")
    # written first, so that the join below reads plain tables and large components and copies can be split
    heads = scratch(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-heads")
    by_fp = scratch(named.join(heads, "component").select("fp", "component_id"), "fp-heads")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of `docs` per component of near copies: the one with the
    smallest id, a null id last; of equal ids the one with the smallest hash
    of its text, then the first as written.

    Rows are told apart by file and row index, so that only keys and
    fingerprints are written; a table that is not read from files is written
    first. The kept rows are a bitmap per file, applied where the table is
    scanned while it is small enough to broadcast."""

    @F.arrow_udf(LongType())
    def printed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in part], np.uint64).astype(np.int64), pa.int64())

    try:
        place = _row_place(docs)
        docs.select(place)
    except AnalysisException:  # not read from files
        docs = scratch(docs, "simhash-documents")
        place = _row_place(docs)
    rows = docs.select(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"),
        place.alias("place"), printed(F.col(text_col)).alias("fp"),
    )
    rows = scratch(rows, "simhash-rows")
    parts = connected_components(links(rows.select("fp"), max_bits=max_bits))
    # written first, as in near_duplicates; minima are taken map-side
    least = scratch(rows.groupBy("fp").agg(F.min(F.struct("no_id", "id", "hash", "place")).alias("least")), "simhash-least")
    named = least.join(parts, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("head")).select("head.place.file", F.col("head.place.row").alias("row"))
    at = F.col("row") + 1  # the bitmap functions count from 1
    pages = heads.groupBy("file", (F.bitmap_bucket_number(at) - 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    pages = scratch(pages.select(F.col("file").alias("__file"), F.col("page").alias("__page"), page_words(F.col("bits")).alias("__words")), "simhash-kept")
    marked = docs.withColumn("__place", place)
    row = F.col("__place.row")
    kept = is_set(F.col("__words"), row.bitwiseAND(PAGE_BITS - 1).cast("int"))
    on = (F.col("__place.file") == F.col("__file")) & (F.shiftright(row, 15) == F.col("__page")) & kept
    small = pages.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    return marked.join(F.broadcast(pages) if small else pages, on, "left_semi").select(*[docs[c] for c in docs.columns])


def _row_place(docs: DataFrame) -> Column:
    """File and row index of each row of a table read from Parquet files."""
    read = docs.metadataColumn("_metadata")
    return F.struct(read["file_path"].alias("file"), read["row_index"].alias("row"))
