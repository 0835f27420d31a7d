"""Embedding near-dedup by int8 tile products with quantisation bounds.

Every distinct vector is scaled to length 1 and quantised to int8 codes with
a scale of its own; the length of the difference is its error e. For two
vectors x, y and their codes a, b: |x.y - a.b| <= e_x + (1 + e_x) * e_y. The
vectors are dealt into blocks of about BLOCK, every pair of blocks is one
tile in one task. A tile multiplies the codes (whole numbers, exact in single
precision) and compares the products with the threshold minus the bound;
pairs that the bound already settles are links, and only pairs that it leaves
open are computed again from the original vectors in double precision.

A tile returns, per vector, how many vectors it links to and the root of a
spanning forest, not the links, so groups of near copies never expand into
pairs. Equal vectors are one entry with a count.

Defined cases: a vector that is null, zero, or holds null, NaN or infinite
components, or whose id is null, links with nothing; its component is its
own id. Vectors of different lengths never link. Rows with equal id and
vector count as one vector and get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.llm.common import connected_components, join_labels, scratch, shuffle_partitions

BLOCK = 4096
STRIP = 256
#: Single-precision products of int8 codes stay whole numbers up to this many dimensions.
EXACT_DIMS = (1 << 24) // (127 * 127)
SLACK = 1e-6  # rounding of the scaled products, far above what it can be
TILE = "node long, n_links long, root long"


def is_usable(vec: Column) -> Column:
    """Not null, finite in every component, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for tiny and huge values."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error (length of the difference) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = x - codes * scale[:, None]
    return codes, scale, np.sqrt((rest * rest).sum(axis=1)) + 1e-12


class Side:
    """One block of a tile: codes for the products, unit vectors for the pairs left open."""

    def __init__(self, node: np.ndarray, n: np.ndarray, vectors: np.ndarray):
        self.node, self.n = node, n
        self.vector = unit(vectors) if len(vectors) else vectors
        codes, self.scale, self.err = quantise(self.vector)
        self.codes = codes.astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of code rows (as float32, or float64 for many dimensions)."""
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    return sum((a[:, i : i + EXACT_DIMS] @ b[:, i : i + EXACT_DIMS].T).astype(np.float64) for i in range(0, a.shape[1], EXACT_DIMS))


def strip_links(a: Side, rows: slice, b: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i in a, j in b) with cosine >= threshold, i from `rows`."""
    g = products(a.codes[rows], b.codes) * a.scale[rows, None].astype(np.float32)
    g *= b.scale[None, :].astype(np.float32)
    worst_a, worst_b = a.err[rows].max(), b.err.max()
    i, j = np.nonzero(g >= threshold - (worst_a + (1 + worst_a) * worst_b) - SLACK)
    value = g[i, j].astype(np.float64)
    i = i + rows.start
    bound = a.err[i] + (1 + a.err[i]) * b.err[j] + SLACK
    linked = value - bound >= threshold
    open_ = np.flatnonzero(~linked & (value + bound >= threshold))
    for at in range(0, len(open_), 65536):
        part = open_[at : at + 65536]
        linked[part] = np.einsum("ij,ij->i", a.vector[i[part]], b.vector[j[part]]) >= threshold
    return i[linked], j[linked]


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dims, lo, hi = (x.as_py() for x in key)
        own, node, n = (table.column(c).to_numpy() for c in ("own", "node", "n"))
        vectors = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

        def side(block: int) -> Side:
            at = np.flatnonzero(own == block)
            return Side(node[at], n[at], vectors[at].astype(np.float64))

        a = side(lo)
        b = a if lo == hi else side(hi)
        na = len(a.node)
        nodes = a.node if a is b else np.concatenate([a.node, b.node])
        weights = a.n if a is b else np.concatenate([a.n, b.n])
        shift = 0 if a is b else na
        counts, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for at in range(0, na if len(b.node) else 0, STRIP):
            i, j = strip_links(a, slice(at, min(na, at + STRIP)), b, threshold)
            if a is b:
                i, j = i[i < j], j[i < j]
            j = j + shift
            np.add.at(counts, i, weights[j])
            np.add.at(counts, j, weights[i])
            join_labels(labels, i, j)
        hit = np.flatnonzero(counts)
        return pa.table({"node": nodes[hit], "n_links": counts[hit], "root": nodes[labels[hit]]})

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked directly, smallest id
    reachable over links, and whether that is the row's own id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    usable = is_usable(F.col("vec")) & F.col("id").isNotNull()
    classes = rows.where(usable).groupBy("vec").agg(F.min("id").alias("least"), F.count_distinct("id").alias("n"))
    # written once, so the entry numbers hold
    classes = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    blocks = max(1, -(-classes.count() // BLOCK))
    # vectors travel as they are given; a tile quantises its two blocks itself
    coded = classes.select("node", "n", F.size("vec").alias("dims"), "vec")
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = coded.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
    tiles = dealt.repartition(shuffle_partitions(spark), "dims", "lo", "hi").groupBy("dims", "lo", "hi")
    found = scratch(tiles.applyInArrow(_tile(threshold), TILE), "vector-links")
    links = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    parts = parts.select(F.col("node").alias("member"), "component")
    named = scratch(
        classes.join(links, "node", "left").join(parts, F.col("node") == F.col("member"), "left").select(
            F.col("vec").alias("class_vec"), "least", F.coalesce("component", "node").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "vector-parts",
    )
    heads = scratch(named.groupBy("component").agg(F.min("least").alias("component_id")), "vector-heads")
    by_vec = scratch(named.join(heads, "component").select("class_vec", "n_links", "component_id"), "vector-results")
    linked = rows.where(usable).join(by_vec, F.col("vec") == F.col("class_vec")).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
