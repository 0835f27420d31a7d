"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own, fitted on
a bounded sample (SAMPLE_ROWS rows, the smallest hashes). Every vector is
listed in the cell of its two centroids. A query walks pairs of centroids by
summed distance with a heap until the cells seen hold its share of all rows,
and those rows are reranked by the inner product in double precision.
Largest inner product is nearest distance once every vector is lengthened by
one component that brings all to the same length, so norms may differ.

The share is measured, not guessed: sample rows are searched in the sample
exactly and through the index, and the smallest share whose recall reaches
`target_recall` is used (in a larger table neighbours are nearer, so recall
there is no lower). Vectors without any structure need a large share.

Cells are dealt in order to shards of at most about SHARD_ROWS rows; a larger
cell takes several. Queries go to the shards of their cells; a task reads the
vectors of a shard once and then its queries in blocks.

Defined cases: vectors that are null, zero or hold null or non-finite
components, or whose id is null, take no part, neither as query nor as
candidate. Every vector length is a search of its own with its own index.
Rows with equal id and length count once (smallest vector). Fewer candidates than k: all of them. Equal scores: the
smaller id first.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.common import scratch, shuffle_partitions
from clickfold.llm.embeddedup import is_usable

SAMPLE_ROWS, CENTROIDS, ROUNDS = 16384, 64, 12
CHECK_QUERIES = 400
SHARD_ROWS, LEAST_SHARD_ROWS = 8192, 512
QUERY_BLOCK, STRIP = 1024, 256
VECTOR, QUERY = 0, 1
NEAR = "query_id long, vec_id long, score double"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squared length."""
    return (centroids * centroids).sum(axis=1)[None] - 2 * (x @ centroids.T)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = distances(x, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        sizes = np.bincount(nearest, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


class Index:
    """Codebooks, rows per cell and the shards of each cell. All are bounded
    by the number of centroids, whatever the number of rows."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.dims = sample.shape[1]
        self.half = self.dims // 2
        self.longest = longest
        a, b = self.halves(sample)
        self.first, self.second = kmeans(a, CENTROIDS), kmeans(b, CENTROIDS, seed=1)
        self.n_cells = len(self.first) * len(self.second)

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x[:, : self.half], np.column_stack([x[:, self.half :], rest])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return distances(a, self.first).argmin(axis=1) * len(self.second) + distances(b, self.second).argmin(axis=1)

    def walk(self, near: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: int) -> list[int]:
        """Cells in order of summed distance until `wanted` rows are seen."""
        oa, ob = near[0].argsort(), near[1].argsort()
        da, db = near[0][oa].tolist(), near[1][ob].tolist()
        oa, ob = oa.tolist(), ob.tolist()
        width = len(ob)
        heap, out, seen = [(da[0] + db[0], 0, 0)], [], 0
        while heap and seen < wanted:
            _, i, j = heapq.heappop(heap)
            # each pair is reached once: rows start at j = 0, columns go on to the right
            if j + 1 < width:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
            cell = oa[i] * width + ob[j]
            if counts[cell]:
                out.append(cell)
                seen += counts[cell]
        return out

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(queries, query=True)
        return distances(a, self.first), distances(b, self.second)

    def share_for(self, sample: np.ndarray, k: int, target: float) -> float:
        """Smallest share of rows to look at for recall `target` at k in the sample."""
        n = len(sample)
        queries = np.arange(0, n, max(1, n // CHECK_QUERIES))
        cell = self.cells(sample)
        counts = np.bincount(cell, minlength=self.n_cells)
        needed = []
        near = self.near(sample[queries])
        for at, q in enumerate(queries):
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argpartition(-scores, min(k, n - 1) - 1)[:k] if n > 1 else []
            order = self.walk((near[0][at], near[1][at]), counts.tolist(), n)
            reach = np.zeros(self.n_cells)
            reach[order] = np.cumsum(counts[order])
            needed += (reach[cell[best]] / n).tolist()
        return float(np.quantile(needed, target)) if needed else 1.0

    def deal(self, counts: np.ndarray, tasks: int) -> None:
        """Shards of the cells: small cells share one, large ones take several.
        A small table is cut finer, so that there is a shard for every task."""
        full = int(min(SHARD_ROWS, max(LEAST_SHARD_ROWS, counts.sum() // tasks)))
        self.counts = counts
        self.parts = np.maximum(1, -(-counts // full))
        start, room, shard = np.zeros(self.n_cells, np.int64), full, 0
        for c in np.flatnonzero(counts):
            if counts[c] > room and room < full:
                shard, room = shard + 1, full
            start[c] = shard
            if self.parts[c] > 1:
                shard, room = shard + self.parts[c], full
            else:
                room -= counts[c]
        self.start, self.n_shards = start, shard + 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _list_cells(index: Index):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_matrix(batch.column(1), index.dims))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.int32())], names=["id", "vec", "cell"])

    return run


def _send_queries(index: Index, wanted: int):
    """A row per query and shard that it looks at, with the cells as a bitmap."""
    names = ["shard", "id", "vec", "cells"]

    def run(batches):
        counts = index.counts.tolist()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            near = index.near(_matrix(batch.column(1), index.dims))
            shard, row, cells = [], [], []
            for at in range(len(ids)):
                seen = np.array(index.walk((near[0][at], near[1][at]), counts, wanted))
                bits = np.zeros(index.n_cells, np.uint8)
                bits[seen] = 1
                parts = index.parts[seen]
                own = set(index.start[seen[parts == 1]].tolist())
                for c in seen[parts > 1]:
                    own.update(range(index.start[c], index.start[c] + index.parts[c]))
                shard += own
                row += [at] * len(own)
                cells += [np.packbits(bits).tobytes()] * len(own)
            row = pa.array(row, pa.int32())
            sent = [batch.column(0).take(row), batch.column(1).take(row)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *sent, pa.array(cells, pa.binary())], names=names)

    return run


class Shard:
    """The vectors of one shard by cell, and the search among them."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int):
        rows = pa.Table.from_batches(parts)
        cell = rows.column("cell").to_numpy()
        order = np.lexsort((rows.column("id").to_numpy(), cell))
        self.cell, self.ids = cell[order], rows.column("id").to_numpy()[order]
        self.x = _matrix(rows.column("vec").combine_chunks(), dims)[order]
        self.edges = np.concatenate([[0], np.flatnonzero(np.diff(self.cell)) + 1, [len(self.cell)]])

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        cell, ids, x, edges = self.cell, self.ids, self.x, self.edges
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        q_ids = queries.column("id").to_numpy()
        q = _matrix(queries.column("vec"), x.shape[1])
        bits = np.frombuffer(b"".join(queries.column("cells").to_pylist()), np.uint8).reshape(len(q_ids), -1)
        for at in range(0, len(q_ids), STRIP):
            own_ids, own_q = q_ids[at : at + STRIP], q[at : at + STRIP]
            seen = np.unpackbits(bits[at : at + STRIP], axis=1)
            scores = np.full((len(own_ids), len(ids)), -np.inf)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                looks = np.flatnonzero(seen[:, cell[s]])
                if len(looks):
                    scores[looks, s:e] = own_q[looks] @ x[s:e].T
            for r, query in enumerate(own_ids):
                line = scores[r]
                line[ids == query] = -np.inf
                have = np.count_nonzero(line > -np.inf)
                if not have:
                    continue
                least = np.partition(line, -k)[-k] if have > k else -np.inf
                # a little below the k-th, then once more in one fixed way: equal vectors get equal scores
                cand = np.flatnonzero((line > -np.inf) & (line >= least - 1e-9 * max(1.0, abs(least)) if have > k else line > -np.inf))
                exact = (x[cand] * own_q[r]).sum(axis=1)
                best = np.lexsort((ids[cand], -exact))[:k]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[cand[best]].tolist()
                out["score"] += exact[best].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out)
        )


def _rerank(dims: int, k: int):
    """Over rows sorted by (shard, kind): the vectors of a shard are read once,
    then its queries stream by in blocks."""

    def run(batches):
        current, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if place[a] != current:
                    current, parts, shard = place[a], [], None
                if kind[a] == VECTOR:
                    parts.append(batch.slice(a, b - a))
                    continue
                if parts:
                    shard, parts = Shard(parts, dims), []
                if shard is not None:
                    for at in range(a, b, QUERY_BLOCK):
                        yield shard.nearest(batch.slice(at, min(QUERY_BLOCK, b - at)), k)

    return run


def search(
    vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, target_recall: float = 0.95
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner
    product found for each row of `vectors` for which `is_query` (on the
    column `id`) holds, the row itself left out."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(is_usable(F.col("vec")) & F.col("id").isNotNull())
    rows = scratch(usable.groupBy("id", F.size("vec").alias("dims")).agg(F.min("vec").alias("vec")), "ann-rows")
    sizes = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    found = [_search(rows.where(F.col("dims") == d).select("id", "vec"), is_query, d, sizes[d], k, target_recall) for d in sorted(sizes)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, is_query: Column, dims: int, n_rows: int, k: int, target_recall: float) -> DataFrame:
    """`search` over vectors of one length, ids unique."""
    spark = rows.sparkSession
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = float(rows.agg(F.max(norm)).first()[0]) ** 0.5
    # the smallest hashes; a threshold first, so that one task sorts little more than the sample
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = rows.where(place < F.lit(min(1 << 30, int((1 << 30) * 1.2 * SAMPLE_ROWS / n_rows) + 1)))
    drawn = drawn.orderBy(place, "id").select("vec").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    sample = _matrix(drawn, dims)
    index = Index(sample, longest)
    listed = scratch(rows.mapInArrow(_list_cells(index), f"id long, vec {rows.schema['vec'].dataType.simpleString()}, cell int"), "ann-cells")
    counts = np.zeros(index.n_cells, np.int64)
    for r in listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row per cell
        counts[r["cell"]] = r["n"]
    index.deal(counts, shuffle_partitions(spark))
    share = index.share_for(sample, k, target_recall)
    wanted = max(k + 1, int(np.ceil(share * counts.sum())))
    queries = listed.where(is_query).select("id", "vec")
    kind = rows.schema["vec"].dataType.simpleString()
    # a walk costs far more than reading a query: spread them
    sent = queries.repartition(shuffle_partitions(spark), "id").mapInArrow(
        _send_queries(index, wanted), f"shard long, id long, vec {kind}, cells binary"
    )
    used = np.flatnonzero(index.counts)
    # at most one row per pair of centroids, so it may be broadcast
    places = spark.createDataFrame(
        [(int(c), int(index.start[c]), int(index.parts[c])) for c in used], "cell int, start long, parts long"
    )
    listed = listed.join(F.broadcast(places), "cell")
    shard = F.col("start") + F.pmod(F.xxhash64("id"), "parts")
    vectors = listed.select(shard.alias("shard"), F.lit(VECTOR).alias("kind"), "id", "vec", "cell", F.lit(None).cast("binary").alias("cells"))
    asked = sent.select("shard", F.lit(QUERY).alias("kind"), "id", "vec", F.lit(None).cast("int").alias("cell"), "cells")
    dealt = vectors.unionByName(asked).repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_rerank(dims, k), NEAR)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
