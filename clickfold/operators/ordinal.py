"""Row numbers within a key that never put all rows of one key in one task.

`row_number() over (partition by key order by t)` sends every row of a key to
one task; one user holding a third of the rows would stall the job. Here the
rows of each key are cut into buckets that follow the order:

1. count rows per (key, bucket)      - aggregate, combined map-side;
2. prefix-sum the counts per key     - window over bucket rows only (one
   row per bucket the key touches);
3. number rows within (key, bucket)  - window over one bucket, plus the
   offset of step 2 (joined on (key, bucket)).

Good buckets are the partitions of `repartitionByRange(key, t, ...)`,
stored with the rows (`spark_partition_id()` written into a table): Spark
sizes them by sampling, so a hot key spans many equal buckets and step 2
holds at most one row per partition. Fixed-width time buckets
(`floor(t / width)`) also work and need no write.

The result equals the plain window's row number for the same order.
Per-key totals ride along from step 2, so callers get counts without
another aggregation.

`ordinal_by_carry` needs no second shuffle and no join of all rows: rows are
range-partitioned and sorted by (key, order) once and numbered as they stream
by. A key whose rows all lie in one partition is complete there. Only the
outermost keys of a partition can go on in another one; their rows get the
counts of the partitions before from a table of at most two rows per
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.session import ship_package
from clickfold.sources.tables import scratch_table

MINUTE_MICROS = 60_000_000


def ordinal_within(
    df: DataFrame,
    key: str,
    order: list[str | Column],
    *,
    bucket_of: Column,
    name: str = "ordinal",
    bucket_aggs: dict[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Add `name` = 1-based row number of each row within `key` by `order`.

    `bucket_of` maps a row to its bucket; it must be non-decreasing in
    `order` (e.g. `floor(t / width)` for order `t, ...`). `bucket_aggs`
    maps an output column to (aggregate per bucket, how to combine buckets
    per key: 'sum' | 'max'), added to every row as a per-key total.
    """
    b = df.withColumn("_bucket", bucket_of)
    aggs = {"_c": (F.count(F.lit(1)), "sum")}
    aggs.update(bucket_aggs or {})
    per_bucket = b.groupBy(key, "_bucket").agg(*[a.alias(f"_b{n}") for n, (a, _) in aggs.items()])
    whole = Window.partitionBy(key)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": F.sum, "max": F.max}
    per_bucket = per_bucket.select(
        key, "_bucket",
        F.coalesce(F.sum("_b_c").over(before), F.lit(0)).alias("_off"),
        *[combine[how](f"_b{n}").over(whole).alias(n) for n, (_, how) in aggs.items() if n != "_c"],
    )
    local = Window.partitionBy(key, "_bucket").orderBy(*order)
    # Null-safe keys: no `isnotnull` filters get inferred into one side
    # only, so both sides keep the same plan and share its exchange
    # (with plain `=` the input would be computed twice).
    pb = per_bucket.withColumnRenamed(key, "_k").withColumnRenamed("_bucket", "_kb")
    cond = b[key].eqNullSafe(pb["_k"]) & b["_bucket"].eqNullSafe(pb["_kb"])
    return (
        b.join(pb, cond, "inner")
        .drop("_k", "_kb")
        .withColumn(name, F.col("_off") + F.row_number().over(local))
        .drop("_bucket", "_off")
    )


def ordinal_by_carry(
    df: DataFrame,
    key: str,
    order: list[Column],
    *,
    name: str = "ordinal",
    counts: dict[str, Column],
    last: dict[str, tuple[Column, Column]],
    table: str = "numbered_rows",
    write: Callable[[DataFrame, str], DataFrame] = scratch_table,
) -> DataFrame:
    """Add `name` = 1-based row number of each row within `key` by `order`,
    `counts` (rows of the key for which a condition holds) and `last` (a value
    of the key's last row in `order` for which a condition holds; NULL
    without one). Written once as the scratch tables `table` (the rows) and
    `table`-carry (the outermost keys).

    A task holds the rows of one key of its own range at a time, at most its
    partition."""
    inputs = df.select(
        "*", *[F.coalesce(c, F.lit(False)).alias(f"_c_{n}") for n, c in counts.items()],
        *[F.coalesce(c, F.lit(False)).alias(f"_l_{n}") for n, (c, _) in last.items()], *[v.alias(n) for n, (_, v) in last.items()],
    )
    dealt = inputs.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    added = [T.StructField(n, T.LongType()) for n in (name, *counts)]
    values = [inputs.schema[n] for n in last]
    out = T.StructType([*df.schema.fields, *added, *[T.StructField(f.name, f.dataType) for f in values], T.StructField("_part", T.LongType()), T.StructField("_edge", T.BooleanType())])
    numbered = dealt.mapInArrow(_number_runs(key, df.columns, name, list(counts), list(last)), out)
    ship_package(df.sparkSession)
    numbered = write(numbered, table)
    # the outermost keys of all partitions: their counts per partition, then before each partition and in all
    edge = numbered.where("_edge")
    per_part = edge.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(
        F.max(name).alias("_n"), *[F.max(n).alias(f"_n_{n}") for n in counts], *[F.max(F.struct(F.col(name), F.col(n))).alias(f"_n_{n}") for n in last]
    )
    whole = Window.partitionBy("_k")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select(
        "_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.sum(f"_n_{n}").over(whole).alias(f"_a_{n}") for n in counts],
        # the last partition that has a value
        *[
            F.max(F.when(F.col(f"_n_{n}")[n].isNotNull(), F.struct(F.col("_p"), F.col(f"_n_{n}")[n].alias("v")))).over(whole)["v"].alias(f"_a_{n}")
            for n in last
        ],
    )
    carried = F.broadcast(write(carried, f"{table}-carry"))  # at most two rows per shuffle partition
    settled = edge.join(carried, edge[key].eqNullSafe(carried["_k"]) & (edge["_part"] == carried["_p"])).select(
        *df.columns, (F.col("_before") + F.col(name)).alias(name), *[F.col(f"_a_{n}").alias(n) for n in (*counts, *last)]
    )
    return numbered.where(~F.col("_edge")).select(*df.columns, name, *counts, *last).unionByName(settled)


def _number_runs(key: str, columns: list[str], name: str, counts: list[str], last: list[str]):
    """Over one sorted partition: numbers and totals per run of equal keys."""

    def numbered(parts: list[pa.RecordBatch], edges: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
        """Whole runs; `edges` says whether the first and the last one may go on outside the partition."""
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        starts = np.flatnonzero(_changes(t.column(key)))
        sizes = np.diff(starts, append=n)
        out = {c: t.column(c) for c in columns}
        out[name] = pa.array(np.arange(n) - np.repeat(starts, sizes) + 1, pa.int64())
        for c in counts:
            held = t.column(f"_c_{c}").to_numpy().astype(np.int64)
            out[c] = pa.array(np.repeat(np.add.reduceat(held, starts), sizes), pa.int64())
        for c in last:
            held = np.where(t.column(f"_l_{c}").to_numpy(), np.arange(n), -1)
            at = np.repeat(np.maximum.reduceat(held, starts), sizes)
            out[c] = t.column(c).take(pa.array(at, mask=at < 0))
        edge = np.zeros(n, bool)
        edge[: sizes[0]] |= edges[0]
        edge[starts[-1] :] |= edges[1]
        out["_part"] = pa.array(np.full(n, TaskContext.get().partitionId()), pa.int64())
        out["_edge"] = pa.array(edge)
        yield from pa.table(out).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []  # the run that goes on
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            if open_ and open_[-1].column(key)[-1].as_py() == batch.column(key)[0].as_py() == batch.column(key)[-1].as_py():
                open_.append(batch)
                continue
            at = int(np.flatnonzero(_changes(batch.column(key)))[-1])
            # a batch that begins with another key ends the open run even if it is a single run itself
            done = [*open_, *([batch.slice(0, at)] if at else [])]
            if done:
                yield from numbered(done, (first, False))
                first = False
            open_ = [batch.slice(at)]
        if open_:
            yield from numbered(open_, (first, True))

    return run


def _changes(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """True where a row's key differs from that of the row before (null is a key)."""
    coded = pc.dictionary_encode(keys, null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])
