"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.session import ship_package
from clickfold.sources.tables import free_scratch, scratch_table

__all__ = ["connected_components", "hex64", "join_labels", "scratch", "ship_package", "shuffle_partitions", "table"]


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: the
    lineage ends there, so a lost executor never recomputes what is above."""
    return scratch_table(df, f"llm-{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(col):
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def join_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union-find over arrays: hook the larger root of each pair (u, v) under
    the smaller one and shorten paths, in place, until nothing changes.
    `labels[i]` is the smallest index that i is joined to so far."""
    while len(u):
        ru, rv = labels[u], labels[v]
        open_ = ru != rv
        if not open_.any():
            return
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(labels, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            shorter = labels[labels]
            if np.array_equal(shorter, labels):
                break
            labels[:] = shorter


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as long columns (a, b).

    Returns (node, component) for every node that has an edge to another
    one; `component` is the smallest node reachable. Alternating large-star
    and small-star steps (Kiveris et al., SoCC 2014): every step is a
    map-side combined minimum per node and one join, and each round is cut
    by a written table. The minima are written before they are joined, so
    both join inputs are plain shuffles and Spark can split the edges of a
    hub node over many tasks. Null ends and self-loops are ignored; repeated
    edges and an empty table are fine.
    """
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = scratch(e, "cc-edges")
    state = None
    while True:
        seen = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(seen) == state or seen["n"] == 0:
            break
        state = tuple(seen)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lowest = scratch(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large")
        large = (
            both.join(lowest, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = scratch(large, "cc-star")
        free_scratch(lowest)
        least = scratch(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc-edges")
        # the round's tables are done with: `after` is a table of its own
        for done in (e, large, least):
            free_scratch(done)
        e = after
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
