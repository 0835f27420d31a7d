"""Target-distribution importance resampling over hashed word n-grams.

Every text is a bag of word n-grams in `buckets` hash buckets. A bucket's gain
is the log ratio of its (smoothed) share in the target texts to its share in
all documents, in thousandths; a document's weight is the sum over its n-grams.
Adding Gumbel noise fixed by the document's id and taking the largest scores
draws documents without replacement in proportion to exp(weight).

The documents are read twice: once for the bucket totals (combined per task,
`buckets` numbers reach the driver) and once for the weights. N-grams are
interned in a NumPy table per task (see gramtable.py); an occurrence's slot
leads to its bucket and gain. Ranks come from range partitions with offsets:
no task holds all scores.

Defined cases: null, empty and wordless texts have no features and weight 0;
they count for nothing. A null id draws its noise from an empty id, is last
among equal scores, and can be drawn. Repeated rows are documents of their own
with equal scores, ranked one after the other. Empty target texts give gains
from the smoothing alone. Other columns stay out of the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.common import scratch, shuffle_partitions
from clickfold.llm.gramtable import GramTable, bucket_batches


def bucket_totals(docs: DataFrame, *, text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> np.ndarray:
    """Number of n-gram occurrences per bucket over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable(buckets)
        for batch in batches:
            for _, slots, found in bucket_batches(((0, t.as_py()) for t in batch.column(0)), table, longest):
                if len(slots) and slots[0] < 0:
                    np.add.at(table.totals, found, 1)
                else:
                    np.add.at(table.count, slots, 1)
        n = table.flush()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) per bucket."""
    b = float(len(corpus))
    s, t = float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(tb) + 1) * (s + b) / ((float(sb) + 1) * (t + b)))) for sb, tb in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def noise(doc_id: object, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 3, seed: int = 42
) -> DataFrame:
    """(id, n_words, n_features, weight, score) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable(len(gain))
        for batch in batches:
            n = batch.num_rows
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            words = np.zeros(n, np.int64)

            texts = ((i, t.as_py()) for i, t in enumerate(batch.column(1)))
            for doc, _, found in bucket_batches(texts, table, longest, words):
                np.add.at(features, doc, 1)
                np.add.at(weight, doc, gain[found])
            ids = batch.column(0)
            score = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, n)
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (words, features, weight, score))], names=["id", "n_words", "n_features", "weight", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def draw(weighed: DataFrame, *, id_col: str = "doc_id", percent: int = 5, min_words: int = 20) -> DataFrame:
    """Adds `rank`, 1 for the largest score, to the drawn `percent` of the
    documents with at least `min_words` words; null for the others."""
    spark = weighed.sparkSession
    weighed = scratch(weighed, "weights")
    fit_ = F.col("n_words") >= min_words
    most = weighed.where(fit_).count() * percent // 100
    # the row number as written tells repeated rows apart
    order = [F.desc("score"), F.col(id_col).asc_nulls_last(), F.col("__row")]
    dealt = weighed.where(fit_).withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    dealt = scratch(dealt.withColumn("__part", F.shiftright(mid, 33)).withColumn("__at", mid.bitwiseAND((1 << 33) - 1)), "ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(F.col("__part").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    place = F.col("__off") + F.col("__at") + 1
    ranked = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # one row per shuffle partition
    ranked = ranked.withColumn("rank", F.when(place <= most, place)).select(*weighed.columns, "rank")
    return ranked.unionByName(weighed.where(~fit_).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, longest: int = 3, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Scores all documents and draws `percent` of those with `min_words`
    words towards the distribution of the target texts."""
    gain = gains(bucket_totals(docs, buckets=buckets, longest=longest), bucket_totals(target, buckets=buckets, longest=longest))
    return draw(weigh(docs, gain, longest=longest, seed=seed), percent=percent, min_words=min_words)
