"""Mixing sources to target weights with nested hash thresholds.

Every document has a fixed 64-bit hash. A source that is to give less than
its size takes the documents below a threshold; one that is to give more
takes all of them once and those below the threshold twice, and so on, so a
larger budget always takes a superset. The threshold comes from histograms:
sizes are summed per (source, hash bucket), the bucket where the running sum
crosses the budget is found, and only that bucket is refined, twice. No
documents are sorted, and the sums are combined before they are shuffled.

Sources in code-point order, null last, weigh `weights`, repeating. Together
they share `share` of all sizes by weight; a target stops at `cap` times its
source's size and what is over is shared again by weight.

Defined cases: null text counts 0 words. A null source is a source of its
own. Documents are taken whole; the one on the threshold is taken if that
brings its source nearer to its target, so a source misses it by half of one
document at most. Rows equal in id and text have the same hash and are taken
together. An empty table gives an empty result. Other columns are ignored by
`plan_mix` and kept by `take`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.common import scratch, shuffle_partitions

WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12
#: Plans of at most this many sources (a few hundred bytes each) may be broadcast.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text, F.lit("mix"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds `place`, the 0-based place of each source in code-point order,
    null last: range partitions, then offsets from one count per partition."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    dealt = scratch(dealt.withColumn("part", F.shiftright(mid, 33)).withColumn("row", mid.bitwiseAND((1 << 33) - 1)), "mix-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return dealt.join(offsets.drop("n"), "part").withColumn("place", F.col("off") + F.col("row")).drop("part", "row", "off")


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds `target`. Sources above their cap are fixed there and the rest
    shares what is left, until none is above; only sums reach the driver."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = scratch(_numbered(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, None
    while True:
        over = F.col("weight") * F.lit(rate) > F.col("most")
        left = s.agg(
            F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(over).alias("n"),
        ).first()
        if left["n"] == capped or not left["weight"]:
            break
        capped = left["n"]
        rate = (share * total - left["fixed"]) / left["weight"]
    return s.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(rate)))


def _crossing(hist: DataFrame, bucket: str, plan: DataFrame, budget: str) -> DataFrame:
    """Per source the first bucket at which the running sum passes the budget,
    with what the buckets before it leave of the budget."""
    running = F.sum("words").over(Window.partitionBy("source").orderBy(bucket))
    # a source without a budget has no cut: wordless documents would pass below any
    wanted = plan.select(F.col("source").alias("s"), budget).where(F.col(budget) > 0)
    joined = hist.join(wanted, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    crossed = joined.withColumn("run", running).where(F.col("run") > F.col(budget))
    first = F.min(F.struct(bucket, F.col(budget) - (F.col("run") - F.col("words")), F.col("words"))).alias("x")
    return crossed.groupBy("source").agg(first).select(
        "source", F.col(f"x.{bucket}").alias(bucket), F.col("x.col2").alias("rest"), F.col("x.words").alias("step")
    )


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """(sized, plan). sized: id, source, size, hash per document. plan: one row
    per source: source, source_size, target, copies (taken of every document)
    and cut (documents with hash <= cut are taken once more; null: none)."""
    sized = scratch(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"),
            hash_of(F.col(id_col), F.col(text_col)).alias("hash"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = _targets(sources, weights, share, cap).withColumn("copies", copies)
    plan = plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = scratch(plan.select("source", "source_size", "target", "copies", "budget"), "mix-plan")
    level1 = F.shiftright("hash", 64 - BUCKET_BITS)
    level2 = F.shiftright("hash", 64 - 2 * BUCKET_BITS)
    # first histogram: BUCKET_BITS bits of the hash (signed order)
    hist = sized.groupBy("source", level1.alias("b1")).agg(F.sum("size").alias("words"))
    at1 = scratch(_crossing(hist, "b1", plan, "budget"), "mix-level1")
    # second: the next bits, inside the boundary bucket only
    inside = _at_boundary(sized, level1, at1, "b1")
    hist = inside.groupBy("source", level2.alias("b2")).agg(F.sum("size").alias("words"))
    at2 = scratch(_crossing(hist, "b2", at1, "rest"), "mix-level2")
    # last: single hashes inside that bucket
    inside = _at_boundary(sized, level2, at2, "b2")
    hist = inside.groupBy("source", "hash").agg(F.sum("size").alias("words"))
    at3 = _crossing(hist, "hash", at2, "rest")
    nearer = F.col("step") - F.col("rest") < F.col("rest")
    # hashes are whole numbers: "below the crossing one" is "at most one less"
    cut = at3.select(
        F.col("source").alias("s"),
        F.when(nearer, F.col("hash")).when(F.col("hash") > F.lit(-(1 << 63)), F.col("hash") - 1).alias("cut"),
    )
    return sized, scratch(plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget"), "mix-cuts")


def _at_boundary(sized: DataFrame, level: Column, at: DataFrame, bucket: str) -> DataFrame:
    """Documents in the boundary bucket of their source."""
    side = at.select(F.col("source").alias("s"), F.col(bucket).alias("b"))
    return sized.join(_bounded(side), F.col("source").eqNullSafe(F.col("s")) & (level == F.col("b")), "left_semi")


def _bounded(plan: DataFrame) -> DataFrame:
    """A per-source table, broadcast if it has few enough rows; otherwise the
    join shuffles and Spark splits large sources."""
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def mixed(sized: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken, copies) per document."""
    per_source = _bounded(plan.select(F.col("source").alias("s"), "source_size", "target", "copies", "cut"))
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("s")))
    times = F.col("copies") + F.coalesce((F.col("hash") <= F.col("cut")).cast("int"), F.lit(0))
    return joined.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies")
    )


def take(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of `docs`, repeated as often as the plan takes them."""
    per_source = _bounded(plan.select(F.col("source").alias("__mix_source"), F.col("copies").alias("__mix_copies"), F.col("cut").alias("__mix_cut")))
    joined = docs.join(per_source, docs[source_col].eqNullSafe(F.col("__mix_source")))
    extra = F.coalesce((hash_of(docs[id_col], docs[text_col]) <= F.col("__mix_cut")).cast("int"), F.lit(0))
    times = F.col("__mix_copies") + extra
    return joined.withColumn("__mix_n", F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])
