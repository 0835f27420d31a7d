"""One registered query per operator, on the whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.llm import ann, bpe, chat, embeddedup, langid, linededup, mixing, resampling, secrets, simhash, toxicity, vectorcodes, warc
from clickfold.llm.common import hex64, scratch, ship_package, table

VOCABULARY = "word_bpe_49k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(secrets.scan(table(spark, sf_dir, "documents")))


def secret_digests(found: DataFrame) -> DataFrame:
    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixing.mixed(sized, plan).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    return bpe_digests(bpe.encode(table(spark, sf_dir, "documents"), path, decoded_col="decoded"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read_archives(spark, path)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    replies = scratch(chat.replies_of(talks), "replies")
    return chat_digests(chat.format_paths(replies, chat.best_paths(replies))).withColumnRenamed("tree", "conv_id")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    written = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"], p["end"])), ",")
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), written.alias("passages"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    coded = vectorcodes.with_label_error(vectorcodes.encode(vectors, vectorcodes.fit(vectors)))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Everything but the ids is read back from the formatted conversations."""
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    written = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "tree", F.size(turns).cast("long").alias("n_turns"), F.sha2(written, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


OPERATORS = (
    op1_language_id, op2_line_dedup, op3_secret_scan, op4_embedding_dedup, op5_simhash_dedup,
    op6_nearest_neighbours, op7_mixing, op8_bpe, op9_warc, op10_chat_formatting,
    op11_toxicity, op12_resampling, op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f) for f in OPERATORS
}
