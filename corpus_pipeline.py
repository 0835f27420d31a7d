"""Corpus pipeline over `documents`: language ID, line dedup, SimHash
near-dedup, mixing to target weights, BPE.

Every stage works on all rows its predecessor kept. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.llm import bpe, langid, linededup, mixing, queries, simhash
from clickfold.llm.common import ship_package
from clickfold.session import ensure_checkpoint_dir
from clickfold.sources.tables import scratch_scope

ORACLE_SQL = None  # hashes, merges and a trained model; tested stage by stage instead


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null, without a
    letter, or with no language that stands out."""
    ship_package(spark)
    model = langid.fit(langid.training_rows(docs))
    return langid.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; n_chars follows the text."""
    ship_package(spark)
    out = linededup.dedup_lines(docs, stats_col=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the smallest
    id, or one without an id if no row of the group has any."""
    ship_package(spark)
    return simhash.keep_first(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source nears its target."""
    _, plan = mixing.plan_mix(docs)
    return mixing.take(docs, plan)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text per document."""
    ship_package(spark)
    path = public_tokenizers.path(queries.VOCABULARY)
    return queries.bpe_digests(bpe.encode(docs, path, decoded_col="decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read
    again; what a stage wrote for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
