"""External lookup tables: account buyer flags and e-mail campaign stats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickfold.schema import BUYER_SCHEMA, CAMPAIGN_SCHEMA


def read_buyers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(BUYER_SCHEMA).format(fmt).load(path)


def read_campaigns(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Campaign statistics; metrics stay text until the report casts them."""
    return spark.read.schema(CAMPAIGN_SCHEMA).format(fmt).options(**options).load(path)
