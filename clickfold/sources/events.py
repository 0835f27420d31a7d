"""The event export: one Parquet dataset partitioned by shard date and kind.

`in_window` only touches the partition columns, so every report window shows
up as `PartitionFilters` in the scan and whole days are skipped at planning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.schema import EVENT_SCHEMA, PARTITION_COLUMNS


def date_key(d: dt.date) -> str:
    """Shard date text, `YYYYMMDD`."""
    return d.strftime("%Y%m%d")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Read the export with the fixed schema (partition folders included)."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def window_condition(
    as_of: dt.date, days: int, *, end_offset: int = 0, include_intraday: bool = True
) -> Column:
    """Shards from `as_of - days` to `as_of - end_offset`, both ends included.

    `include_intraday=False` keeps the daily shards only (the attribution
    reports read complete days only).
    """
    lo = date_key(as_of - dt.timedelta(days=days))
    hi = date_key(as_of - dt.timedelta(days=end_offset))
    cond = F.col("event_date").between(F.lit(lo), F.lit(hi))
    if not include_intraday:
        cond = cond & (F.col("export_kind") == F.lit("daily"))
    return cond


def in_window(
    events: DataFrame,
    as_of: dt.date,
    days: int,
    *,
    end_offset: int = 0,
    include_intraday: bool = True,
) -> DataFrame:
    return events.where(
        window_condition(as_of, days, end_offset=end_offset, include_intraday=include_intraday)
    )


def write_table(
    df: DataFrame, path: str, *, partition_by: tuple[str, ...] | list[str] = (), mode: str = "overwrite"
) -> None:
    """Save a report (the reference keeps each report as a table that later
    reports read by name)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


__all__ = [
    "PARTITION_COLUMNS", "date_key", "in_window", "read_events", "read_table",
    "window_condition", "write_table",
]
