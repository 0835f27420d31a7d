"""The event export as a set of day shards, found by name.

A shard is one date and kind ('daily' or 'intraday'). Two layouts:

* `PartitionedExport`: one dataset, folders `event_date=.../export_kind=...`;
* `ShardFolders`: a folder per shard side by side, `events_YYYYMMDD` and
  `events_intraday_YYYYMMDD`, as the export names its tables. Each folder is
  a dataset of its own and may have an older schema: columns and fields it
  lacks read as NULL, those it has beside the schema are left out, others are
  cast. Folders with other names are ignored.

`events(spark)` gives one DataFrame over all shards in which a window on
`event_date` / `export_kind` opens only the shards it needs; `shards(spark)`
lists the folders, so a caller can see which of them have changed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.schema import EVENT_SCHEMA, PARTITION_COLUMNS
from clickfold.sources import files
from clickfold.sources.events import read_events

DATA_SCHEMA = T.StructType([f for f in EVENT_SCHEMA.fields if f.name not in PARTITION_COLUMNS])
Shard = tuple[str, str]


def shard_in_window(shard: Shard, lo: str, hi: str, include_intraday: bool) -> bool:
    return lo <= shard[0] <= hi and (include_intraday or shard[1] == "daily")


@dataclass(frozen=True)
class PartitionedExport:
    path: str

    def shards(self, spark: SparkSession) -> dict[Shard, str]:
        out = {}
        for day in files.folder_names(spark, self.path):
            if m := re.fullmatch(r"event_date=(\d{8})", day):
                for kind in files.folder_names(spark, f"{self.path}/{day}"):
                    if k := re.fullmatch(r"export_kind=(daily|intraday)", kind):
                        out[m.group(1), k.group(1)] = f"{self.path}/{day}/{kind}"
        return out

    def events(self, spark: SparkSession) -> DataFrame:
        return read_events(spark, self.path)


@dataclass(frozen=True)
class ShardFolders:
    path: str
    prefix: str = "events_"
    intraday: str = "intraday_"

    def shards(self, spark: SparkSession) -> dict[Shard, str]:
        name = re.compile(f"{re.escape(self.prefix)}({re.escape(self.intraday)})?" r"(\d{8})")
        return {
            (m.group(2), "intraday" if m.group(1) else "daily"): f"{self.path}/{folder}"
            for folder in files.folder_names(spark, self.path)
            if (m := name.fullmatch(folder))
        }

    def events(self, spark: SparkSession) -> DataFrame:
        """The date and kind of a shard are constants of its branch, so a
        window drops whole branches when the plan is optimised."""
        parts = [self._shard(spark, path, shard) for shard, path in sorted(self.shards(spark).items())]
        return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], EVENT_SCHEMA)

    def _shard(self, spark: SparkSession, path: str, shard: Shard) -> DataFrame:
        found = spark.read.parquet(path)  # the footer's own schema
        columns = [conform(found, f).alias(f.name) for f in DATA_SCHEMA.fields]
        return found.select(*columns, F.lit(shard[0]).alias("event_date"), F.lit(shard[1]).alias("export_kind"))


def conform(df: DataFrame, field: T.StructField) -> Column:
    """Column `field` of `df` with the type of `field`."""
    if field.name not in df.schema.fieldNames():
        return F.lit(None).cast(field.dataType)
    return _conform(df[field.name], df.schema[field.name].dataType, field.dataType)


def _conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if _same(have, want):
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names = have.fieldNames()
        inner = [
            (_conform(value[f.name], have[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _conform(x, have.elementType, want.elementType))
    return value.cast(want)


def _same(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability."""
    return a.simpleString() == b.simpleString()
