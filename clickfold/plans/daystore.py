"""Day store: the session tables' states per day shard, refreshed shard by shard.

A report of 61 days needs one new day each day. The store keeps, for every
shard of the export, the states of each rollup (`operators/rollups.py`) and a
manifest that says which folder holds which shard and which files it was
built from. `refresh` rolls up only shards that are new or whose files have
changed (a late rewrite, the daily shard that replaces the intraday one) and
publishes a new manifest after their folders; `read` opens the folders of a
window. A run that dies leaves the manifest, and so the store, as it was.

Old folders stay until `vacuum`, so that a reader of the manifest before never
loses its files.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.functions.params import SHREDDED, shred_params
from clickfold.operators.rollups import ROLLUPS, SHARD, Rollup
from clickfold.sources import files, manifest
from clickfold.sources.events import date_key
from clickfold.sources.shards import PartitionedExport, Shard, ShardFolders, shard_in_window


def _name(shard: Shard) -> str:
    return f"{shard[0]}/{shard[1]}"


@dataclass(frozen=True)
class DayStore:
    """The store under `root`."""

    spark: SparkSession
    root: str
    rollups: Mapping[str, Rollup] = field(default_factory=lambda: ROLLUPS)

    def refresh(self, source: PartitionedExport | ShardFolders, as_of: dt.date, days: int = 60) -> list[Shard]:
        """Bring the shards from `as_of - days` to `as_of` up to date; returns
        those that were rolled up. Shards the source has no longer are taken
        out, those before the window are left as they are."""
        version, held = manifest.latest(self.spark, self.root)
        lo, hi = date_key(as_of - dt.timedelta(days=days)), date_key(as_of)
        there = {s: p for s, p in source.shards(self.spark).items() if shard_in_window(s, lo, hi, True)}
        prints = {s: files.fingerprint(self.spark, p) for s, p in there.items()}
        events = source.events(self.spark)
        schemas = {name: r.per_shard(events).schema for name, r in self.rollups.items()}
        form = hashlib.sha256(repr(sorted((n, s.json()) for n, s in schemas.items())).encode()).hexdigest()
        # states of another form (an older release) are of no use
        known = held.get("shards", {}) if held.get("form") == form else {}
        stale = sorted(s for s in there if known.get(_name(s), {}).get("source") != prints[s])
        kept = {
            name: entry
            for name, entry in known.items()
            if not lo <= name.split("/")[0] <= hi or (tuple(name.split("/")) in there and tuple(name.split("/")) not in stale)
        }
        if not stale and len(kept) == len(known) and held.get("form") == form:
            return []
        run = uuid.uuid4().hex
        found = {s: {"source": prints[s], "folders": {}} for s in stale}
        for name, rollup in self.rollups.items() if stale else ():
            folder = f"{name}/{run}"
            self._write(rollup, events.where(_any_of(stale)), f"{self.root}/{folder}")
            for shard in stale:
                part = f"{folder}/event_date={shard[0]}/export_kind={shard[1]}"
                if files.exists(self.spark, f"{self.root}/{part}"):  # no rows, no folder
                    found[shard]["folders"][name] = part
        content = {
            "form": form,
            "schemas": {n: json.loads(_states_only(s).json()) for n, s in schemas.items()},
            "shards": {**kept, **{_name(s): entry for s, entry in found.items()}},
        }
        manifest.publish(self.spark, self.root, version, content)
        return stale

    def _write(self, rollup: Rollup, events: DataFrame, path: str) -> None:
        # files as large as a shard's rows ask for, not one per task and shard
        rollup.per_shard(events).hint("rebalance", *SHARD).write.partitionBy(*SHARD).parquet(path)

    def read(
        self, rollup: Rollup, as_of: dt.date, days: int, *, end_offset: int = 0, include_intraday: bool = True
    ) -> DataFrame:
        """States of all shards from `as_of - days` to `as_of - end_offset`,
        one row per shard and key."""
        _, held = manifest.latest(self.spark, self.root)
        lo, hi = date_key(as_of - dt.timedelta(days=days)), date_key(as_of - dt.timedelta(days=end_offset))
        schema = T.StructType.fromJson(held["schemas"][rollup.name])
        paths = [
            f"{self.root}/{entry['folders'][rollup.name]}"
            for name, entry in sorted(held["shards"].items())
            if rollup.name in entry["folders"] and shard_in_window(tuple(name.split("/")), lo, hi, include_intraday)
        ]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def merged(self, rollup: Rollup, as_of: dt.date, days: int, **window) -> DataFrame:
        """The session table of a window: states of its shards put together."""
        return rollup.merged(self.read(rollup, as_of, days, **window))

    def vacuum(self) -> list[str]:
        """Delete shard folders that the newest manifest does not name (for
        times without readers of older ones); returns them."""
        _, held = manifest.latest(self.spark, self.root)
        used = {f for e in held.get("shards", {}).values() for f in e["folders"].values()}
        runs = [f"{name}/{run}" for name in self.rollups for run in files.folder_names(self.spark, f"{self.root}/{name}")]
        there = [
            f"{run}/{day}/{kind}"
            for run in runs
            for day in files.folder_names(self.spark, f"{self.root}/{run}")
            for kind in files.folder_names(self.spark, f"{self.root}/{run}/{day}")
        ]
        gone = [f for f in there if f not in used]
        for folder in gone:
            files.delete(self.spark, f"{self.root}/{folder}")
        return gone


#: Parameters the reports look up.
REPORT_PARAMS = (
    "ga_session_id", "ga_session_number", "session_engaged", "engagement_time_msec", "page_title", "source", "medium", "campaign",
)


@dataclass(frozen=True)
class Shredded:
    """Events with the parameters of `keys` as columns instead of the array
    (a "rollup" that keeps every event). Clustered by event name, so pushed
    event-name filters skip row groups."""

    keys: tuple[str, ...] = REPORT_PARAMS
    name: str = "shredded"

    def per_shard(self, events: DataFrame) -> DataFrame:
        rest = [c for c in events.columns if c != "event_params"]
        return events.select(*rest, shred_params(self.keys).alias(SHREDDED))


class ShreddedEvents(DayStore):
    """A store of shredded events, refreshed shard by shard like the states.
    Reports over `events()` are built inside `shredded_params()`."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = REPORT_PARAMS):
        super().__init__(spark, root, {"shredded": Shredded(keys)})

    def _write(self, rollup: Shredded, events: DataFrame, path: str) -> None:
        rows = rollup.per_shard(events).hint("rebalance", *SHARD).sortWithinPartitions("event_name", "user_pseudo_id")
        rows.write.partitionBy(*SHARD).parquet(path)

    def events(self) -> DataFrame:
        """All shards; a window opens only its own (their date and kind are
        constants of their branches)."""
        _, held = manifest.latest(self.spark, self.root)
        schema = T.StructType.fromJson(held["schemas"]["shredded"])
        parts = []
        for name, entry in sorted(held["shards"].items()):
            if "shredded" in entry["folders"]:
                day, kind = name.split("/")
                shard = self.spark.read.schema(schema).parquet(f"{self.root}/{entry['folders']['shredded']}")
                parts.append(shard.select("*", F.lit(day).alias("event_date"), F.lit(kind).alias("export_kind")))
        both = [T.StructField(c, T.StringType()) for c in SHARD]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], T.StructType([*schema.fields, *both]))


def _any_of(shards: list[Shard]) -> Column:
    """Partition filter for exactly these shards."""
    out = F.lit(False)
    for kind in sorted({k for _, k in shards}):
        out = out | ((F.col("export_kind") == kind) & F.col("event_date").isin(*[d for d, k in shards if k == kind]))
    return out


def _states_only(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in SHARD])
