"""Report sets that become visible as a whole.

`publish_reports` writes the tables of a run to folders of their own,
`<root>/<report>/as_of=<date>/run=<id>`, and then one manifest that names them
(sources/manifest.py). `published` resolves names through the newest manifest:
until it is written, readers see the set of the run before, and never tables
of two runs. A rerun of a day replaces its entry; a run that dies leaves
folders that no manifest names, which `vacuum` deletes.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from clickfold.plans.daily import TABLES, save_all
from clickfold.plans.daystore import DayStore
from clickfold.sources import files, manifest
from clickfold.sources.events import read_table
from clickfold.sources.tables import scratch_scope


def publish_reports(
    spark: SparkSession,
    events: DataFrame,
    buyer_flags: DataFrame,
    campaigns: DataFrame,
    as_of: dt.date,
    root: str,
    *,
    keep_scratch: bool = False,
    store: DayStore | None = None,
) -> dict[str, str]:
    """Write all reports for `as_of` and publish them as one set; returns
    report key -> path. Of two runs at once on one root the later one to
    finish fails with `manifest.ConcurrentPublish` and publishes nothing."""
    root = root.rstrip("/")
    version, content = manifest.latest(spark, root)
    run = uuid.uuid4().hex

    def folder(key: str) -> str:
        return f"{TABLES[key]}/as_of={as_of.isoformat()}/run={run}"

    with scratch_scope(spark, keep=keep_scratch):
        paths = save_all(spark, events, buyer_flags, campaigns, as_of, lambda key: f"{root}/{folder(key)}", store)
    manifest.publish(spark, root, version, {**content, as_of.isoformat(): {key: folder(key) for key in paths}})
    return paths


def published(spark: SparkSession, root: str, as_of: dt.date | None = None) -> dict[str, str]:
    """Report key -> path of the set of `as_of` (default: the latest day)."""
    _, content = manifest.latest(spark, root)
    day = max(content, default=None) if as_of is None else as_of.isoformat()
    if day not in content:
        raise LookupError(f"{root}: nothing published" + (f" for {day}" if day else ""))
    return {key: f"{root.rstrip('/')}/{folder}" for key, folder in content[day].items()}


def read_published(spark: SparkSession, root: str, key: str, as_of: dt.date | None = None) -> DataFrame:
    return read_table(spark, published(spark, root, as_of)[key])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders of runs that the newest manifest does not name (for
    times without readers of older ones); returns them."""
    root = root.rstrip("/")
    _, content = manifest.latest(spark, root)
    used = {folder for tables in content.values() for folder in tables.values()}
    gone = []
    for name in TABLES.values():
        for day in files.folder_names(spark, f"{root}/{name}"):
            for run in files.folder_names(spark, f"{root}/{name}/{day}"):
                if run.startswith("run=") and f"{name}/{day}/{run}" not in used:
                    gone.append(f"{name}/{day}/{run}")
    for folder in gone:
        files.delete(spark, f"{root}/{folder}")
    return gone
