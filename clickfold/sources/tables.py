"""Intermediate tables in the session's shared checkpoint folder.

A relation that several branches of one report read (with different column
needs) would be recomputed per branch: Catalyst prunes each branch on its
own, so the plans differ and no exchange is shared. Writing it once as
Parquet and reading it back gives one computation, column pruning on the
read, and a lineage cut: a lost executor recomputes from the table, not
from the event scan.

`scratch_scope` removes the tables written inside it when it exits, for
jobs (like the daily run) that know when their intermediates are done; an
outer scope no longer holds what an inner one has deleted. A report called
on its own keeps its tables until `free_scratch(df)` or the end of the
application's folder, since its result reads them.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from clickfold.session import ensure_checkpoint_dir

_local = threading.local()


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` under `<spark checkpoint dir>/clickfold-tables/<app id>/`
    and return a DataFrame reading it (runs one job now). One folder per
    application, so a finished run's intermediates can be removed as one."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    path = f"{root}/clickfold-tables/{app}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    for scope in getattr(_local, "scopes", []):
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch_scope(spark: SparkSession, *, keep: bool = False) -> Iterator[list[str]]:
    """Collect the scratch tables written inside the block (this thread) and
    delete them on exit unless `keep`. DataFrames reading them must not be
    used after the block."""
    created: list[str] = []
    scopes = getattr(_local, "scopes", None)
    if scopes is None:
        scopes = _local.scopes = []
    scopes.append(created)
    try:
        yield created
    finally:
        # by identity: two open scopes may hold equal lists
        scopes[:] = [s for s in scopes if s is not created]
        if not keep:
            for path in created:
                _delete(spark, path)
            for outer in scopes:
                outer[:] = [p for p in outer if p not in created]


def free_scratch(df: DataFrame) -> list[str]:
    """Delete the scratch tables that `df` reads (once its result is used or
    saved); returns their paths. Only tables of this module are touched."""
    tables = sorted({m.group(0) for f in df.inputFiles() if (m := re.search(r".*/clickfold-tables/[^/]+/[^/]+(?=/)", f))})
    for path in tables:
        _delete(df.sparkSession, path)
    return tables
