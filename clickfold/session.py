"""Spark session defaults of the library; local sessions for tests and bench."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every report relies on. UTC matters for `timestamp_micros` and for
# dates derived from timestamps; AQE re-plans joins and coalesces/splits
# shuffle partitions at run time (skewed user keys included).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app: str = "clickfold",
    cores: int | str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """The session of this process, with the DEFAULT_CONF keys.

    Master, heap and shuffle partitions are those of the submit command; no
    argument, no setting. `cores` asks for a local session (tests, bench):
    it sets the master, as many shuffle partitions and a local heap.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        conf["spark.sql.shuffle.partitions"] = str(8 if cores == "*" else cores)
        conf["spark.driver.memory"] = os.environ.get("CLICKFOLD_DRIVER_MEMORY", "8g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    `spark.checkpoint.dir` names it. Where it is unset, a local session (one
    process, one disk) gets a scratch folder; on a cluster every executor
    would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not is_one_process(sc.master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set (master {sc.master}): name a folder that driver and executors share"
            )
        configured = tempfile.mkdtemp(prefix="clickfold-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def is_one_process(master: str) -> bool:
    """Whether the master runs everything in the driver's process."""
    return master == "local" or master.startswith("local[")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), for
    sessions whose workers do not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="clickfold-ship-")) / "clickfold_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted((root / "clickfold").rglob("*.py")):
                z.write(source, source.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
