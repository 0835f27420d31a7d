"""Numbered manifests: which folders make up a set of tables right now.

A set is published by writing manifest n + 1 after all of its folders. Readers
take the highest number and open only the folders it names, so a run that dies
half-way leaves the set before it as it was, and a set is never mixed from two
runs. Two runs that build on the same manifest cannot both publish: the second
one finds its number taken (`ConcurrentPublish`) and changes nothing.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from clickfold.sources import files


class ConcurrentPublish(RuntimeError):
    """Another run has published since this one read the manifest."""


def _path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_manifests/{version:012d}.json"


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(version, content) of the newest manifest; (0, {}) without any."""
    names = [n for n in files.file_names(spark, f"{root.rstrip('/')}/_manifests") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        return 0, {}
    version = int(names[-1].removesuffix(".json"))
    return version, json.loads(files.read_text(spark, _path(root, version)))


def publish(spark: SparkSession, root: str, after: int, content: dict) -> int:
    """Write `content` as the manifest that follows number `after`."""
    try:
        files.write_once(spark, _path(root, after + 1), json.dumps(content, sort_keys=True))
    except Py4JJavaError as e:
        if files.exists(spark, _path(root, after + 1)):
            raise ConcurrentPublish(f"{root}: manifest {after + 1} is there already") from e
        raise
    return after + 1
