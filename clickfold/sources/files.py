"""Folders and small files on the session's file systems (driver side)."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under `path`; none if it is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def file_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.isDirectory())


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the data files under `path`: name, length, time of change."""
    fs, p = _fs(spark, path)
    found = []
    files = fs.listFiles(p, True)
    while files.hasNext():
        s = files.next()
        name = s.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Create `path` with `text`, whole or not at all; an error if it exists.

    The text goes to a hidden file beside it, which then takes the name:
    readers never see a part of it, and of two writers one fails."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{hashlib.sha256(text.encode()).hexdigest()[:16]}")
    fs.mkdirs(p.getParent())
    stream = fs.create(hidden, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    none[0] = rename.getEnumConstants()[0]  # NONE: never over an existing file
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(fs.makeQualified(hidden), fs.makeQualified(p), none)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    jvm = spark.sparkContext._jvm
    q = jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
