"""Distinct counts of several keys per label, without DISTINCT.

`count(distinct a), count(distinct b), ...` expands every row once per counted
expression. Here a row becomes one entry per key, entries meet by (labels,
key) with a flag each, and the result counts the entries: one shuffle of
entries (combined map-side) and one of label rows. A label that holds most
rows is split by its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clickfold.functions.exact import exact_sum


def counted_by_key(
    rows: DataFrame, labels: list[str], keys: dict[str, tuple[Column, Column]], measures: dict[str, Column] | None = None
) -> DataFrame:
    """Per label set: for each `name: (key, flag)` the number of different
    non-NULL keys (`name`) and of those with a row whose flag holds
    (`name_flagged`), and the sums of the `measures`."""
    measures = measures or {}
    # the measures ride with the entry of the first key
    types = rows.select(*[m.alias(n) for n, m in measures.items()]).schema if measures else {}
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("which"), key.cast("string").alias("key"), F.coalesce(flag, F.lit(False)).cast("int").alias("flag"),
            *[(F.lit(None).cast(types[n].dataType) if i else m).alias(n) for n, m in measures.items()],
        )
        for i, (key, flag) in enumerate(keys.values())
    ])
    def total(n: str) -> Column:
        return exact_sum(n) if types[n].dataType == DoubleType() else F.sum(n)

    each = rows.select(*labels, F.explode(entries).alias("e")).select(*labels, "e.*")
    merged = each.groupBy(*labels, "which", "key").agg(F.max("flag").alias("flag"), *[total(n).alias(n) for n in measures])
    counts = []
    for i, name in enumerate(keys):
        mine = F.col("which") == i
        counts.append(F.count(F.when(mine, F.col("key"))).alias(name))
        counts.append(F.count(F.when(mine & (F.col("flag") == 1), F.col("key"))).alias(f"{name}_flagged"))
    return merged.groupBy(*labels).agg(*counts, *[total(n).alias(n) for n in measures])
