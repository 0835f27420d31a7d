"""Order of final results, independence of file layout, export layout."""

import os

import pytest
from pyspark.sql import functions as F

from clickfold.operators import commerce
from clickfold.plans.registry import AS_OF, QUERIES
from clickfold.sources.fixture import export_for, export_path, nested_events

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "name,keys",
    [
        ("r02_buyer_behavior_by_campaign", [("count_purchasing_user_pseudo_id", True)]),
        ("r09_email_campaign_stats", [("total_product_revenue", True)]),
        ("r14_traffic_acquisition", [("total_users", True)]),
        ("r15_user_acquisition", [("total_users", True)]),
        ("r05_closed_funnel_by_date", [("session_date", False), ("sessions_page_view", True)]),
    ],
)
def test_final_order(spark, name, keys):
    """Ascending with nulls first, descending (True) with nulls last."""
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) > 3
    for a, b in zip(rows, rows[1:]):
        for col, desc in keys:
            x, y = a[col], b[col]
            if x == y:
                continue
            if x is None or y is None:
                assert (y is None) if desc else (x is None), (col, x, y)
            else:
                assert x > y if desc else x < y, (col, x, y)
            break


def test_cart_text_does_not_depend_on_the_layout(spark):
    events = export_for(spark, SF)
    results = []
    for n in (None, 1, 50):
        e = events if n is None else events.repartition(n)
        results.append(sorted(map(tuple, commerce.cart_abandonment(e, AS_OF, 10).collect()), key=str))
    assert results[0] == results[1] == results[2] and len(results[0]) > 20
    text = " ".join(r[-1] for r in results[0] if r[-1])
    assert "0.0005" in text and "12345678.25" in text and "E" not in text.replace("Each", "")


def test_a_large_day_becomes_many_files(spark, tmp_path):
    """No task per day: the export of one single day is cut by its size."""
    key, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    flat = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.expr("timestamp_ntz'2024-01-05 10:00:00'"))
    for i in range(2):
        flat = flat.union(flat)
    flat.write.parquet(f"{tmp_path}/one_day/events.parquet")
    spark.conf.set(key, "64k")
    try:
        n = export_for(spark, f"{tmp_path}/one_day").count()
    finally:
        spark.conf.set(key, before)
    files = [f for _, _, names in os.walk(export_path(spark, f"{tmp_path}/one_day").removeprefix("file:")) for f in names if f.endswith(".parquet")]
    assert n == flat.count() == nested_events(flat).count()
    assert len(files) > 3
