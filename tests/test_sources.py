"""Readers and writers (S1, S4-S6, S8): fixed schemas, partitioned export."""

import tempfile

from clickfold.schema import BUYER_SCHEMA, CAMPAIGN_SCHEMA, EVENT_SCHEMA
from clickfold.sources import read_buyers, read_campaigns, read_events, read_table, write_table
from clickfold.sources.fixture import buyers_for, campaign_table, export_for, nested_events_for

SF = "/root/testdata/sf0.001"


def test_export_roundtrip_keeps_schema_and_rows(spark):
    ev = export_for(spark, SF)
    assert ev.schema == EVENT_SCHEMA
    lazy = nested_events_for(spark, SF)
    assert ev.count() == lazy.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r[0] for r in ev.select("export_kind").distinct().collect()} == {"daily", "intraday"}


def test_lookup_readers(spark):
    d = tempfile.mkdtemp(prefix="clickfold-src-", dir="/tmp")
    buyers_for(spark, SF).write.parquet(f"{d}/buyers")
    b = read_buyers(spark, f"{d}/buyers")
    assert b.schema == BUYER_SCHEMA and b.count() == buyers_for(spark, SF).count() > spark.read.parquet(f"{SF}/customer.parquet").count()
    campaign_table(spark).write.option("header", True).csv(f"{d}/campaigns")
    c = read_campaigns(spark, f"{d}/campaigns", fmt="csv", header=True)
    assert c.schema == CAMPAIGN_SCHEMA
    assert sorted(r["name"] for r in c.collect()) == ["never-used", "nov-news", "oct-news", "oct-news"]


def test_write_and_read_partitioned_table(spark):
    d = tempfile.mkdtemp(prefix="clickfold-src-", dir="/tmp")
    ev = export_for(spark, SF).select("user_pseudo_id", "event_date", "event_name")
    write_table(ev, f"{d}/t", partition_by=("event_date",))
    back = read_table(spark, f"{d}/t")
    assert back.count() == ev.count()
    again = read_events(spark, export_for(spark, SF).inputFiles()[0].split("/event_date=")[0])
    assert again.count() == ev.count()
