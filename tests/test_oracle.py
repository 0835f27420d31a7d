"""

All keys run on sf0.001; a sample also runs on sf0.01 (the driver's scale)."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from clickfold.plans.registry import QUERIES
from oracle.compare import compare, duckdb_for
from oracle.queries import SQL

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    for key in ("r%02d" % i for i in range(1, 16)):
        assert any(k.startswith(key) for k in QUERIES), key
    for key in ("m%02d" % i for i in range(1, 23)):
        assert any(k.startswith(key) for k in QUERIES), key


def test_entry_point_offers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_point_without_the_optional_subpackage(tmp_path):
    """The library, its queries and the entry module stand without it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("clickfold", "oracle"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.strip() == f"{sorted(QUERIES)} {sorted(SQL)}"


@pytest.fixture(scope="module")
def con_small():
    return duckdb_for(SMALL)


@pytest.fixture(scope="module")
def con_medium():
    return duckdb_for(MEDIUM)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_sf0001(spark, con_small, name):
    r = compare(QUERIES[name](spark, SMALL), con_small, SQL[name])
    assert r.ok, r


@pytest.mark.skipif(not os.path.exists(MEDIUM), reason="sf0.01 not present")
@pytest.mark.parametrize(
    "name",
    ["r04_cart_abandonment", "r05_closed_funnel_by_date", "r09_email_campaign_stats",
     "r10_attribution_source_medium_10_10", "r11_attribution_source_medium_campaign",
     "r14_traffic_acquisition", "r15_user_acquisition", "m10_channel_group"],
)
def test_query_matches_oracle_sf001(spark, con_medium, name):
    r = compare(QUERIES[name](spark, MEDIUM), con_medium, SQL[name])
    assert r.ok, r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["date", "session_default_channel_group"]


def test_reports_do_not_depend_on_session_time_zone(spark, con_small):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")  # UTC+14
    try:
        for name in ("r05_closed_funnel_by_date", "r14_traffic_acquisition", "r10_attribution_source_medium_10_10"):
            r = compare(QUERIES[name](spark, SMALL), con_small, SQL[name])
            assert r.ok, (name, r)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
