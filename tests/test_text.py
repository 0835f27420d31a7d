import math
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from clickfold.functions.channels import channel_group
from clickfold.functions.text import landing_page_title, money_text
from oracle.base import channel_case


def plain(x: float) -> str:
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def test_money_text_over_the_whole_range(spark):
    rng = random.Random(4)
    xs = [0.0, 25.0, 25.5, 0.0005, 1e-7, 9999999.99, 1e7, 12345678.5, 1e15, 1e22, 1e29, 123456789012345680.0, 1.7e308, 5e-324, 100.0, 0.001]
    xs += [round(rng.uniform(0, 10 ** rng.randint(0, 9)), rng.randint(0, 6)) for _ in range(300)]
    xs += [-x for x in xs if x]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", money_text(F.col("x")).alias("t")).collect()
    for r in got:
        assert r["t"] is not None and "E" not in r["t"]
        assert float(r["t"]) == r["x"]
        if 1e-3 <= abs(r["x"]) < 1e15:
            assert r["t"] == plain(r["x"])
    want = {0.0005: "0.0005", 1e29: "1" + "0" * 29, 1e7: "10000000", 12345678.5: "12345678.5", -25.5: "-25.5", 0.0: "0"}
    by_x = {r["x"]: r["t"] for r in got}
    assert {x: by_x[x] for x in want} == want


def test_money_text_of_odd_values(spark):
    xs = [None, math.nan, math.inf, -math.inf]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(money_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [None, "NaN", "inf", "-inf"]


FRAGMENTS = ["google", "cpc", "ppc", "paid", "shop", "video", "email", "e", "push", "mobile", "social", " ", "|", "a", "Ho", "me",
             "\r", "\n", "\v", "\x85", "\u2028", "\u2029", "\t", "\f"]


@pytest.mark.parametrize("seed", [1, 2])
def test_regex_dialect_is_re2s(spark, seed):
    """Channel rules and titles on texts with every kind of line break and blank."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(FRAGMENTS, k=rng.randint(1, 5)))
    rows = [(i, text(), text(), text(), text()) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, s string, m string, c string, title string")
    got = df.select("i", channel_group("s", "m", "c").alias("g"), landing_page_title(F.col("title")).alias("t")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i INTEGER, s VARCHAR, m VARCHAR, c VARCHAR, title VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?, ?, ?)", rows)
    pattern = r"'^(.*?)\s*\|'"
    title = f"CASE WHEN regexp_matches(title, {pattern}) THEN regexp_extract(title, {pattern}, 1) END"
    want = con.execute(f"SELECT i, {channel_case('s', 'm', 'c')}, {title} FROM x").fetchall()
    assert sorted((r["i"], r["g"], r["t"]) for r in got) == sorted(want)


def test_strict_params_reach_the_reports(spark):
    from clickfold.functions.params import event_param, session_id, strict_params

    schema = "event_params array<struct<key: string, value: struct<string_value: string, int_value: bigint>>>"
    twice = spark.createDataFrame([([("ga_session_id", (None, 1)), ("ga_session_id", (None, 2))],)], schema)
    once = spark.createDataFrame([([("ga_session_id", (None, 1)), ("x", (None, 2))],)], schema)
    assert twice.select(session_id()).first()[0] == 1
    with strict_params():
        assert once.select(session_id()).first()[0] == 1
        with pytest.raises(Exception, match="more than once"):
            twice.select(session_id()).collect()
        assert twice.select(event_param("ga_session_id", "int", strict=False)).first()[0] == 1
    assert twice.select(session_id()).first()[0] == 1
