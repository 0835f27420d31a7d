"""Day store: incremental refresh equals a full run; only new or changed
shards are read; published sets are whole."""

import datetime as dt
import os
import re
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from clickfold.functions.params import event_param, session_id, shredded_params, strict_params
from clickfold.operators import attribution, rollups, sessions
from clickfold.plans import daily, published
from clickfold.plans.daystore import DayStore, ShreddedEvents
from clickfold.sources import files, fixture, manifest
from clickfold.sources.events import read_events, read_table
from clickfold.sources.fixture import buyers_for, campaign_table, export_for, export_path, shard_folders_for
from clickfold.sources.shards import PartitionedExport, ShardFolders
from tests.helpers import AS_OF, at, ev, events

SF = "/root/testdata/sf0.001"
YESTERDAY = AS_OF - dt.timedelta(days=1)


def folder(tag):
    return tempfile.mkdtemp(prefix=f"clickfold-{tag}-", dir="/tmp")


def norm(df):
    df = df.select(*[F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in sorted(df.dtypes)])
    return sorted(map(repr, df.collect()))


@pytest.fixture
def export(spark):
    """A copy of the export on a local folder, to be changed."""
    export_for(spark, SF)
    path = f"{folder('export')}/events"
    shutil.copytree(export_path(spark, SF).removeprefix("file:"), path)
    return path


def garble(path):
    """Overwrite data files, keeping length and time: whoever reads one fails."""
    for root, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                s = os.stat(f"{root}/{n}")
                open(f"{root}/{n}", "wb").write(b"x" * s.st_size)
                os.utime(f"{root}/{n}", ns=(s.st_atime_ns, s.st_mtime_ns))
                if os.path.exists(f"{root}/.{n}.crc"):
                    os.remove(f"{root}/.{n}.crc")


def test_run_of_the_next_day_reads_two_dates_and_equals_a_full_run(spark, export):
    b, c = buyers_for(spark, SF), campaign_table(spark)
    full = daily.save_reports(spark, read_events(spark, export), b, c, AS_OF, folder("full"))
    store, source = DayStore(spark, folder("store")), PartitionedExport(export)
    first = store.refresh(source, YESTERDAY)
    assert len(first) >= 25
    for day in os.listdir(export):  # any read of an older day fails from here on
        if day.startswith("event_date=") and day[11:] < "20240129":
            garble(f"{export}/{day}")
    new = store.refresh(source, AS_OF)
    assert {d for d, _ in new} <= {"20240129", "20240130"}
    paths = daily.save_reports(spark, read_events(spark, export), b, c, AS_OF, folder("inc"), store=store)
    assert set(paths) == set(full)
    for key in full:
        assert norm(read_table(spark, paths[key])) == norm(read_table(spark, full[key])), key
    assert store.refresh(source, AS_OF) == []


def test_rewritten_and_removed_shards(spark, export):
    store, source = DayStore(spark, folder("store")), PartitionedExport(export)
    store.refresh(source, AS_OF)
    day = f"{export}/event_date=20240115/export_kind=daily"
    late = read_events(spark, export).where("event_date = '20240115'").drop("event_date", "export_kind")
    late = late.withColumn("user_id", F.lit("999")).limit(3).unionByName(late).collect()
    shutil.rmtree(day)
    spark.createDataFrame(late, read_events(spark, export).drop("event_date", "export_kind").schema).coalesce(1).write.parquet(day)
    shutil.rmtree(f"{export}/event_date=20240110")
    assert store.refresh(source, AS_OF) == [("20240115", "daily")]
    fresh = read_events(spark, export)
    for r in (rollups.SESSIONS, rollups.ITEMS, rollups.ACQUISITION, rollups.FUNNEL, rollups.CONVERSIONS):
        assert norm(store.merged(r, AS_OF, 60)) == norm(r.merged(r.per_shard(fresh.where("event_date >= '20231201'")))), r.name
    before = norm(store.merged(rollups.SESSIONS, AS_OF, 60))
    gone = store.vacuum()
    assert gone and all("event_date=20240115" in f or "event_date=20240110" in f for f in gone)
    assert norm(store.merged(rollups.SESSIONS, AS_OF, 60)) == before


def test_refresh_that_dies_leaves_the_store_as_it_was(spark, export, monkeypatch):
    store, source = DayStore(spark, folder("store")), PartitionedExport(export)
    store.refresh(source, YESTERDAY)
    before, version = norm(store.merged(rollups.SESSIONS, AS_OF, 60)), manifest.latest(spark, store.root)[0]
    write, calls = DayStore._write, []

    def dies(self, rollup, rows, path):
        calls.append(rollup.name)
        if len(calls) == 3:
            raise RuntimeError("executor lost")
        write(self, rollup, rows, path)

    monkeypatch.setattr(DayStore, "_write", dies)
    with pytest.raises(RuntimeError):
        store.refresh(source, AS_OF)
    monkeypatch.undo()
    assert manifest.latest(spark, store.root)[0] == version and norm(store.merged(rollups.SESSIONS, AS_OF, 60)) == before
    assert store.refresh(source, AS_OF)


def moved_columns(df):
    """Names of the columns that enter the sorts and exchanges of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    inputs = re.findall(r"\n\(\d+\) (?:Sort|Exchange)\n\s*Input \[\d+\]: \[([^\n]*)\]", text)
    return [set(re.findall(r"(\w+)#\d+", i)) for i in inputs]


@pytest.mark.parametrize("rollup", rollups.ROLLUPS.values(), ids=lambda r: r.name)
def test_events_are_narrow_before_they_are_sorted_or_shuffled(spark, rollup):
    moved = moved_columns(rollup.per_shard(export_for(spark, SF)))
    assert moved
    for columns in moved:
        assert columns and not columns & {"event_params", "items", "traffic_source"}


def test_export_is_shuffled_and_sorted_flat_and_keeps_its_order(spark):
    flat = spark.read.parquet(f"{SF}/events.parquet")
    moved = moved_columns(fixture._in_shard_order(flat))
    assert len(moved) >= 2 and not any(c & {"event_params", "items", "geo", "traffic_source"} for c in moved)
    for path in export_for(spark, SF).inputFiles():
        rows = [tuple(r) for r in spark.read.parquet(path).select("event_name", "user_pseudo_id").collect()]
        assert rows == sorted(rows)
    want = fixture.nested_events(flat)
    assert norm(export_for(spark, SF).select(*want.columns)) == norm(want)


def test_strict_lookups_of_a_rollup_are_those_of_its_states(spark):
    def states(name):
        rows = [ev("u", at(3), name, params={"ga_session_number": [1, 2], "source": "a"}), ev("u", at(3, 13), "session_start", params={"ga_session_number": 3})]
        with strict_params():
            return rollups.ACQUISITION.per_shard(events(spark, rows)).collect()

    assert [(r["session_number"], r["event_count"], r["_first_source"]["v"]) for r in states("page_view")] == [(3, 2, "a")]
    with pytest.raises(Exception, match="more than once"):
        states("session_start")


def test_two_publishers_on_one_manifest(spark):
    root = folder("manifest")
    assert manifest.latest(spark, root) == (0, {})
    assert manifest.publish(spark, root, 0, {"a": 1}) == 1
    with pytest.raises(manifest.ConcurrentPublish):
        manifest.publish(spark, root, 0, {"a": 2})
    assert manifest.latest(spark, root) == (1, {"a": 1})
    assert manifest.publish(spark, root, 1, {"a": 3}) == 2 and manifest.latest(spark, root) == (2, {"a": 3})


def test_empty_window(spark):
    store = DayStore(spark, folder("store"))
    path = folder("export")
    events(spark, [ev("u", at(3), "page_view")]).write.partitionBy("event_date", "export_kind").parquet(f"{path}/e")
    store.refresh(PartitionedExport(f"{path}/e"), AS_OF)
    assert store.merged(rollups.SESSIONS, AS_OF, 60).count() == 1
    assert store.merged(rollups.SESSIONS, AS_OF, 2).count() == 0 and store.merged(rollups.ITEMS, AS_OF, 60).count() == 0


@pytest.mark.parametrize("stop_at", [0, 1, 7, 15])
def test_published_set_stays_whole_when_a_run_stops(spark, monkeypatch, stop_at, root=folder("published")):
    e, b, c = export_for(spark, SF), buyers_for(spark, SF), campaign_table(spark)
    if stop_at == 0:
        with pytest.raises(LookupError):
            published.published(spark, root)
        paths = published.publish_reports(spark, e, b, c, AS_OF, root)
        assert published.published(spark, root) == paths and set(paths) == set(daily.TABLES)
        return
    before = published.published(spark, root)
    write, done = daily.write_table, []

    def stops(df, path, **kw):
        if len(done) == stop_at:
            raise KeyboardInterrupt
        done.append(path)
        write(df, path, **kw)

    monkeypatch.setattr(daily, "write_table", stops)
    with pytest.raises(KeyboardInterrupt):
        published.publish_reports(spark, e, b, c, AS_OF, root)
    assert len(done) == stop_at and published.published(spark, root) == before
    assert all(read_table(spark, p).columns for p in before.values())
    monkeypatch.undo()
    if stop_at == 15:
        again = published.publish_reports(spark, e, b, c, AS_OF, root)
        assert all(again[k] != before[k] and norm(read_table(spark, again[k])) == norm(read_table(spark, before[k])) for k in again)
        assert published.vacuum(spark, root) and all(files.exists(spark, p) for p in again.values())
        assert not any(files.exists(spark, p) for p in before.values())
        assert norm(published.read_published(spark, root, "r12", AS_OF)) == norm(read_table(spark, again["r12"]))


def test_command_line_with_store_shard_folders_and_published_set(spark):
    d = folder("cli")
    source = shard_folders_for(spark, SF)
    buyers_for(spark, SF).write.parquet(f"{d}/buyers")
    campaign_table(spark).write.parquet(f"{d}/campaigns")
    daily.main([
        "--events", source.path, "--layout", "shards", "--store", f"{d}/store", "--buyers", f"{d}/buyers",
        "--campaigns", f"{d}/campaigns", "--publish-to", f"{d}/sets", "--as-of", AS_OF.isoformat(),
    ])
    want = daily.save_reports(spark, export_for(spark, SF), buyers_for(spark, SF), campaign_table(spark), AS_OF, f"{d}/plain")
    for key, path in want.items():
        assert norm(published.read_published(spark, f"{d}/sets", key)) == norm(read_table(spark, path)), key


def test_shard_folders_open_only_the_window(spark):
    path = folder("shards")
    shutil.copytree(shard_folders_for(spark, SF).path.removeprefix("file:"), f"{path}/e")
    df = ShardFolders(f"{path}/e").events(spark)
    want = df.where("event_date >= '20240129'").count()
    for shard in os.listdir(f"{path}/e"):
        if not shard.endswith(("20240129", "20240130")):
            garble(f"{path}/e/{shard}")
    assert df.where("event_date >= '20240129'").count() == want > 0


def test_shards_of_older_schemas_and_other_folders(spark):
    path = folder("shards")
    rows = events(spark, [ev("u", at(3), "purchase", items=[("a", "b", 1.0, 2, 3.0)], revenue=5.0)]).drop("event_date", "export_kind")
    rows.write.parquet(f"{path}/events_20240103")
    old = rows.select(
        "event_timestamp", "event_name", "event_params", "user_pseudo_id", F.lit(1).alias("extra"),
        F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), i["quantity"].cast("int").alias("quantity"))).alias("items"),
    )
    old.write.parquet(f"{path}/events_intraday_20240104")
    rows.write.parquet(f"{path}/events_backup")
    source = ShardFolders(path)
    assert set(source.shards(spark)) == {("20240103", "daily"), ("20240104", "intraday")}
    got = {r["event_date"]: r for r in source.events(spark).select("*", session_id().alias("sid")).collect()}
    assert got["20240103"]["items"][0]["item_revenue"] == 3.0 and got["20240103"]["export_kind"] == "daily"
    r = got["20240104"]
    assert (r["user_id"], r["ecommerce"], r["sid"], r["items"][0]["quantity"], r["items"][0]["price"]) == (None, None, 1000, 2, None)
    assert ShardFolders(folder("none")).events(spark).count() == 0


def test_shredded_events_read_no_array_and_follow_the_rules(spark):
    path = folder("shredded")
    twice = ev("u", at(3), "page_view", params={"source": ["a", "b"], "other": "x", "medium": 5})
    rows = events(spark, [twice, ev("v", at(4), "purchase", sid=None)])
    rows = rows.unionByName(rows.where("user_pseudo_id = 'v'").withColumn("event_params", F.lit(None).cast(rows.schema["event_params"].dataType)))
    rows.write.partitionBy("event_date", "export_kind").parquet(f"{path}/e")
    store = ShreddedEvents(spark, f"{path}/s")
    store.refresh(PartitionedExport(f"{path}/e"), AS_OF)
    asked = [("ga_session_id", "int"), ("source", "string"), ("medium", "string"), ("medium", "int"), ("campaign", "string")]
    want = read_events(spark, f"{path}/e").select("user_pseudo_id", *[event_param(k, t).alias(f"{k}_{t}") for k, t in asked])
    with shredded_params():
        got = store.events().select("user_pseudo_id", *[event_param(k, t).alias(f"{k}_{t}") for k, t in asked])
        assert norm(got) == norm(want) and got.count() == 3
        source = store.events().where("user_pseudo_id = 'u'")
        with pytest.raises(Exception, match="more than once"):
            source.select(event_param("source", strict=True)).collect()
        assert source.select(event_param("medium", "int", strict=True)).first()[0] == 5
        plan = sessions.session_source(store.events(), AS_OF, 60)._jdf.queryExecution().executedPlan().toString()
    schemas = [ln for ln in plan.split("\n") if "ReadSchema" in ln]
    assert schemas and not any("array" in s or "page_title" in s for s in schemas) and all("ga_session_id" in s for s in schemas)
    assert plan.count("FileScan") == 2
    with shredded_params():
        one_day = sessions.session_source(store.events(), dt.date(2024, 1, 4), 0)._jdf.queryExecution().executedPlan().toString()
    assert one_day.count("FileScan") == 1


def test_bitmap_semi_join_keeps_buyers_and_little_else(spark, monkeypatch):
    e = export_for(spark, "/root/testdata/sf0.01")
    conv = attribution.first_conversion(e, AS_OF, 30)
    buyers_only = e.join(conv.select("user_pseudo_id"), "user_pseudo_id", "left_semi").count()
    seen = {}
    members = attribution.only_members

    def spy(rows, *args, **kw):
        out = members(rows, *args, **kw)
        seen["rows"], seen["plan"] = out.count(), out._jdf.queryExecution().executedPlan().toString()
        seen["kept"] = out.join(conv.select("user_pseudo_id"), "user_pseudo_id", "left_semi").count()
        return out

    want = {d: norm(attribution.attribution(e, AS_OF, 30, 30, d)) for d in (rollups.SM, rollups.SMC)}
    monkeypatch.setattr(attribution, "BROADCAST_USERS", 0)
    monkeypatch.setattr(attribution, "only_members", spy)
    for d, rows in want.items():
        assert norm(attribution.attribution(e, AS_OF, 30, 30, d)) == rows
    window = e.where("event_date between '20231201' and '20240129' and export_kind = 'daily'")
    exact = window.join(conv.select("user_pseudo_id"), "user_pseudo_id", "left_semi").count()
    assert seen["kept"] == exact and exact <= seen["rows"] <= exact + 0.01 * window.count() + 1 and buyers_only
    assert "BroadcastHashJoin" in seen["plan"] and "SortMergeJoin" not in seen["plan"]


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 17, 1 << 28])
def test_bitmap_never_loses_a_key(spark, max_bits):
    from clickfold.operators.membership import bitmap_size, only_members

    keys = spark.range(0, 60_000, 3).select(F.concat(F.lit("u"), "id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    rows = spark.range(60_000).select(F.concat(F.lit("u"), "id").alias("k"), "id").unionByName(spark.createDataFrame([(None, 0)], "k string, id long"))
    out = only_members(rows, keys, "k", 20_000, max_bits=max_bits)
    assert out.where("id % 3 = 0").count() == 20_000 and out.where("k is null").count() == 0
    others, bits = out.where("id % 3 <> 0").count(), bitmap_size(20_000, max_bits=max_bits)
    assert abs(others / 40_000 - (1 - (1 - 1 / bits) ** 20_000)) < 0.02
