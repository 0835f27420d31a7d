"""Test fixture: build the nested event export from the driver's flat tables.

The driver ships `events(event_id, ts, user_id, event_type, value, props)` and
`customer`. The mapping below (spelled out in FIXTURES.md) turns each flat row
into one export row with `event_params`, `items`, `geo`, ... so the reports run
on real nested input, while the DuckDB oracle works from the flat columns.
It is a row-wise projection: it partitions and scales with the flat table.
Day arithmetic uses floor division and a non-negative modulo, so the mapping
is also defined (and equal to the oracle's) for days before 2024-01-01; on
the driver's data it is exactly FIXTURES.md.
"""

from __future__ import annotations

import hashlib
import os
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.schema import CAMPAIGN_METRICS, CAMPAIGN_SCHEMA, EVENT_SCHEMA
from clickfold.session import ensure_checkpoint_dir
from clickfold.sources import files
from clickfold.sources.events import read_events
from clickfold.sources.shards import PartitionedExport, ShardFolders

FIXTURE_VERSION = "4"

# --- fixed values of the fixture mapping (FIXTURES.md section 3) -----------
EPOCH_DAY = "2024-01-01"
SESSION_BASE_SECONDS = 1704067200
INTRADAY_DATE = "2024-01-30"
EVENT_NAMES = {
    "view": "page_view",
    "click": "add_to_cart",
    "purchase": "purchase",
    "signup": "session_start",
    "error": "user_engagement",
}
PAGE_TITLES = [
    "Home | Demo", "Shows  | Demo", "Tickets | Demo", "Plain title", None, "Ho\rme | Demo", "Late\u2028show\x0b\x85 | Demo",
]
# (source, medium, campaign); None = parameter absent
TRAFFIC_LIST = [
    ("google", "cpc", "brand"), ("google", "organic", None), ("bing", "ppc", "fall"),
    ("facebook", "paid-social", "fb1"), ("instagram", "social", "ig"), ("youtube", "cpc", "yt1"),
    ("vimeo", "video", "vm"), ("amazon", "cpc", "shopping-a"), ("etsy", "referral", "crafts"),
    ("newsletter", "email", "oct-news"), ("newsletter", "email", "nov-news"),
    ("partner", "affiliate", "aff1"), ("blog", "referral", None), ("podcast", "audio", "pod"),
    ("sms", "sms", "txt"), ("app", "web push", "wp"), ("app", "mobile-notification", "mn"),
    ("adnet", "display", "ban"), ("x", "cpc", "cross-network"), ("unknownsite", "other", "misc"),
    ("(direct)", "(not set)", None), ("dm", "e-mail", "dm1"), ("google", "cpc", "shop-sale"),
    (None, "email", "oct-news"),
]
# Every alternative of the channel rules, combined by q = event_id div 7 on
# events with event_id % 7 = 3 (list lengths share no factor).
ALT_SOURCES = [
    "alibaba", "amazon", "google shopping", "shopify", "etsy", "ebay", "stripe", "walmart",
    "baidu", "bing", "duckduckgo", "ecosia", "google", "yahoo", "yandex",
    "badoo", "facebook", "fb", "instagram", "linkedin", "pinterest", "tiktok", "twitter", "whatsapp",
    "dailymotion", "disneyplus", "netflix", "youtube", "vimeo", "twitch",
    "email", "e-mail", "e_mail", "e mail", "(direct)", "plain", None,
]
ALT_MEDIUMS = [
    "cpc", "ppc", "paid", "paid\rx", "a\rcpc", "xcp\u2028y", "organic", "(none)", "(not set)",
    "display", "banner", "expandable", "interstitial", "cpm",
    "social", "social-network", "social-media", "sm", "social network", "social media",
    "a video b", "vi\x85 video", "email", "e-mail", "e_mail", "e mail", "affiliate", "referral", "audio", "sms",
    "web push", "mobile", "app notification", "misc", "ppc\n", None,
]
ALT_CAMPAIGNS = [None, "brand", "cross-network x", "e-shop", "a\rshopping"]
# traffic_source by user_id % 4, one further on events with k % 9 = 0
FIRST_USER_TRAFFIC = [
    ("google", "cpc", "brand"), (None, None, None),
    ("newsletter", "email", "oct-news"), ("facebook", "social", "fb1"),
]
SKU_NAME_PREFIX = "Show "  # item name of SKU{n} is "Show {n}"
DONATION = ("Donation", "Annual fund")
FEES = ("Fees", "Handling")
GIFT = ("hd3g4y", "Gift")
# Mailing table of the e-mail platform: literal rows, metrics as text.
CAMPAIGN_ROWS = [
    ("oct-news", "2023-10-03", "1200", "640", "410", "95", "71", "60", "12", "9", "14", "6", "8", "3", "5", "4", "2"),
    ("oct-news", "2023-10-24", "1180", "600", "398", "88", "64", "55", "10", "8", "11", "4", "7", None, "4", "3", "1"),
    ("nov-news", "2023-11-07", "1310", "702", "455", "120", "90", "81", "15", "12", "9", "5", "6", "2", "6", "5", "3"),
    ("never-used", "2023-12-01", "900", "300", "250", "40", "33", "30", "4", "4", "7", "2", "3", "1", "1", "1", "0"),
]
# ---------------------------------------------------------------------------


def _sparam(key: str, value: Column) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(
            F.lit(key).alias("key"),
            F.struct(value.cast("string").alias("string_value"), F.lit(None).cast("bigint").alias("int_value")).alias("value"),
        ),
    )


def _iparam(key: str, value: Column) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(
            F.lit(key).alias("key"),
            F.struct(F.lit(None).cast("string").alias("string_value"), value.cast("bigint").alias("int_value")).alias("value"),
        ),
    )


def _lit_triples(rows, names) -> Column:
    return F.array(*[
        F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(row, names)]) for row in rows
    ])


def _item(item_id: Column, name: Column, price: Column, qty: Column, revenue: Column) -> Column:
    return F.struct(
        item_id.alias("item_id"), name.alias("item_name"), price.alias("price"),
        qty.alias("quantity"), revenue.alias("item_revenue"),
    )


def _epoch_micros(flat: DataFrame) -> Column:
    """Microseconds since the epoch of `ts`, whatever the session time zone:
    a TIMESTAMP_NTZ (Spark's default for this file) is wall-clock UTC, a
    TIMESTAMP already is an instant."""
    if isinstance(flat.schema["ts"].dataType, T.TimestampNTZType):
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return F.unix_micros(F.col("ts"))


def nested_events(flat: DataFrame) -> DataFrame:
    """Project the flat driver table onto EVENT_SCHEMA. Every date is taken
    from the microsecond time by arithmetic, so no session time zone enters."""
    return _nested(_placed(flat))


def _placed(flat: DataFrame) -> DataFrame:
    """Flat rows with what places them in the export: shard, event name, user."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint")
    micros = _epoch_micros(flat)
    day = F.date_from_unix_date(F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    base = flat.select(
        "event_id", "user_id", "event_type", "value",
        k.alias("_k"),
        micros.alias("_us"),
        day.alias("_day"),
        F.datediff(day, F.lit(EPOCH_DAY).cast("date")).alias("_dd"),
    )
    name = F.col("event_type")
    event_name = F.lit(None).cast("string")
    for src, dst in reversed(list(EVENT_NAMES.items())):
        event_name = F.when(name == src, F.lit(dst)).otherwise(event_name)
    return base.select(
        "event_id", "user_id", "value", "_k", "_us", "_dd",
        event_name.alias("event_name"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_pseudo_id"),
        F.date_format("_day", "yyyyMMdd").alias("event_date"),
        F.when(F.col("_day") == F.lit(INTRADAY_DATE).cast("date"), F.lit("intraday"))
        .otherwise(F.lit("daily")).alias("export_kind"),
    )


def _nested(placed: DataFrame) -> DataFrame:
    """Placed rows as events, row by row."""
    k, dd, uid, eid, value, event_name = (F.col(c) for c in ("_k", "_dd", "user_id", "event_id", "value", "event_name"))

    # floor division and non-negative modulo: the mapping stays defined (and
    # equal to the oracle's) for days before the epoch day too
    j = F.when(k % 10 == 0, k % 24).otherwise(F.pmod(uid * 7 + F.floor(dd / 3), F.lit(24))).cast("int")
    traffic = F.get(_lit_triples(TRAFFIC_LIST, ("source", "medium", "campaign")), j)
    has_traffic = k % 4 != 0
    q, is_alt = F.floor(eid / 7), eid % 7 == 3

    def label(part: str, alternatives: list) -> Column:
        alt = F.get(F.array(*[F.lit(a).cast("string") for a in alternatives]), (q % len(alternatives)).cast("int"))
        return F.when(has_traffic, F.when(is_alt, alt).otherwise(traffic[part]))

    session = F.when(eid % 37 != 0, F.lit(SESSION_BASE_SECONDS) + (dd - F.pmod(dd, F.lit(3))) * 86400)
    title = F.get(F.array(*[F.lit(t).cast("string") for t in PAGE_TITLES]), (k % 7).cast("int"))
    engaged = eid % 3
    params = F.array(
        _iparam("ga_session_id", session),
        _sparam("page_title", F.when(event_name == "page_view", title)),
        _iparam("ga_session_number", F.when(event_name == "session_start", eid % 4 + 1).otherwise(F.lit(99))),
        _sparam("session_engaged", F.when(engaged == 0, F.lit("1")).when(engaged == 2, F.lit("0"))),
        _iparam("session_engaged", F.when(engaged == 1, F.lit(1))),
        _iparam("engagement_time_msec", F.when(eid % 2 == 0, F.floor(value * 1000))),
        _sparam("source", label("source", ALT_SOURCES)),
        _sparam("medium", label("medium", ALT_MEDIUMS)),
        _sparam("campaign", label("campaign", ALT_CAMPAIGNS)),
    )
    event_params = F.array_compact(params)

    is_purchase = event_name == "purchase"
    price = (
        F.when(k % 20 == 0, F.lit(0.0005) * (k % 3 + 1).cast("double"))
        .when((k % 20 == 1) & (event_name == "add_to_cart"), F.lit(12345678.25) + (k % 3).cast("double"))
        .otherwise(F.floor(value).cast("double") + k.cast("double") / F.lit(100.0))
    )
    qty = (k % 3 + 1).cast("bigint")
    revenue = F.when(is_purchase, price * qty)

    def it(item_id, item_name):
        return _item(item_id.cast("string"), item_name.cast("string"), price, qty, revenue)

    sku = F.concat(F.lit("SKU"), (k % 7).cast("string"))
    sku_name = F.concat(F.lit(SKU_NAME_PREFIX), (k % 7).cast("string"))
    shape = k % 4
    items = (
        F.when(~event_name.isin("add_to_cart", "purchase"), F.array().cast(EVENT_SCHEMA["items"].dataType))
        .when(shape == 0, F.array(it(sku, sku_name)))
        .when(shape == 1, F.array(it(sku, sku_name), it(F.lit(DONATION[0]), F.lit(DONATION[1]))))
        .when(shape == 2, F.array(it(F.lit(FEES[0]), F.lit(FEES[1]))))
        .otherwise(F.array(it(F.lit(GIFT[0]), F.lit(GIFT[1])), it(F.lit(FEES[0]), F.lit(FEES[1]))))
    )
    first_user = F.get(_lit_triples(FIRST_USER_TRAFFIC, ("source", "medium", "name")), ((uid + (k % 9 == 0).cast("int")) % 4).cast("int"))
    geo = F.struct(
        F.concat(F.lit("R"), ((uid + k % 2) % 5).cast("string")).alias("continent"),
        F.concat(F.lit("S"), ((uid + k % 3) % 10).cast("string")).alias("sub_continent"),
        F.concat(F.lit("C"), ((uid + k % 5) % 25).cast("string")).alias("country"),
        F.concat(F.lit("G"), ((uid + k % 7) % 40).cast("string")).alias("region"),
        F.when(k % 6 != 0, F.concat(F.lit("T"), (uid % 50).cast("string"))).alias("city"),
        F.concat(F.lit("M"), ((uid + k % 4) % 20).cast("string")).alias("metro"),
    )
    out = placed.select(
        F.col("_us").alias("event_timestamp"),
        "event_name",
        event_params.alias("event_params"),
        F.when(uid % 5 == 2, F.when(k % 2 == 0, F.lit("9")).otherwise(F.lit("10")))
        .when(uid % 3 != 0, uid.cast("string")).alias("user_id"),
        "user_pseudo_id",
        items.alias("items"),
        F.struct(F.when(is_purchase, value).alias("purchase_revenue")).alias("ecommerce"),
        first_user.alias("traffic_source"),
        geo.alias("geo"),
        "event_date",
        "export_kind",
    )
    return out.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])


def buyers_from_customers(customer: DataFrame) -> DataFrame:
    """Flags by c_custkey % 4; every tenth buyer is listed a second time, as renewing."""
    c = F.col("c_custkey")
    flag = lambda r: F.when(c % 4 == r, F.lit(1)).otherwise(F.lit(0)).cast("int")
    one, none = F.lit(1).cast("int"), F.lit(0).cast("int")
    own = F.struct(flag(0).alias("new"), flag(1).alias("renew"), flag(2).alias("lapsed"))
    again = F.struct(none.alias("new"), one.alias("renew"), none.alias("lapsed"))
    listed = F.explode(F.when(c % 10 == 0, F.array(own, again)).otherwise(F.array(own)))
    return customer.select(c.cast("bigint").alias("const_id"), listed.alias("f")).select("const_id", "f.*")


def campaign_table(spark: SparkSession) -> DataFrame:
    """The mailing table fixture (CAMPAIGN_ROWS) with the text schema."""
    assert len(CAMPAIGN_SCHEMA.fields) == 2 + len(CAMPAIGN_METRICS)
    return spark.createDataFrame(CAMPAIGN_ROWS, CAMPAIGN_SCHEMA)


def export_path(spark: SparkSession, sf_dir: str) -> str:
    """Where this session keeps the export built from `sf_dir` (under the
    session's shared checkpoint folder; one copy per application)."""
    root = ensure_checkpoint_dir(spark)
    tag = hashlib.sha1(f"{os.path.abspath(sf_dir)}|{FIXTURE_VERSION}".encode()).hexdigest()[:12]
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/fixture-export-{app}-{tag}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


_BUILD_LOCK = threading.Lock()
_OPENED: dict[str, DataFrame] = {}


def export_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export for a driver data folder, written once per session
    as a date/kind-partitioned Parquet dataset and read back with the fixed
    schema, exactly as a production export would be read. Within a day the
    rows are clustered by event name, so the reports' pushed event-name
    filters can skip Parquet row groups."""
    path = export_path(spark, sf_dir)
    with _BUILD_LOCK:
        if path in _OPENED:
            return _OPENED[path]  # listed once per application
        if not _exists(spark, path):
            flat = spark.read.parquet(f"{sf_dir}/events.parquet")
            _in_shard_order(flat).write.mode("overwrite").partitionBy("event_date", "export_kind").parquet(path)
        _OPENED[path] = read_events(spark, path)
        return _OPENED[path]


def _in_shard_order(flat: DataFrame) -> DataFrame:
    """The events dealt out by shard, in the order in which they are written.

    Rows are shuffled and sorted flat and made nested after that, row by row:
    nested ones are several times as wide, on the wire and in the sort."""
    # never NULL, so the writer takes the column as it is and finds its order
    # (NULL and the empty text name the same folder)
    placed = _placed(flat).withColumn("event_date", F.coalesce("event_date", F.lit("")))
    # a rebalance, not a repartition: a day of any size becomes as many files
    # as its bytes ask for (AQE splits large partitions)
    dealt = placed.hint("rebalance", "event_date", "export_kind")
    return _nested(dealt.sortWithinPartitions("event_date", "export_kind", "event_name", "user_pseudo_id"))


def shard_folders_for(spark: SparkSession, sf_dir: str) -> ShardFolders:
    """The same export in folders named as its tables (`events_YYYYMMDD`,
    `events_intraday_YYYYMMDD`), written once per session."""
    path = export_path(spark, sf_dir) + "-shards"
    events = export_for(spark, sf_dir)
    with _BUILD_LOCK:
        if not files.exists(spark, f"{path}/_DONE"):
            events.hint("rebalance", "event_date", "export_kind").write.mode("overwrite").partitionBy("event_date", "export_kind").parquet(f"{path}-parts")
            for (day, kind), folder in PartitionedExport(f"{path}-parts").shards(spark).items():
                files.move(spark, folder, f"{path}/events_{'intraday_' if kind == 'intraday' else ''}{day}")
            files.write_once(spark, f"{path}/_DONE", "")
    return ShardFolders(path)


def nested_events_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as `export_for`, computed lazily without writing."""
    return nested_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def buyers_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buyers_from_customers(spark.read.parquet(f"{sf_dir}/customer.parquet"))


__all__ = [
    "CAMPAIGN_ROWS", "FIRST_USER_TRAFFIC", "TRAFFIC_LIST", "buyers_for", "buyers_from_customers",
    "campaign_table", "export_for", "nested_events", "nested_events_for", "shard_folders_for",
]
