"""Query catalog: every report and reusable operator as a callable
``(spark, sf_dir) -> DataFrame`` over the driver's data.

The nested export is built from `sf_dir` once per session (see
`sources.fixture.export_for`) and every query reads it through its
date-partitioned window. Parameters are pinned (`as_of = 2024-01-30`);
`_10d` variants rerun a window operator on 10 days so that a wrong window
bound changes the result. Doubles are rounded to 6 digits for comparison.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.functions.channels import channel_group
from clickfold.functions.params import event_param, session_engaged, session_id, session_id_concat, shredded_params
from clickfold.operators import acquisition, buyers, commerce, email, funnel, sessions
from clickfold.operators import attribution as attr
from clickfold.plans.daily import FromStore
from clickfold.plans.daystore import DayStore, ShreddedEvents
from clickfold.session import ensure_checkpoint_dir
from clickfold.sources.events import in_window, read_table, write_table
from clickfold.sources.fixture import buyers_for, campaign_table, export_for, export_path, shard_folders_for
from clickfold.sources.lookups import read_buyers, read_campaigns
from clickfold.sources.shards import PartitionedExport
from clickfold.sources.tables import scratch_table

AS_OF = dt.date(2024, 1, 30)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn

    return deco


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_for(spark, sf_dir)


# ------------------------------------------------------------------ reports
for _days, _sfx in ((60, ""), (10, "_10d")):

    @register(f"r13_session_source{_sfx}")
    def _r13(spark, sf_dir, _d=_days):
        return sessions.session_source(_ev(spark, sf_dir), AS_OF, _d)

    @register(f"r12_session_user_counts{_sfx}")
    def _r12(spark, sf_dir, _d=_days):
        return buyers.session_user_counts(_ev(spark, sf_dir), AS_OF, _d)

    @register(f"r03_buyer_behavior_by_user{_sfx}")
    def _r03(spark, sf_dir, _d=_days):
        return buyers.buyer_behavior_by_user(_ev(spark, sf_dir), buyers_for(spark, sf_dir), AS_OF, _d)

    @register(f"r02_buyer_behavior_by_campaign{_sfx}")
    def _r02(spark, sf_dir, _d=_days):
        return buyers.buyer_reports(_ev(spark, sf_dir), buyers_for(spark, sf_dir), AS_OF, _d)[1]


for _days, _sfx in ((30, ""), (10, "_10d")):

    @register(f"r14_traffic_acquisition{_sfx}")
    def _r14(spark, sf_dir, _d=_days):
        return acquisition.traffic_acquisition(_ev(spark, sf_dir), AS_OF, _d)

    @register(f"r15_user_acquisition{_sfx}")
    def _r15(spark, sf_dir, _d=_days):
        return acquisition.user_acquisition(_ev(spark, sf_dir), AS_OF, _d)


@register("r14_traffic_acquisition_options")
def _r14o(spark, sf_dir):
    """R14 with the optional specific-event count and source/medium column."""
    return acquisition.traffic_acquisition(
        _ev(spark, sf_dir), AS_OF, 30, specific_event="add_to_cart", with_source_medium=True
    )


@register("r15_user_acquisition_options")
def _r15o(spark, sf_dir):
    return acquisition.user_acquisition(
        _ev(spark, sf_dir), AS_OF, 30, specific_event="add_to_cart", with_source_medium=True
    )


for _days, _sfx in ((60, ""), (10, "_10d")):

    @register(f"r08_items_by_session{_sfx}")
    def _r08(spark, sf_dir, _d=_days):
        return commerce.items_by_session(_ev(spark, sf_dir), AS_OF, _d)


for _days, _sfx in ((1, ""), (10, "_10d")):

    @register(f"r04_cart_abandonment{_sfx}")
    def _r04(spark, sf_dir, _d=_days):
        return commerce.cart_abandonment(_ev(spark, sf_dir), AS_OF, _d)


@register("r01_abandoned_cart_user_ids")
def _r01(spark, sf_dir):
    return commerce.abandoned_cart_user_ids(commerce.cart_abandonment(_ev(spark, sf_dir), AS_OF, 1))


@register("m13_cart_total")
def _m13(spark, sf_dir):
    return commerce.cart_total(_ev(spark, sf_dir), AS_OF, 1)


@register("m14_cart_items")
def _m14(spark, sf_dir):
    return commerce.cart_lines(_ev(spark, sf_dir), AS_OF, 1).drop("item_value")


@register("m15_cart_text")
def _m15(spark, sf_dir):
    return commerce.cart_text(_ev(spark, sf_dir), AS_OF, 1)


for _days, _sfx in ((30, ""), (10, "_10d")):

    @register(f"r05_closed_funnel_by_date{_sfx}")
    def _r05(spark, sf_dir, _d=_days):
        return funnel.closed_funnel(_ev(spark, sf_dir), AS_OF, _d, by_date=True)

    @register(f"r06_closed_funnel{_sfx}")
    def _r06(spark, sf_dir, _d=_days):
        return funnel.closed_funnel(_ev(spark, sf_dir), AS_OF, _d, by_date=False)

    @register(f"r07_geo_by_session{_sfx}")
    def _r07(spark, sf_dir, _d=_days):
        return sessions.geo_by_session(_ev(spark, sf_dir), AS_OF, _d)


@register("r06_closed_funnel_two_steps")
def _r06_two(spark, sf_dir):
    """R6 with another step list (page view, then purchase)."""
    return funnel.closed_funnel(_ev(spark, sf_dir), AS_OF, 30, by_date=False, steps=("page_view", "purchase"))


@register("m11_funnel_sessions")
def _m11(spark, sf_dir):
    return funnel.funnel_sessions(_ev(spark, sf_dir), AS_OF, 30, by_date=True)


@register("m12_landing_page")
def _m12(spark, sf_dir):
    return funnel.landing_pages(_ev(spark, sf_dir), AS_OF, 30)


_SM, _SMC = ("source", "medium"), ("source", "medium", "campaign")
for (_c, _a), _sfx in (((30, 30), ""), ((10, 10), "_10_10")):

    @register(f"r10_attribution_source_medium{_sfx}")
    def _r10(spark, sf_dir, _c=_c, _a=_a):
        return attr.attribution(_ev(spark, sf_dir), AS_OF, _c, _a, _SM)

    @register(f"r11_attribution_source_medium_campaign{_sfx}")
    def _r11(spark, sf_dir, _c=_c, _a=_a):
        return attr.attribution(_ev(spark, sf_dir), AS_OF, _c, _a, _SMC)


def _weights(spark, sf_dir, conv: int, acq: int):
    return attr.model_weights(attr.attribution_sessions(_ev(spark, sf_dir), AS_OF, conv, acq, _SM))


for (_c, _a), _sfx in (((30, 30), ""), ((10, 10), "_10_10")):

    @register(f"m16_first_conversion{_sfx}")
    def _m16(spark, sf_dir, _c=_c):
        return attr.first_conversion(_ev(spark, sf_dir), AS_OF, _c)

    @register(f"m19_last_non_direct{_sfx}")
    def _m19(spark, sf_dir, _c=_c, _a=_a):
        return attr.last_non_direct(attr.attribution_sessions(_ev(spark, sf_dir), AS_OF, _c, _a, _SM), _SM)

    for _name, _col, _keep in (
        ("m17_first_click", "w_first_click", False),
        ("m18_last_click", "w_last_click", False),
        ("m20_linear", "w_linear", True),
        ("m21_time_decay", "w_time_decay", True),
        ("m22_position_based", "w_position_based", True),
    ):

        @register(f"{_name}{_sfx}")
        def _m(spark, sf_dir, _c=_c, _a=_a, _col=_col, _keep=_keep):
            return attr.model_rows(_weights(spark, sf_dir, _c, _a), _col, _SM, _keep)


# the reports that read other reports, over saved tables as the daily run does
def _saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/saved/{uuid.uuid4().hex}/{name}"
    write_table(df, path)
    return read_table(spark, path)


def _saved_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/saved/{uuid.uuid4().hex}/buyers"
    write_table(buyers_for(spark, sf_dir), path)
    return read_buyers(spark, path)


def _saved_campaigns(spark: SparkSession) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/saved/{uuid.uuid4().hex}/campaigns"
    write_table(campaign_table(spark), path)
    return read_campaigns(spark, path)


@register("r01_saved")
def _r01_saved(spark, sf_dir):
    """R1 on a saved R4."""
    r4 = _saved(spark, commerce.cart_abandonment(_ev(spark, sf_dir), AS_OF, 1), "r04")
    return commerce.abandoned_cart_user_ids(r4)


def _saved_r2(spark, sf_dir, facts: DataFrame) -> DataFrame:
    r3 = buyers.buyer_behavior_by_user_from(buyers.user_accounts(facts), _saved_buyers(spark, sf_dir))
    return buyers.buyer_behavior_by_campaign_from(facts, _saved(spark, r3, "r03"))


@register("r02_saved")
def _r02_saved(spark, sf_dir):
    """R2 on a saved R3, buyers read from a lookup table."""
    facts = _saved(spark, sessions.session_facts(_ev(spark, sf_dir), AS_OF, 60), "facts")
    return _saved_r2(spark, sf_dir, facts)


@register("r09_saved")
def _r09_saved(spark, sf_dir):
    """R9 on saved R13, R8 (30 days), R12, R2 and mailing tables."""
    facts = _saved(spark, sessions.session_facts(_ev(spark, sf_dir), AS_OF, 60), "facts")
    r13 = _saved(spark, facts.select("user_pseudo_id", "session_id", "session_engaged", "source", "medium", "campaign"), "r13")
    r8 = _saved(spark, commerce.items_by_session(_ev(spark, sf_dir), AS_OF, 30), "r08")
    r12 = _saved(spark, buyers.session_user_counts_from(facts), "r12")
    r2 = _saved(spark, _saved_r2(spark, sf_dir, facts), "r02")
    return email.email_campaign_stats_from(r13, r8, r12, r2, _saved_campaigns(spark))


# the same reports on the states of a day store that was refreshed day by day
_STORES: dict[str, DayStore] = {}
_STORE_LOCK = threading.Lock()


def _store(spark: SparkSession, sf_dir: str) -> FromStore:
    _ev(spark, sf_dir)
    path = export_path(spark, sf_dir)
    with _STORE_LOCK:
        if path not in _STORES:
            store = DayStore(spark, f"{path}-store-{uuid.uuid4().hex}")
            # the day before as_of first, then only what is new on as_of
            store.refresh(PartitionedExport(path), AS_OF - dt.timedelta(days=1))
            store.refresh(PartitionedExport(path), AS_OF)
            _STORES[path] = store
    return FromStore(_STORES[path], AS_OF)


_SHREDDED: dict[str, ShreddedEvents] = {}


def _shredded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _ev(spark, sf_dir)
    path = export_path(spark, sf_dir)
    with _STORE_LOCK:
        if path not in _SHREDDED:
            store = ShreddedEvents(spark, f"{path}-shredded-{uuid.uuid4().hex}")
            store.refresh(PartitionedExport(path), AS_OF)
            _SHREDDED[path] = store
    return _SHREDDED[path].events()


@register("m03_shredded")
def _m03_shredded(spark, sf_dir):
    with shredded_params():
        return _event_params(_shredded_events(spark, sf_dir))


@register("r13_shredded")
def _r13_shredded(spark, sf_dir):
    with shredded_params():
        return sessions.session_source(_shredded_events(spark, sf_dir), AS_OF, 60)


@register("r14_shredded")
def _r14_shredded(spark, sf_dir):
    with shredded_params():
        return acquisition.traffic_acquisition(_shredded_events(spark, sf_dir), AS_OF, 30)


@register("r06_shredded")
def _r06_shredded(spark, sf_dir):
    with shredded_params():
        return funnel.closed_funnel(_shredded_events(spark, sf_dir), AS_OF, 30, by_date=False)


@register("r13_day_store")
def _r13_store(spark, sf_dir):
    return _store(spark, sf_dir).facts().select("user_pseudo_id", "session_id", "session_engaged", *_SMC)


@register("r12_day_store")
def _r12_store(spark, sf_dir):
    return buyers.session_user_counts_from(_store(spark, sf_dir).facts())


@register("r02_day_store")
def _r02_store(spark, sf_dir):
    return _saved_r2(spark, sf_dir, scratch_table(_store(spark, sf_dir).facts(), "session_facts"))


@register("r08_day_store")
def _r08_store(spark, sf_dir):
    return _store(spark, sf_dir).items()[0]


@register("r05_day_store")
def _r05_store(spark, sf_dir):
    return _store(spark, sf_dir).funnels()[0]


@register("r06_day_store")
def _r06_store(spark, sf_dir):
    return _store(spark, sf_dir).funnels()[1]


@register("r07_day_store")
def _r07_store(spark, sf_dir):
    return _store(spark, sf_dir).acquisition()[2]


@register("r14_day_store")
def _r14_store(spark, sf_dir):
    return _store(spark, sf_dir).acquisition()[0]


@register("r15_day_store")
def _r15_store(spark, sf_dir):
    return _store(spark, sf_dir).acquisition()[1]


@register("r10_day_store")
def _r10_store(spark, sf_dir):
    return _store(spark, sf_dir).attribution()[0]


@register("r11_day_store")
def _r11_store(spark, sf_dir):
    return _store(spark, sf_dir).attribution()[1]


for _idays, _sfx in ((30, ""), (5, "_items_5d")):

    @register(f"r09_email_campaign_stats{_sfx}")
    def _r09(spark, sf_dir, _i=_idays):
        return email.email_campaign_stats(
            _ev(spark, sf_dir), buyers_for(spark, sf_dir), campaign_table(spark), AS_OF, session_days=60, item_days=_i
        )


def _shard_counts(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_date", "export_kind").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("user_pseudo_id").alias("user_count"),
        F.count_distinct(session_id_concat()).alias("session_count"),
    )


@register("m01_read_with_intraday")
def _m01(spark, sf_dir):
    return _shard_counts(in_window(_ev(spark, sf_dir), AS_OF, 1))


@register("m02_read_daily_only")
def _m02(spark, sf_dir):
    return _shard_counts(in_window(_ev(spark, sf_dir), AS_OF, 1, include_intraday=False))


@register("m01_shard_folders")
def _m01_folders(spark, sf_dir):
    return _shard_counts(in_window(shard_folders_for(spark, sf_dir).events(spark), AS_OF, 1))


@register("m02_shard_folders")
def _m02_folders(spark, sf_dir):
    return _shard_counts(in_window(shard_folders_for(spark, sf_dir).events(spark), AS_OF, 1, include_intraday=False))


@register("r14_shard_folders")
def _r14_folders(spark, sf_dir):
    return acquisition.traffic_acquisition(shard_folders_for(spark, sf_dir).events(spark), AS_OF, 30)


@register("m03_event_param")
def _m03(spark, sf_dir):
    return _event_params(_ev(spark, sf_dir))


def _event_params(events: DataFrame) -> DataFrame:
    return in_window(events, AS_OF, 30).select(
        "user_pseudo_id", "event_timestamp", "event_name",
        event_param("ga_session_id", "int").alias("ga_session_id"),
        event_param("page_title").alias("page_title"),
        event_param("ga_session_number", "int").alias("ga_session_number"),
        event_param("session_engaged").alias("session_engaged_string"),
        event_param("session_engaged", "int").alias("session_engaged_int"),
        event_param("engagement_time_msec", "int").alias("engagement_time_msec"),
        event_param("source").alias("source"),
        event_param("medium").alias("medium"),
        event_param("campaign").alias("campaign"),
    )


@register("m04_session_id")
def _m04(spark, sf_dir):
    return in_window(_ev(spark, sf_dir), AS_OF, 30).select(
        "user_pseudo_id", "event_timestamp", session_id().alias("session_id")
    )


@register("m05_session_id_concat")
def _m05(spark, sf_dir):
    return in_window(_ev(spark, sf_dir), AS_OF, 30).select(
        "user_pseudo_id", "event_timestamp", session_id_concat().alias("session_id")
    )


@register("m06_session_engaged")
def _m06(spark, sf_dir):
    return in_window(_ev(spark, sf_dir), AS_OF, 30).groupBy("user_pseudo_id", session_id().alias("session_id")).agg(
        F.max(session_engaged()).alias("session_engaged"),
        F.max(session_engaged(int_fallback=False)).alias("session_engaged_string_only"),
    )


@register("m07_session_source_max")
def _m07(spark, sf_dir):
    return in_window(_ev(spark, sf_dir), AS_OF, 30).groupBy("user_pseudo_id", session_id().alias("session_id")).agg(
        *sessions.max_labels()
    )


def _first_sources(spark, sf_dir):
    return in_window(_ev(spark, sf_dir), AS_OF, 30).groupBy(
        "user_pseudo_id", session_id_concat().alias("session_id")
    ).agg(*sessions.first_labels())


@register("m08_session_source_first")
def _m08(spark, sf_dir):
    return _first_sources(spark, sf_dir)


@register("m09_first_user_source")
def _m09(spark, sf_dir):
    ev = in_window(_ev(spark, sf_dir), AS_OF, 30).select("*", session_id_concat().alias("_sid"), *sessions.first_user_labels())
    return ev.groupBy(
        "user_pseudo_id", F.col("_sid").alias("session_id"), "first_source", "first_medium", "first_campaign"
    ).agg(F.count(F.lit(1)).alias("event_count"))


@register("m10_channel_group_events")
def _m10e(spark, sf_dir):
    """The grouping of each event's own labels: every alternative of every rule."""
    return in_window(_ev(spark, sf_dir), AS_OF, 30).groupBy(
        *[event_param(c).alias(c) for c in ("source", "medium", "campaign")]
    ).agg(F.count(F.lit(1)).alias("events")).withColumn("channel_group", channel_group("source", "medium", "campaign"))


@register("m10_channel_group")
def _m10(spark, sf_dir):
    return _first_sources(spark, sf_dir).groupBy(
        "source", "medium", "campaign", channel_group("source", "medium", "campaign").alias("channel_group")
    ).agg(F.count(F.lit(1)).alias("sessions"))
