"""Traffic acquisition (R14, session scope) and user acquisition (R15,
first-user scope), both with the default channel grouping.

Aggregation levels: events -> sessions (map-side combined), sessions ->
one row per (labels, user or session), those -> report rows. Users and
sessions are counted without DISTINCT, and a label that holds most sessions is
split by user and session. The channel group depends on the labels alone: its
rules run on the report rows, not on the sessions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.channels import channel_group
from clickfold.functions.exact import exact_sum
from clickfold.functions.params import event_param, session_engaged, session_id_concat
from clickfold.operators.counts import counted_by_key
from clickfold.operators.sessions import DIRECT_DEFAULTS, first_geo, first_labels, first_user_labels, geo_fields
from clickfold.sources.events import in_window
from clickfold.sources.tables import scratch_table


def session_measures(engaged: Column, specific_event: str | None = None) -> list[Column]:
    is_start = F.col("event_name") == "session_start"
    extra = [] if specific_event is None else [
        F.count_if(F.col("event_name") == F.lit(specific_event)).alias("specific_event_count")
    ]
    return [*extra,
        F.min(F.to_date(F.col("event_date"), "yyyyMMdd")).alias("date"),
        F.max(F.when(is_start, event_param("ga_session_number", "int"))).alias("session_number"),
        F.max(engaged).alias("session_engaged"),
        F.max(event_param("engagement_time_msec", "int")).alias("engagement_time_msec"),
        F.count("event_name").alias("event_count"),
        F.count_if(F.col("event_name") == "purchase").alias("conversions"),
        exact_sum(F.col("ecommerce")["purchase_revenue"]).alias("total_revenue"),
    ]


def _report_measures(specific_event: str | None = None) -> dict[str, Column]:
    """What the report sums over sessions."""
    extra = {} if specific_event is None else {"specific_event_count": F.col("specific_event_count")}
    return {
        "engagement_time": F.col("engagement_time_msec") / F.lit(1000), "total_event_count": F.col("event_count"),
        **extra, "conversions": F.col("conversions"), "total_revenue": F.col("total_revenue"),
    }


def total_of(name: str, value: Column) -> Column:
    return exact_sum(value) if name in ("engagement_time", "total_revenue") else F.sum(value)


def _no_null_revenue(measures: list[str]) -> list[Column]:
    return [F.coalesce(m, F.lit(0.0)).alias(m) if m == "total_revenue" else F.col(m) for m in measures]


def _is_active() -> Column:
    return (F.col("engagement_time_msec") > 0) | (F.col("session_engaged") == "1")


def _source_medium(source: str, medium: str) -> Column:
    return F.concat(F.col(source), F.lit(" / "), F.col(medium))


def traffic_sessions(
    events: DataFrame, as_of: dt.date, days: int = 30, *, specific_event: str | None = None
) -> DataFrame:
    """Session facts of R14: first non-NULL source/medium/campaign in time,
    engaged flag from the string value only."""
    ev = in_window(events, as_of, days)
    return ev.groupBy(F.col("user_pseudo_id"), session_id_concat().alias("session_id")).agg(
        *first_labels(), *session_measures(session_engaged(int_fallback=False), specific_event)
    )


def traffic_acquisition(
    events: DataFrame,
    as_of: dt.date,
    days: int = 30,
    *,
    specific_event: str | None = None,
    with_source_medium: bool = False,
) -> DataFrame:
    """Sessions by date, channel group, source, medium and campaign.

    Options the source report keeps commented out: `specific_event` adds
    `specific_event_count` (events of that name); `with_source_medium` adds
    the combined `session_source_medium` ('source / medium') dimension.
    """
    per_session = traffic_sessions(events, as_of, days, specific_event=specific_event)
    return traffic_acquisition_from(per_session, specific_event=specific_event, with_source_medium=with_source_medium)


def traffic_acquisition_from(
    per_session: DataFrame, *, specific_event: str | None = None, with_source_medium: bool = False
) -> DataFrame:
    """R14's report level on its per-session table (`traffic_sessions`)."""
    labels = ["date", "source", "medium", "campaign"]
    measures = _report_measures(specific_event)
    counted = counted_by_key(
        per_session,
        labels,
        {"user": (F.col("user_pseudo_id"), _is_active()), "session": (F.col("session_id"), F.col("session_engaged") == "1")},
        measures,
    )
    group = channel_group("source", "medium", "campaign").alias("session_default_channel_group")
    pair = [_source_medium("source", "medium").alias("session_source_medium")] if with_source_medium else []
    return counted.select(
        "date", group, F.col("source").alias("session_source"), F.col("medium").alias("session_medium"), *pair,
        F.col("campaign").alias("session_campaign"), F.col("user").alias("total_users"), F.col("user_flagged").alias("active_users"),
        F.col("session").alias("sessions"), F.col("session_flagged").alias("engaged_sessions"), *_no_null_revenue(list(measures)),
        # ties by the dimensions: equal counts would all fall into one range
    ).orderBy(F.desc("total_users"), "date", "session_default_channel_group", "session_source", "session_medium", "session_campaign")


def first_in_time(value: Column) -> Column:
    """min of (time, value) over non-NULL values: the first non-NULL value
    in time (ties: smaller value); minima of these roll up."""
    return F.min(F.when(value.isNotNull(), F.struct(F.col("event_timestamp").alias("t"), value.alias("v"))))


def acquisition_reports(
    events: DataFrame, as_of: dt.date, days: int = 30, *, materialize: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R14, R15 and R7 from one scan of the window.

    One table per (session, first-user source/medium/campaign) -- R15's
    grouping -- is written once (scratch table with `materialize`). R15 is
    read from it as is; its rows roll up exactly to the per-session rows of
    R14 and R7 (first value in time = min of (time, value); maxima, sums
    and the first event's geography likewise).
    """
    ev = in_window(events, as_of, days).select("*", session_id_concat().alias("_sid"), *first_user_labels())
    fine = ev.groupBy(
        "user_pseudo_id", F.col("_sid").alias("session_id"), "first_source", "first_medium", "first_campaign"
    ).agg(
        *[first_in_time(event_param(k)).alias(f"_first_{k}") for k in DIRECT_DEFAULTS],
        *session_measures(session_engaged()),
        F.max(session_engaged(int_fallback=False)).alias("_engaged_string"),
        first_geo().alias("_geo"),
    )
    if materialize:
        fine = scratch_table(fine, "acquisition_sessions")
    return acquisition_reports_from(fine)


def acquisition_reports_from(fine: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R14, R15 and R7 on the table per (session, first-user labels)."""
    r15 = user_acquisition_from(fine)
    per_session = fine.groupBy("user_pseudo_id", "session_id").agg(
        *[F.min(f"_first_{k}").alias(f"_first_{k}") for k in DIRECT_DEFAULTS],
        F.min("date").alias("date"),
        F.max("session_number").alias("session_number"),
        F.max("_engaged_string").alias("_engaged_string"),
        F.max("session_engaged").alias("_engaged_any"),
        F.max("engagement_time_msec").alias("engagement_time_msec"),
        F.sum("event_count").alias("event_count"),
        F.sum("conversions").alias("conversions"),
        exact_sum("total_revenue").alias("total_revenue"),
        F.min("_geo").alias("_geo"),
    )
    traffic_rows = per_session.select(
        "user_pseudo_id", "session_id",
        *[F.coalesce(F.col(f"_first_{k}")["v"], F.lit(d)).alias(k) for k, d in DIRECT_DEFAULTS.items()],
        "date", "session_number", F.col("_engaged_string").alias("session_engaged"), "engagement_time_msec",
        "event_count", "conversions", "total_revenue",
    )
    r7 = per_session.select(
        "user_pseudo_id", "session_id", F.col("_engaged_any").alias("session_engaged"), *geo_fields(F.col("_geo"))
    )
    return traffic_acquisition_from(traffic_rows), r15, r7


def user_sessions(
    events: DataFrame, as_of: dt.date, days: int = 30, *, specific_event: str | None = None
) -> DataFrame:
    """Session facts of R15, keyed by session and the row's first-user
    source/medium/campaign (a session can appear under several)."""
    ev = in_window(events, as_of, days).select(
        "*", session_id_concat().alias("_sid"), *first_user_labels()
    )
    return ev.groupBy(
        "user_pseudo_id", F.col("_sid").alias("session_id"), "first_source", "first_medium", "first_campaign"
    ).agg(*session_measures(session_engaged(), specific_event))


def user_acquisition(
    events: DataFrame,
    as_of: dt.date,
    days: int = 30,
    *,
    specific_event: str | None = None,
    with_source_medium: bool = False,
) -> DataFrame:
    """First-user acquisition with new/returning users. Sessions are
    counted without DISTINCT, as in the source report. Options as in R14
    (`first_user_source_medium`)."""
    per_session = user_sessions(events, as_of, days, specific_event=specific_event)
    return user_acquisition_from(per_session, specific_event=specific_event, with_source_medium=with_source_medium)


def user_acquisition_from(
    per_session: DataFrame, *, specific_event: str | None = None, with_source_medium: bool = False
) -> DataFrame:
    """R15's report level on its per-session table (`user_sessions`)."""
    user, sid = F.col("user_pseudo_id"), F.col("session_id")
    num = F.col("session_number")
    labels = ["date", "first_source", "first_medium", "first_campaign"]
    group = channel_group("first_source", "first_medium", "first_campaign").alias("first_user_default_channel_group")
    pair = [_source_medium("first_source", "first_medium").alias("first_user_source_medium")] if with_source_medium else []
    dims = [
        "date", group, F.col("first_source").alias("first_user_source"), F.col("first_medium").alias("first_user_medium"),
        *pair, F.col("first_campaign").alias("first_user_campaign"),
    ]
    names = [
        "date", "first_user_default_channel_group", "first_user_source", "first_user_medium",
        *(["first_user_source_medium"] if with_source_medium else []), "first_user_campaign",
    ]
    measures = _report_measures(specific_event)
    counts = ["total_users", "active_users", "new_users", "returning_users", "sessions", "engaged_sessions"]
    return (
        per_session.groupBy(*labels, user)
        .agg(
            F.max(_is_active().cast("int")).alias("_active"),
            F.max((num == 1).cast("int")).alias("_new"),
            F.max((num > 1).cast("int")).alias("_returning"),
            F.count(sid).alias("sessions"),
            F.count(F.when(F.col("session_engaged") == "1", sid)).alias("engaged_sessions"),
            *[total_of(n, m).alias(n) for n, m in measures.items()],
        )
        # one row per (dimensions, user): users are counted without DISTINCT,
        # which would write every session once per counted expression
        .groupBy(*labels)
        .agg(
            F.count(user).alias("total_users"),
            *[
                F.count(F.when(F.col(flag) == 1, user)).alias(f"{kind}_users")
                for flag, kind in (("_active", "active"), ("_new", "new"), ("_returning", "returning"))
            ],
            F.sum("sessions").alias("sessions"),
            F.sum("engaged_sessions").alias("engaged_sessions"),
            *[total_of(c, F.col(c)).alias(c) for c in measures],
        )
        .select(*dims, *counts, *_no_null_revenue(list(measures)))
        .orderBy(F.desc("total_users"), *names)
    )
