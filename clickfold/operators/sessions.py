"""Session-level facts: one row per (user_pseudo_id, session id).

Every aggregate here (max, min, min_by, count, sum) combines map-side, so a
session or user holding a large share of the events costs one partial row
per map task before the shuffle, never a single task holding all its rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.params import event_param, session_engaged, session_id, session_id_concat
from clickfold.schema import GEO
from clickfold.sources.events import in_window

SESSION_KEYS = ("user_pseudo_id", "session_id")
DIRECT_DEFAULTS = {"source": "(direct)", "medium": "(none)", "campaign": "(not set)"}


def max_labels() -> list[Column]:
    """M7: source, medium and campaign each by greatest value in the
    session (the three may come from different events)."""
    return [F.max(event_param(k)).alias(k) for k in ("source", "medium", "campaign")]


def first_non_null(value: Column) -> Column:
    """Earliest non-NULL value of the session by event time (ties: smaller
    value). A min_by aggregate, no array is built."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(F.col("event_timestamp"), value)))


def first_labels(prefix: str = "") -> list[Column]:
    """M8: first non-NULL source / medium / campaign, with the direct defaults."""
    return [
        F.coalesce(first_non_null(event_param(k)), F.lit(d)).alias(prefix + k)
        for k, d in DIRECT_DEFAULTS.items()
    ]


def first_user_labels() -> list[Column]:
    """M9: the row's first-user source/medium/campaign with defaults."""
    ts = F.col("traffic_source")
    return [
        F.coalesce(ts["source"], F.lit("(direct)")).alias("first_source"),
        F.coalesce(ts["medium"], F.lit("(none)")).alias("first_medium"),
        F.coalesce(ts["name"], F.lit("(not set)")).alias("first_campaign"),
    ]


def session_facts(events: DataFrame, as_of: dt.date, days: int = 60) -> DataFrame:
    """Shared per-session table (R13 columns plus a purchase flag and the
    greatest account id).

    R13, R12 and R2 are all re-aggregations of this one relation, so a chain
    that needs several of them scans the window and shuffles it once.
    """
    ev = in_window(events, as_of, days)
    return ev.groupBy(F.col("user_pseudo_id"), session_id().alias("session_id")).agg(
        F.max(session_engaged()).alias("session_engaged"),
        *max_labels(),
        F.max(F.when(F.col("event_name") == "purchase", F.lit(1))).cast("bigint").alias("purchase_flag"),
        F.max("user_id").alias("user_id"),
    )


def session_source(events: DataFrame, as_of: dt.date, days: int = 60) -> DataFrame:
    """Engaged flag and greatest source/medium/campaign per session."""
    return session_facts(events, as_of, days).select(
        "user_pseudo_id", "session_id", "session_engaged", "source", "medium", "campaign"
    )


GEO_FIELDS = tuple(f.name for f in GEO.fields)


def first_geo() -> Column:
    """The first event's (event_timestamp, event_name, geo) as one struct:
    its minimum is the geography of the session's first event (NULL fields
    kept; ties broken by the geo values). Minima of such structs also roll
    up from finer groups."""
    return F.min(F.struct(F.col("event_timestamp").alias("t"), F.col("event_name").alias("n"), F.col("geo").alias("g")))


def geo_fields(first: Column) -> list[Column]:
    return [first["g"][f].alias(f) for f in GEO_FIELDS]


def geo_by_session(events: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """One geography per user and session.

    All geo fields come from the session's first event by (event_timestamp,
    event_name); NULL values are kept, like the first element of an
    unordered array aggregate.
    """
    ev = in_window(events, as_of, days)
    return ev.groupBy(F.col("user_pseudo_id"), session_id_concat().alias("session_id")).agg(
        F.max(session_engaged()).alias("session_engaged"), first_geo().alias("_geo")
    ).select("user_pseudo_id", "session_id", "session_engaged", *geo_fields(F.col("_geo")))
