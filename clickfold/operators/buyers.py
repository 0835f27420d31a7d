"""Buyer behaviour (R2, R3) and session/user counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.operators.counts import counted_by_key
from clickfold.operators.sessions import session_facts
from clickfold.sources.events import in_window
from clickfold.sources.tables import scratch_table

LABELS = ("source", "medium", "campaign")


def _session_key():
    # NULL session -> NULL key -> not counted, as in the reports.
    return F.concat(F.col("user_pseudo_id"), F.col("session_id").cast("string"))


def buyer_behavior_by_user(
    events: DataFrame, buyers: DataFrame, as_of: dt.date, days: int = 60, *, safe_cast: bool = False
) -> DataFrame:
    """Device -> greatest account id -> buyer flags.

    Devices without an account id are dropped; the account id text is cast
    to bigint to meet `const_id` (ANSI: bad text raises unless `safe_cast`).
    """
    return buyer_behavior_by_user_from(user_accounts(in_window(events, as_of, days)), buyers, safe_cast=safe_cast)


def user_accounts(rows: DataFrame) -> DataFrame:
    """Device -> greatest account id, devices without one dropped. `rows`
    may be events or session facts (both carry `user_id`)."""
    return (
        rows.groupBy("user_pseudo_id")
        .agg(F.max("user_id").alias("user_id"))
        .where(F.col("user_id").isNotNull())
    )


def buyer_behavior_by_user_from(users: DataFrame, buyers: DataFrame, *, safe_cast: bool = False) -> DataFrame:
    """R3 on a device -> account id table."""
    key = F.col("user_id").try_cast("bigint") if safe_cast else F.col("user_id").cast("bigint")
    b = buyers.select("const_id", "renew", "new", "lapsed")
    return users.join(b, key == b["const_id"], "inner").select(
        "user_pseudo_id", "user_id", "renew", "new", "lapsed"
    )


def purchasing_sessions(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("purchase_flag").isNotNull())


def buyer_behavior_by_campaign_from(facts: DataFrame, by_user: DataFrame, *, sort: bool = True) -> DataFrame:
    """R2 on a session-facts table and an R3 result (`sort=False` when the
    result feeds another report)."""
    buying = purchasing_sessions(facts).select("user_pseudo_id", "session_id", *LABELS)
    # Sessions reduce to one row per (labels, user) before the user join, so
    # a user with very many sessions meets the flags once per label set. The
    # flags are reduced to one row per user (a buyer may be listed twice).
    users = buying.select(*LABELS, "user_pseudo_id").distinct()
    any_ = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    flags = by_user.groupBy("user_pseudo_id").agg(any_("new"), any_("renew"), any_("lapsed"))
    flagged = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    per_label = users.join(flags, "user_pseudo_id", "left").groupBy(*LABELS).agg(
        F.count("user_pseudo_id").alias("count_purchasing_user_pseudo_id"),
        flagged("new").alias("count_new_buyers"),
        flagged("renew").alias("count_renew_buyers"),
        flagged("lapsed").alias("count_lapsed_buyers"),
    )
    counts = buying.groupBy(*LABELS).agg(F.count_distinct(_session_key()).alias("count_purchasing_sessions"))
    same = [counts[c].eqNullSafe(per_label[c]) for c in LABELS]
    out = counts.join(per_label, same[0] & same[1] & same[2]).select(
        *[counts[c] for c in LABELS], "count_purchasing_sessions", "count_purchasing_user_pseudo_id",
        "count_new_buyers", "count_renew_buyers", "count_lapsed_buyers",
    )
    return out.orderBy(F.desc("count_purchasing_user_pseudo_id"), *LABELS) if sort else out


def buyer_behavior_by_campaign(
    events: DataFrame, by_user: DataFrame, as_of: dt.date, days: int = 60
) -> DataFrame:
    """R2: purchasing sessions/users and new/renew/lapsed buyers per label."""
    return buyer_behavior_by_campaign_from(session_facts(events, as_of, days), by_user)


def session_user_counts_from(facts: DataFrame) -> DataFrame:
    """R12 on a session-facts table."""
    keys = {"session": (_session_key(), F.col("session_engaged") == "1"), "user": (F.col("user_pseudo_id"), F.lit(False))}
    return counted_by_key(facts, list(LABELS), keys).select(
        *LABELS, F.col("session").alias("count_sessions"), F.col("session_flagged").alias("count_engaged_sessions"),
        F.col("user").alias("count_users"),
    )


def session_user_counts(events: DataFrame, as_of: dt.date, days: int = 60) -> DataFrame:
    """Sessions, engaged sessions and users per source/medium/campaign."""
    return session_user_counts_from(session_facts(events, as_of, days))


def buyer_reports(
    events: DataFrame, buyers: DataFrame, as_of: dt.date, days: int = 60, *, materialize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """R3 and R2 together from one per-session table (written once as a
    scratch table with `materialize`, so the window is scanned once)."""
    facts = session_facts(events, as_of, days)
    if materialize:
        facts = scratch_table(facts, "session_facts")
    by_user = buyer_behavior_by_user_from(user_accounts(facts), buyers)
    return by_user, buyer_behavior_by_campaign_from(facts, by_user)
