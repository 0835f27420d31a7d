"""Rule-based attribution.

Credit for each user's first conversion in the last `conversion_days` full
days goes to the user's sessions that started up to `acquisition_days`
before it, under six models: first click, last click, last non-direct
click, linear, time decay (by session ordinal) and position based.

Plan shape, built for a user that holds a large share of the sessions:
* first conversion per user: a `min(struct(...))` aggregate, not two
  row-number windows;
* sessions: an aggregate per (user, session) of the look-back window, then
  an inner join with the one-row-per-user first conversions (never a join
  on raw events);
* session ordinal, session counts and the converting session's position:
  `ordinal_within` over the range partitions the session rows were written
  with (see ordinal.py), no window over all of a user's rows;
* time decay's denominator: closed form of sum_{j=1..m} 2^(j/n);
* last non-direct click: one `max_by` aggregate per user;
* five weights are summed per label in one aggregate; only the label rows
  are turned into (model, label) rows.

Deviation from the source engine: a user whose sessions all lack a session
id has n = 0; time decay gives NULL weight there, where the source would
fail on a division by zero (position based is NULL there in the source
too: no rule applies).
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.exact import exact_sum
from clickfold.functions.params import event_param, session_id
from clickfold.operators.membership import only_members
from clickfold.operators.ordinal import MINUTE_MICROS, ordinal_by_carry, ordinal_within
from clickfold.sources.events import in_window
from clickfold.sources.tables import scratch_table

# --- fixed values ----------------------------------------------------------
MODELS = ("first click", "last click", "last non direct click", "linear", "time decay", "position based")
LABEL_DEFAULTS = {"source": "(direct)", "medium": "(none)", "campaign": "(none)"}
POSITION_ENDS = 0.4      # first and last session when n > 2
POSITION_MIDDLE = 0.2    # shared by the sessions in between
POSITION_PAIR = 0.5      # each session when n = 2
# ---------------------------------------------------------------------------

DAY_MICROS = 86_400_000_000
#: Buyers up to which their ids (some tens of bytes each) are broadcast.
BROADCAST_USERS = 200_000
USER = "user_pseudo_id"


def label_name(dims: tuple[str, ...]) -> str:
    return "_".join(dims)


def direct_label(dims: tuple[str, ...]) -> str:
    return "/".join(LABEL_DEFAULTS[d] for d in dims)


def session_label(dims: tuple[str, ...]) -> Column:
    parts: list[Column] = []
    for d in dims:
        if parts:
            parts.append(F.lit("/"))
        parts.append(F.coalesce(event_param(d), F.lit(LABEL_DEFAULTS[d])))
    return F.concat(*parts)


def conversions(events: DataFrame, as_of: dt.date, conversion_days: int = 30) -> DataFrame:
    """Purchases of the last `conversion_days` full days (daily shards), one
    row per (user, session, conversion id = user text + event time)."""
    rows = conversion_rows(in_window(events, as_of, conversion_days, end_offset=1, include_intraday=False))
    return rows.groupBy(USER, "session_id", "conversion_id").agg(F.max("event_timestamp").alias("conversion_timestamp"))


def conversion_rows(events: DataFrame) -> DataFrame:
    """Purchases with their session and conversion id."""
    return events.where(F.col("event_name") == "purchase").select(
        USER, session_id().alias("session_id"), F.concat(F.col(USER), F.col("event_timestamp").cast("string")).alias("conversion_id"),
        "event_timestamp", "event_date", "export_kind",
    )


def first_conversion(events: DataFrame, as_of: dt.date, conversion_days: int = 30) -> DataFrame:
    """Each user's first conversion (ties: conversion id, then session
    id). `conversion_timestamp` is in microseconds."""
    return first_conversion_from(conversions(events, as_of, conversion_days))


def first_conversion_from(c: DataFrame) -> DataFrame:
    """M16 on a table of conversions."""
    first = c.groupBy(USER).agg(F.min(F.struct("conversion_timestamp", "conversion_id", "session_id")).alias("c"))
    return first.select(
        USER,
        F.col("c")["session_id"].alias("session_id"),
        F.col("c")["conversion_id"].alias("conversion_id"),
        F.col("c")["conversion_timestamp"].alias("conversion_timestamp"),
    )


def attribution_sessions(
    events: DataFrame,
    as_of: dt.date,
    conversion_days: int = 30,
    acquisition_days: int = 30,
    dims: tuple[str, ...] = ("source", "medium"),
    *,
    materialize: bool = True,
    extra_dims: tuple[tuple[str, ...], ...] = (),
) -> DataFrame:
    """Sessions of converting users in the look-back window, numbered.

    `extra_dims` adds more label columns (e.g. source/medium and
    source/medium/campaign at once): everything else is label-independent,
    so several attribution reports can share one table.

    With `materialize` (default) the first conversions and the session
    rows are written once as scratch tables: the numbering, the per-user
    totals and the last non-direct step all read the session table, so the
    event window is scanned once, and the sessions-to-conversions join can
    be split by AQE when one user has very many sessions.

    Columns: user_pseudo_id, session_id, session_start (micros), <label>,
    conversion_id (on the converting session only), session_number (by
    start, then session id, NULL first), total_session_per_user (sessions
    with an id), session_rows (all rows), conv_key (start and id of the
    converting session, NULL when it is not in the window).
    """
    conv = first_conversion(events, as_of, conversion_days)
    ev = in_window(events, as_of, conversion_days + acquisition_days, end_offset=1, include_intraday=False)
    labels = [dims, *[d for d in extra_dims if d != dims]]

    def sessions_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col(USER), session_id().alias("session_id")).agg(
            F.min("event_timestamp").alias("session_start"),
            *[F.max(session_label(d)).alias(label_name(d)) for d in labels],
        )

    return numbered_sessions(conv, ev, sessions_of, [label_name(d) for d in labels], acquisition_days, materialize=materialize)


def numbered_sessions(
    conv: DataFrame,
    rows: DataFrame,
    sessions_of: Callable[[DataFrame], DataFrame],
    labels: list[str],
    acquisition_days: int = 30,
    *,
    materialize: bool = True,
) -> DataFrame:
    """`attribution_sessions` on first conversions and rows (events, or states
    of sessions) that `sessions_of` turns into sessions."""
    if materialize:
        # Read back from a table, the conversions reach the join through a
        # plain shuffle like the sessions do, so AQE can split a user with a
        # huge number of sessions across tasks (its skew-join rule only
        # applies when both join inputs are shuffles it inserted).
        conv = scratch_table(conv, "first_conversions")
        rows = of_buyers(rows, conv)
    sess = sessions_of(rows)
    c = conv.select(
        USER, F.col("session_id").alias("_conv_sid"), "conversion_id", F.col("conversion_timestamp").alias("_conv_ts")
    )
    start = F.col("session_start")
    found = (
        sess.join(c, USER)
        .where((start <= F.col("_conv_ts")) & (start >= F.col("_conv_ts") - F.lit(acquisition_days * DAY_MICROS)))
        .select(
            USER, "session_id", "session_start", *labels,
            F.when(F.col("session_id") == F.col("_conv_sid"), F.col("conversion_id")).alias("conversion_id"),
        )
    )
    order = [start.asc(), F.col("session_id").asc_nulls_first()]
    key = F.struct(start.alias("start"), F.col("session_id").alias("sid"))
    if materialize:
        # one shuffle, by ranges of (user, start, session) that Spark balances
        # by sampling: a user with a huge number of sessions is spread over
        # many tasks. Written once for every report and model that reads it.
        return ordinal_by_carry(
            found,
            USER,
            order,
            name="session_number",
            counts={"session_rows": F.lit(True), "total_session_per_user": F.col("session_id").isNotNull()},
            last={"conv_key": (F.col("conversion_id").isNotNull(), key)},
            table="numbered_sessions",
            write=scratch_table,
        )
    return ordinal_within(
        found,
        USER,
        order,
        bucket_of=F.floor(start / F.lit(MINUTE_MICROS)),
        name="session_number",
        bucket_aggs={
            "session_rows": (F.count(F.lit(1)), "sum"),
            "total_session_per_user": (F.count("session_id"), "sum"),
            "conv_key": (F.max(F.when(F.col("conversion_id").isNotNull(), key)), "max"),
        },
    )


def of_buyers(rows: DataFrame, conv: DataFrame) -> DataFrame:
    """Rows of users with a conversion, filtered where they are scanned.

    Few buyers (counted in their written table) are broadcast. Beyond that a
    hash bitmap of them is, which lets a few rows of others pass; the join
    with the conversions that follows the session aggregate is exact. A
    shuffled semi join would move the raw rows by user."""
    n = conv.count()
    if n <= BROADCAST_USERS:
        return rows.join(F.broadcast(conv.select(USER)), USER, "left_semi")
    return only_members(rows, conv, USER, n)


def _decay_total(m: Column, n: Column) -> Column:
    """sum_{j=1..m} 2^(j/n) = r (r^m - 1) / (r - 1), r = 2^(1/n), via expm1."""
    step = F.lit(math.log(2.0)) / n
    return F.exp(step) * F.expm1(m * step) / F.expm1(step)


def model_weights(raw: DataFrame) -> DataFrame:
    """M17, M18, M20, M21, M22 as columns of each session row."""
    i, n, m = F.col("session_number"), F.col("total_session_per_user"), F.col("session_rows")
    one = F.lit(1.0)
    decay = F.when(n == 1, one).when(
        n > 0, F.try_divide(F.pow(F.lit(2.0), F.try_divide(i, n)), _decay_total(m.cast("double"), n.cast("double")))
    )
    position = (
        F.when(n == 1, one)
        .when(n == 2, F.lit(POSITION_PAIR))
        .when(
            n > 2,
            F.when(i == 1, F.lit(POSITION_ENDS)).when(i == n, F.lit(POSITION_ENDS))
            .otherwise(F.lit(POSITION_MIDDLE) / (n - 2)),
        )
    )
    return raw.select(
        "*",
        F.when(i == 1, one).alias("w_first_click"),
        F.when(i == n, one).alias("w_last_click"),
        (one / m).alias("w_linear"),
        decay.alias("w_time_decay"),
        position.alias("w_position_based"),
    )


def last_non_direct(raw: DataFrame, dims: tuple[str, ...] = ("source", "medium")) -> DataFrame:
    """Per user with its converting session in the window, the
    session's label, or the latest earlier non-direct label, or direct."""
    label, direct = label_name(dims), direct_label(dims)
    start, sid = F.col("session_start"), F.col("session_id")
    ck = F.col("conv_key")
    upto = (start < ck["start"]) | ((start == ck["start"]) & (sid.isNull() | (sid <= ck["sid"])))
    cand = (F.col(label) != F.lit(direct)) & upto
    key = F.struct(start, sid)
    return (
        raw.where(ck.isNotNull())
        .groupBy(USER)
        .agg(
            F.max("conversion_id").alias("conversion_id"),
            F.max_by(F.when(cand, F.col(label)), F.when(cand, key)).alias("_lnd"),
        )
        .select(USER, "conversion_id", F.coalesce("_lnd", F.lit(direct)).alias(label), F.lit(1.0).alias("attribution_weight"))
    )


def attribution(
    events: DataFrame,
    as_of: dt.date,
    conversion_days: int = 30,
    acquisition_days: int = 30,
    dims: tuple[str, ...] = ("source", "medium"),
    *,
    materialize: bool = True,
) -> DataFrame:
    """R10 (dims source, medium) / R11 (source, medium, campaign): summed
    credit per model and label."""
    raw = attribution_sessions(events, as_of, conversion_days, acquisition_days, dims, materialize=materialize)
    return attribution_from(raw, dims)


def attribution_reports(
    events: DataFrame,
    as_of: dt.date,
    conversion_days: int = 30,
    acquisition_days: int = 30,
    dims_list: tuple[tuple[str, ...], ...] = (("source", "medium"), ("source", "medium", "campaign")),
) -> list[DataFrame]:
    """R10 and R11 (or any label sets) from one numbered session table,
    written once: one scan of the window for purchases, one for sessions, one
    numbering, and one aggregate per label set and model kind."""
    raw = attribution_sessions(
        events, as_of, conversion_days, acquisition_days, dims_list[0], extra_dims=tuple(dims_list[1:])
    )
    return [attribution_from(raw, d) for d in dims_list]


def attribution_from(raw: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Summed credit per model and label from `attribution_sessions` rows."""
    label = label_name(dims)
    # (model, weight column, keep labels without any weight?)
    arms = [
        ("first click", "w_first_click", False),
        ("last click", "w_last_click", False),
        ("linear", "w_linear", True),
        ("time decay", "w_time_decay", True),
        ("position based", "w_position_based", True),
    ]
    # one row per label with a sum per model; only these few are unpivoted
    sums = model_weights(raw).groupBy(label).agg(*[exact_sum(col).alias(col) for _, col, _ in arms])
    rows = F.array(*[
        F.struct(F.lit(name).alias("m"), F.col(col).alias("w"), F.lit(keep).alias("keep")) for name, col, keep in arms
    ])
    per_model = sums.select(label, F.explode(rows).alias("a")).where(F.col("a")["keep"] | F.col("a")["w"].isNotNull())
    per_model = per_model.select(F.col("a")["m"].alias("attribution_model"), F.col(label), F.col("a")["w"].alias("attribution_weight"))
    non_direct = (
        last_non_direct(raw, dims)
        .groupBy(label)
        .agg(exact_sum("attribution_weight").alias("attribution_weight"))
        .select(F.lit("last non direct click").alias("attribution_model"), label, "attribution_weight")
    )
    return per_model.unionByName(non_direct)


def model_rows(raw_weights: DataFrame, weight_col: str, dims: tuple[str, ...], keep_null: bool) -> DataFrame:
    """Per-session rows of one model."""
    label = label_name(dims)
    out = raw_weights.select(
        USER, "session_id", "session_number", label, F.col(weight_col).alias("attribution_weight")
    )
    return out if keep_null else out.where(F.col("attribution_weight").isNotNull())
