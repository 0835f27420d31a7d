"""Closed funnel page_view -> add_to_cart -> purchase.

The landing page is the title of the session's first funnel event when that
event is a page view. Instead of a window over each session's events (one
task per session, however large), it is a `min_by` aggregate that combines
map-side; with a date split, the few per-day rows of a session pick the
session's first day with a window over already reduced rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfold.functions.params import event_param, session_id
from clickfold.functions.text import landing_page_title
from clickfold.sources.events import in_window
from clickfold.sources.tables import scratch_table

STEPS = ("page_view", "add_to_cart", "purchase")
MICROS_PER_DAY = 86_400_000_000


def utc_date(micros: Column) -> Column:
    """UTC calendar date of a microsecond timestamp (no session time zone)."""
    return F.date_from_unix_date(F.floor(micros / F.lit(MICROS_PER_DAY)).cast("int"))


def _step_col(step: str) -> str:
    return f"first_{step}_timestamp"


def _funnel_groups(
    events: DataFrame, as_of: dt.date, days: int, by_date: bool, steps: tuple[str, ...]
) -> DataFrame:
    """Funnel events grouped per session (and UTC date with `by_date`):
    first time of each step, the group's first event (`_first`) and that
    event's title when it is the first step (`first_page_view`)."""
    keys = ["user_pseudo_id", "session_id", *(["session_date"] if by_date else [])]
    rows = funnel_rows(in_window(events, as_of, days), steps)
    return day_groups_from(rows.groupBy(*keys).agg(*[c.alias(n) for c, n in funnel_states(steps)]))


def funnel_rows(events: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The funnel's events with their session, UTC date and title."""
    return events.where(F.col("event_name").isin(*steps)).select(
        "user_pseudo_id", session_id().alias("session_id"), "event_name", "event_timestamp",
        event_param("page_title").alias("page_title"), utc_date(F.col("event_timestamp")).alias("session_date"),
        "event_date", "export_kind",
    )


def funnel_states(steps: tuple[str, ...] = STEPS) -> list[tuple[Column, str]]:
    """Minima over funnel rows: the first event with its title, and the first
    time of each step. Minima of several groups' minima are the minima of
    their union."""
    name, ts = F.col("event_name"), F.col("event_timestamp")
    # order: time, event name, then the title itself, so equal times still
    # give one answer (a retried task computes the same landing page)
    title = F.when(name == steps[0], F.col("page_title"))
    landing = F.struct(ts.alias("t"), name.alias("n"), F.coalesce(title, F.lit("")).alias("order"), title.alias("title"))
    return [(F.min(landing), "_landing"), *[(F.min(F.when(name == s, ts)), _step_col(s)) for s in steps]]


def day_groups_from(states: DataFrame) -> DataFrame:
    """`first_page_view` and `_first` out of the first event."""
    first = F.struct(F.col("_landing")["t"].alias("event_timestamp"), F.col("_landing")["n"].alias("event_name"))
    return states.select("*", F.col("_landing")["title"].alias("first_page_view"), first.alias("_first")).drop("_landing")


def _passing(grouped: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    cond = F.col(_step_col(steps[0])).isNotNull()
    for prev, cur in zip(steps, steps[1:]):
        cond = cond & (F.col(_step_col(cur)).isNull() | (F.col(_step_col(cur)) > F.col(_step_col(prev))))
    return grouped.where(cond).drop("_first")


def _session_landing(day_groups: DataFrame) -> DataFrame:
    """Per-day rows get the landing page of their whole session: the title
    of the session's first day's first event (a window over the few day
    rows of one session)."""
    w = Window.partitionBy("user_pseudo_id", "session_id")
    return day_groups.withColumn("first_page_view", F.min_by("first_page_view", "_first").over(w))


def _roll_up_days(day_groups: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Per-(session, day) groups -> per-session groups (mins of mins)."""
    return day_groups.groupBy("user_pseudo_id", "session_id").agg(
        F.min_by("first_page_view", "_first").alias("first_page_view"),
        F.min("_first").alias("_first"),
        *[F.min(_step_col(s)).alias(_step_col(s)) for s in steps],
    )


def funnel_sessions(
    events: DataFrame, as_of: dt.date, days: int = 30, *, by_date: bool = True, steps: tuple[str, ...] = STEPS
) -> DataFrame:
    """M11 (+ M12): sessions (and UTC dates) that pass the closed funnel.

    Keeps rows whose first step exists and where every later step is
    missing or strictly later than the step before (three-valued: a later
    step after a missing one drops the row). Columns: user_pseudo_id,
    session_id, [session_date], first_page_view (raw title) and one
    `first_<step>_timestamp` per step.
    """
    grouped = _funnel_groups(events, as_of, days, by_date, steps)
    if by_date:
        grouped = _session_landing(grouped)
    return _passing(grouped, steps)


def _counts(steps: tuple[str, ...]) -> list[Column]:
    key = F.concat(F.col("user_pseudo_id"), F.col("session_id").cast("string"))
    out = [F.count(key).alias(f"sessions_{steps[0]}")]
    for s in steps[1:-1]:
        out.append(F.count(F.when(F.col(_step_col(s)).isNotNull(), key)).alias(f"sessions_{s}"))
    if len(steps) > 1:
        last = steps[-1]
        out.append(F.count(F.when(F.col(_step_col(last)).isNotNull(), F.col("session_id"))).alias(f"sessions_{last}"))
    return out


def closed_funnel(
    events: DataFrame, as_of: dt.date, days: int = 30, *, by_date: bool = True, steps: tuple[str, ...] = STEPS
) -> DataFrame:
    """R5 (`by_date=True`) / R6: funnel sessions per landing page.

    The landing page is the title before its first '|', NULL without one.
    R5 groups by UTC date too and sorts by date, then page views descending.
    """
    return _report(funnel_sessions(events, as_of, days, by_date=by_date, steps=steps), by_date, steps)


def _report(fs: DataFrame, by_date: bool, steps: tuple[str, ...]) -> DataFrame:
    page = landing_page_title(F.col("first_page_view")).alias("first_page_view")
    if by_date:
        return (
            fs.groupBy(F.col("session_date"), page)
            .agg(*_counts(steps))
            .orderBy(F.col("session_date"), F.desc(f"sessions_{steps[0]}"), "first_page_view")
        )
    return fs.groupBy(F.lit("all_pages").alias("all_pages"), page).agg(*_counts(steps))


def closed_funnel_pair(
    events: DataFrame, as_of: dt.date, days: int = 30, *, steps: tuple[str, ...] = STEPS, materialize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """R5 and R6 from one scan: the per-(session, day) groups are written
    once (scratch table) and rolled up to sessions for R6."""
    day_groups = _funnel_groups(events, as_of, days, True, steps)
    if materialize:
        day_groups = scratch_table(day_groups, "funnel_days")
    return closed_funnel_pair_from(day_groups, steps)


def closed_funnel_pair_from(day_groups: DataFrame, steps: tuple[str, ...] = STEPS) -> tuple[DataFrame, DataFrame]:
    """R5 and R6 on the per-(session, day) groups."""
    r5 = _report(_passing(_session_landing(day_groups), steps), True, steps)
    r6 = _report(_passing(_roll_up_days(day_groups, steps), steps), False, steps)
    return r5, r6


def landing_pages(events: DataFrame, as_of: dt.date, days: int = 30, *, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Landing page per session (raw title and the part before '|'),
    before the funnel filter."""
    name, ts = F.col("event_name"), F.col("event_timestamp")
    ev = in_window(events, as_of, days).where(name.isin(*steps))
    title = F.when(name == steps[0], event_param("page_title"))
    return (
        ev.groupBy(F.col("user_pseudo_id"), session_id().alias("session_id"))
        .agg(F.min_by(title, F.struct(ts, name, F.coalesce(title, F.lit("")))).alias("page_title"))
        .select("user_pseudo_id", "session_id", "page_title", landing_page_title(F.col("page_title")).alias("landing_page"))
    )
