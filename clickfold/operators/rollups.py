"""Mergeable per-day states of the session tables.

Every session-level table the reports start from is a set of maxima, minima
and sums per key, so it can be built per day shard and put together later:
`per_shard` groups one or more shards' events by shard and key, `merged`
groups such rows (of any shards) by key. First values in time are minima of
(time, value) structs; counts are sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickfold.functions.exact import exact_sum
from clickfold.functions.params import event_param, look_up, looked_up_params, session_engaged, session_id, session_id_concat
from clickfold.operators import acquisition, attribution, commerce, funnel
from clickfold.operators.sessions import DIRECT_DEFAULTS, first_geo, first_user_labels, max_labels

USER, SHARD = "user_pseudo_id", ("event_date", "export_kind")
HOW = {"max": F.max, "min": F.min, "sum": F.sum, "exact": exact_sum}


@dataclass(frozen=True)
class Rollup:
    """`rows` turns events into rows with the key columns and the few values
    that the states look at; `states` gives (aggregate of one shard's rows, its
    name, how two shards' values meet).

    Greatest texts and least structs are aggregated by sorting, before the
    shuffle too: a row that still held its event's array would be sorted, and
    spilled, with it."""

    name: str
    keys: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    states: Callable[[], list[tuple[Column, str, str]]]

    def per_shard(self, events: DataFrame) -> DataFrame:
        rows = self.rows(events)
        with looked_up_params():
            states = self.states()
        return rows.groupBy(*SHARD, *self.keys).agg(*[c.alias(n) for c, n, _ in states])

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[HOW[how](n).alias(n) for _, n, how in self.states()])


SM, SMC = ("source", "medium"), ("source", "medium", "campaign")


ENGAGED = (("session_engaged", "string"), ("session_engaged", "int"))


def _session_rows(ev: DataFrame) -> DataFrame:
    looked_up = look_up(*ENGAGED, *[(k, "string") for k in SMC])
    return ev.select(*SHARD, USER, session_id().alias("session_id"), "event_timestamp", "event_name", "user_id", *looked_up)


def _session_states() -> list[tuple[Column, str, str]]:
    labels = [(c, k, "max") for c, k in zip(max_labels(), SMC, strict=True)]
    return [
        (F.max(session_engaged()), "session_engaged", "max"),
        *labels,
        (F.max(F.when(F.col("event_name") == "purchase", F.lit(1))).cast("bigint"), "purchase_flag", "max"),
        (F.max("user_id"), "user_id", "max"),
        (F.min("event_timestamp"), "session_start", "min"),
        *[(F.max(attribution.session_label(d)), attribution.label_name(d), "max") for d in (SM, SMC)],
    ]


def _acquisition_rows(ev: DataFrame) -> DataFrame:
    numbers = (("ga_session_number", "int"), ("engagement_time_msec", "int"))
    starts = {"ga_session_number": F.col("event_name") == "session_start"}
    looked_up = look_up(*ENGAGED, *[(k, "string") for k in DIRECT_DEFAULTS], *numbers, where=starts)
    return ev.select(
        *SHARD, USER, session_id_concat().alias("session_id"), *first_user_labels(),
        "event_timestamp", "event_name", "ecommerce", "geo", *looked_up,
    )


def _acquisition_states() -> list[tuple[Column, str, str]]:
    measures = {
        "date": "min", "session_number": "max", "session_engaged": "max", "engagement_time_msec": "max",
        "event_count": "sum", "conversions": "sum", "total_revenue": "exact",
    }
    return [
        *[(acquisition.first_in_time(event_param(k)), f"_first_{k}", "min") for k in DIRECT_DEFAULTS],
        *zip(acquisition.session_measures(session_engaged()), measures, measures.values(), strict=True),
        (F.max(session_engaged(int_fallback=False)), "_engaged_string", "max"),
        (first_geo(), "_geo", "min"),
    ]


def _item_states() -> list[tuple[Column, str, str]]:
    how = {"donation_revenue": "exact", "product_revenue": "exact", "conversion_flag": "max"}
    return [(c, n, how.get(n, "sum")) for c, n in zip(commerce.item_sums(), commerce.ITEM_SUMS, strict=True)]


#: R13, R12, R3, R2, R9; session starts and labels of R10, R11
SESSIONS = Rollup("sessions", (USER, "session_id"), _session_rows, _session_states)
#: R8
ITEMS = Rollup("items", (USER, "session_id"), lambda ev: commerce.exploded_items(ev, "purchase"), _item_states)
#: R14, R15, R7
ACQUISITION = Rollup(
    "acquisition",
    (USER, "session_id", "first_source", "first_medium", "first_campaign"),
    _acquisition_rows,
    _acquisition_states,
)
#: R5, R6 (sessions by UTC date: one may span two shards)
FUNNEL = Rollup(
    "funnel",
    (USER, "session_id", "session_date"),
    funnel.funnel_rows,
    lambda: [(c, n, "min") for c, n in funnel.funnel_states()],
)
#: R10, R11
CONVERSIONS = Rollup(
    "conversions",
    (USER, "session_id", "conversion_id"),
    attribution.conversion_rows,
    lambda: [(F.max("event_timestamp"), "conversion_timestamp", "max")],
)
ROLLUPS = {r.name: r for r in (SESSIONS, ITEMS, ACQUISITION, FUNNEL, CONVERSIONS)}
