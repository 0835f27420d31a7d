"""Daily run: compute every report for one `as_of` and save it as a table.

The source reports hand results on as saved tables: the message list reads
the saved cart-abandonment table, buyer mix reads the saved device -> buyer
table, and the e-mail statistics read the saved session, item, count and
buyer tables. `save_reports` writes each report to
`<root>/<report>/as_of=<YYYY-MM-DD>` (overwrite, so a rerun of a day
replaces it) and builds the dependent reports from the saved tables.

`publish_reports` (plans/published.py) makes the same tables visible as one
set. With a day store (plans/daystore.py) the session tables are put together
from the states of the days instead of from 61 days of events; only the cart
reports, whose window is two days, read events then.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfold.functions.params import strict_params
from clickfold.operators import acquisition, attribution, buyers, commerce, email, funnel, rollups, sessions
from clickfold.plans.daystore import DayStore
from clickfold.session import get_spark
from clickfold.sources.events import read_table, write_table
from clickfold.sources.lookups import read_buyers, read_campaigns
from clickfold.sources.shards import PartitionedExport, ShardFolders
from clickfold.sources.tables import scratch_scope, scratch_table

# report name -> table name used by the reports that read it
TABLES = {
    "r13": "session_source_60d",
    "r08": "items_by_session_60d",
    "r08_30": "items_by_session_30d",
    "r12": "session_user_counts_60d",
    "r03": "buyers_by_device_60d",
    "r02": "buyer_mix_by_campaign_60d",
    "r04": "cart_abandonment_2d",
    "r01": "abandoned_cart_messages",
    "r05": "closed_funnel_by_date_30d",
    "r06": "closed_funnel_30d",
    "r07": "geo_by_session_30d",
    "r10": "attribution_source_medium",
    "r11": "attribution_source_medium_campaign",
    "r14": "traffic_acquisition_30d",
    "r15": "user_acquisition_30d",
    "r09": "email_campaign_stats",
}


def utc_today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


def table_path(root: str, key: str, as_of: dt.date) -> str:
    return f"{root.rstrip('/')}/{TABLES[key]}/as_of={as_of.isoformat()}"


def save_reports(
    spark: SparkSession,
    events: DataFrame,
    buyer_flags: DataFrame,
    campaigns: DataFrame,
    as_of: dt.date,
    root: str,
    *,
    keep_scratch: bool = False,
    store: DayStore | None = None,
) -> dict[str, str]:
    """Write all reports for `as_of`; returns report key -> path. The
    shared intermediate tables are deleted once every report is written
    (`keep_scratch=True` keeps them). `store`: a day store refreshed for
    `as_of`, to read instead of long windows of events."""
    with scratch_scope(spark, keep=keep_scratch):
        return save_all(spark, events, buyer_flags, campaigns, as_of, lambda key: table_path(root, key, as_of), store)


class FromEvents:
    """The session-level tables, from a scan of each window."""

    def __init__(self, events: DataFrame, as_of: dt.date):
        self.events, self.as_of = events, as_of

    def facts(self) -> DataFrame:
        return sessions.session_facts(self.events, self.as_of, 60)

    def items(self) -> list[DataFrame]:
        return commerce.items_by_session_windows(self.events, self.as_of, (60, 30))

    def funnels(self) -> tuple[DataFrame, DataFrame]:
        return funnel.closed_funnel_pair(self.events, self.as_of, 30)

    def acquisition(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return acquisition.acquisition_reports(self.events, self.as_of, 30)

    def attribution(self) -> list[DataFrame]:
        return attribution.attribution_reports(self.events, self.as_of, 30, 30)


class FromStore:
    """The same tables, put together from the days' states."""

    def __init__(self, store: DayStore, as_of: dt.date):
        self.store, self.as_of = store, as_of

    def facts(self) -> DataFrame:
        columns = ["user_pseudo_id", "session_id", "session_engaged", *rollups.SMC, "purchase_flag", "user_id"]
        return self.store.merged(rollups.SESSIONS, self.as_of, 60).select(*columns)

    def items(self) -> list[DataFrame]:
        return [self.store.merged(rollups.ITEMS, self.as_of, days) for days in (60, 30)]

    def funnels(self) -> tuple[DataFrame, DataFrame]:
        groups = funnel.day_groups_from(self.store.merged(rollups.FUNNEL, self.as_of, 30))
        return funnel.closed_funnel_pair_from(scratch_table(groups, "funnel_days"))

    def acquisition(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        fine = scratch_table(self.store.merged(rollups.ACQUISITION, self.as_of, 30), "acquisition_sessions")
        return acquisition.acquisition_reports_from(fine)

    def numbered(self, conversion_days: int = 30, acquisition_days: int = 30) -> DataFrame:
        """Attribution's session table."""
        full = {"end_offset": 1, "include_intraday": False}
        conv = attribution.first_conversion_from(self.store.merged(rollups.CONVERSIONS, self.as_of, conversion_days, **full))
        states = self.store.read(rollups.SESSIONS, self.as_of, conversion_days + acquisition_days, **full)
        labels = [attribution.label_name(d) for d in (rollups.SM, rollups.SMC)]

        def sessions_of(rows: DataFrame) -> DataFrame:
            return rows.groupBy("user_pseudo_id", "session_id").agg(
                F.min("session_start").alias("session_start"), *[F.max(c).alias(c) for c in labels]
            )

        return attribution.numbered_sessions(conv, states, sessions_of, labels, acquisition_days)

    def attribution(self) -> list[DataFrame]:
        raw = self.numbered()
        return [attribution.attribution_from(raw, d) for d in (rollups.SM, rollups.SMC)]


def save_all(
    spark: SparkSession,
    events: DataFrame,
    buyer_flags: DataFrame,
    campaigns: DataFrame,
    as_of: dt.date,
    path_of: Callable[[str], str],
    store: DayStore | None = None,
) -> dict[str, str]:
    """Write every report to `path_of(key)`; returns report key -> path."""
    out: dict[str, str] = {}
    tables = FromEvents(events, as_of) if store is None else FromStore(store, as_of)

    def save(key: str, df: DataFrame) -> DataFrame:
        path = path_of(key)
        write_table(df, path)
        out[key] = path
        return read_table(spark, path)

    # R13, R12, R3 and R2 re-aggregate one per-session table: scan once
    facts = scratch_table(tables.facts(), "session_facts")
    r13 = save("r13", facts.select("user_pseudo_id", "session_id", "session_engaged", "source", "medium", "campaign"))
    r8_60, r8_30 = tables.items()
    save("r08", r8_60)
    r8_30 = save("r08_30", r8_30)
    r12 = save("r12", buyers.session_user_counts_from(facts))
    r3 = save("r03", buyers.buyer_behavior_by_user_from(buyers.user_accounts(facts), buyer_flags))
    r2 = save("r02", buyers.buyer_behavior_by_campaign_from(facts, r3))
    r4 = save("r04", commerce.cart_abandonment(events, as_of, 1))
    save("r01", commerce.abandoned_cart_user_ids(r4))
    # R5 and R6 from one per-(session, day) table; R14, R15 and R7 from one
    # per-(session, first-user labels) table: two scans of the 30-day window
    r5, r6 = tables.funnels()
    save("r05", r5)
    save("r06", r6)
    r14, r15, r7 = tables.acquisition()
    save("r07", r7)
    # both attribution reports from one numbered session table
    r10, r11 = tables.attribution()
    save("r10", r10)
    save("r11", r11)
    save("r14", r14)
    save("r15", r15)
    save("r09", email.email_campaign_stats_from(r13, r8_30, r12, r2, campaigns))
    return out


def main(argv: list[str] | None = None) -> None:
    """python -m clickfold.plans.daily --events PATH --buyers PATH
    --campaigns PATH (--out PATH | --publish-to PATH) [--store PATH]
    [--as-of YYYY-MM-DD] [--layout shards] [--campaigns-format csv]"""
    import argparse

    ap = argparse.ArgumentParser(prog="python -m clickfold.plans.daily", description=main.__doc__)
    ap.add_argument("--events", required=True, help="export root")
    ap.add_argument(
        "--layout", choices=("partitions", "shards"), default="partitions",
        help="folders of the export: event_date=/export_kind=, or events_YYYYMMDD and events_intraday_YYYYMMDD",
    )
    ap.add_argument("--buyers", required=True, help="buyer flags table (const_id, new, renew, lapsed)")
    ap.add_argument("--campaigns", required=True, help="mailing statistics table")
    ap.add_argument("--campaigns-format", default="parquet")
    ap.add_argument("--buyers-format", default="parquet")
    to = ap.add_mutually_exclusive_group(required=True)
    to.add_argument("--out", help="root folder of the report tables, one folder per table and day")
    to.add_argument("--publish-to", help="root folder of published sets: all tables become visible at once")
    ap.add_argument("--store", help="root folder of the day store: only new or changed days are read")
    ap.add_argument("--as-of", default=utc_today().isoformat(), help="the run's 'today' (default: today, UTC)")
    ap.add_argument("--strict-params", action="store_true", help="fail on events that hold a looked-up parameter twice")
    ap.add_argument("--keep-scratch", action="store_true", help="keep the shared intermediate tables")
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or get_spark(app="clickfold-daily")
    from clickfold.plans.published import publish_reports

    opts = {"header": "true"} if args.campaigns_format == "csv" else {}
    source = (ShardFolders if args.layout == "shards" else PartitionedExport)(args.events.rstrip("/"))
    as_of = dt.date.fromisoformat(args.as_of)
    with strict_params(args.strict_params):
        store = None
        if args.store:
            store = DayStore(spark, args.store.rstrip("/"))
            store.refresh(source, as_of)
        save = publish_reports if args.publish_to else save_reports
        paths = save(
            spark,
            source.events(spark),
            read_buyers(spark, args.buyers, fmt=args.buyers_format),
            read_campaigns(spark, args.campaigns, fmt=args.campaigns_format, **opts),
            as_of,
            args.publish_to or args.out,
            keep_scratch=args.keep_scratch,
            store=store,
        )
    for key, path in sorted(paths.items()):
        print(f"{key}\t{path}")


if __name__ == "__main__":
    main()
