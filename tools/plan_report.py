"""Write PLANS.md: the physical plan shape of every report.

For each report (default parameters, sf0.01 fixture export): the scans with
their partition filters, pushed filters and read columns, and counts of
exchanges, joins, windows and aggregates in the plan Spark picks before
running (AQE may still switch sort-merge joins to broadcast at run time).
Reports that write scratch tables first (attribution, e-mail chain, buyer
mix) run those jobs when they are called; each is listed with its own scans
as "writes <table>", ahead of the plan that reads them.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

REPORTS = [
    "r01_abandoned_cart_user_ids", "r02_buyer_behavior_by_campaign", "r03_buyer_behavior_by_user",
    "r04_cart_abandonment", "r05_closed_funnel_by_date", "r06_closed_funnel", "r07_geo_by_session",
    "r08_items_by_session", "r09_email_campaign_stats", "r10_attribution_source_medium",
    "r11_attribution_source_medium_campaign", "r12_session_user_counts", "r13_session_source",
    "r14_traffic_acquisition", "r15_user_acquisition",
]


def field(line: str, name: str) -> str:
    m = re.search(name + r": (\[[^\]]*\]|struct<[^ ]*>)", line)
    return m.group(1) if m else ""


def summarize(plan: str) -> tuple[list[str], dict[str, int]]:
    scans = []
    for line in plan.split("\n"):
        if "FileScan parquet" not in line:
            continue
        loc = "scratch table" if "clickfold-tables" in line else ("customer" if "customer.parquet" in line else "event export")
        schema = field(line, "ReadSchema")
        cols = re.findall(r"([a-z_]+):", schema)[:8]
        scans.append(
            f"| {loc} | `{field(line, 'PartitionFilters')[:110]}` | `{field(line, 'PushedFilters')[:90]}` | {', '.join(dict.fromkeys(cols))} |"
        )
    counts = {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "hash aggregates": plan.count("HashAggregate("),
        "sort aggregates": plan.count("SortAggregate("),
        "expand (distinct)": plan.count("Expand ["),
    }
    return scans, counts


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    from clickfold.operators import acquisition, attribution, buyers, commerce, email, funnel
    from clickfold.plans.registry import QUERIES
    from clickfold.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(cores=8, extra={"spark.sql.maxMetadataStringLength": "1000"})
    out = [
        "# Physical plans of the reports",
        "",
        f"Generated by `tools/plan_report.py` on `{sf}` (the fixture export), Spark {spark.version}, "
        "default thresholds. Plans as chosen before execution; AQE can still turn a sort-merge join "
        "into a broadcast join, coalesce or split partitions at run time.",
        "",
    ]
    written: list[tuple[str, str]] = []
    for module in (acquisition, attribution, buyers, commerce, email, funnel):
        write = getattr(module, "scratch_table", None)
        if write is not None:
            module.scratch_table = lambda df, table, write=write: (written.append((table, plan_of(df))), write(df, table))[1]
    for name in REPORTS:
        written.clear()
        df = QUERIES[name](spark, sf)
        out += [f"## {name}", ""]
        for title, plan in [*((f"writes {t}", p) for t, p in written), ("result", plan_of(df))]:
            scans, counts = summarize(plan)
            out += [f"**{title}**", "", "| scan | partition filters | pushed filters | columns read |", "|---|---|---|---|"]
            out += scans
            out += ["", ", ".join(f"{k}: {v}" for k, v in counts.items() if v), ""]
    spark.stop()
    print("\n".join(out))


if __name__ == "__main__":
    main()
