"""Skew check: does any task get the hot user's rows?

Derives a skewed export from the driver's events: every third event is moved
to one user ("u0"), whose events are cut into 10-minute sessions, so that
user holds a third of all events and most sessions. Runs reports with the
Spark event log written to a scratch folder and prints, per report, the
largest share of shuffled records any single task read in any stage
(1/partitions is perfect balance, 1.0 means one task got everything), next
to a naive per-user `row_number()` window on the same rows for contrast.
The hot user buys only in the last days, so all its sessions enter the
attribution look-back.

AQE's skew thresholds are scaled down to the test data (at scale the
defaults, 256 MB and 5x the median, play the same role).

With --hot-session the hot user's events all carry one session id instead
(one session holds a third of all events).

usage: python tools/skew_check.py [sf_dir] [--hot-session] [-v]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

REPORTS = [
    "r01_abandoned_cart_user_ids", "r02_buyer_behavior_by_campaign", "r03_buyer_behavior_by_user",
    "r04_cart_abandonment", "r05_closed_funnel_by_date", "r06_closed_funnel", "r07_geo_by_session",
    "r08_items_by_session", "r09_email_campaign_stats", "r10_attribution_source_medium",
    "r11_attribution_source_medium_campaign", "r12_session_user_counts", "r13_session_source",
    "r14_traffic_acquisition", "r15_user_acquisition",
]


def skewed_export(spark, sf_dir: str, out: str, hot_session: bool = False):
    from pyspark.sql import functions as F

    from clickfold.sources.events import read_events
    from clickfold.sources.fixture import nested_events

    flat = spark.read.parquet(f"{sf_dir}/events.parquet")
    flat = flat.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    nested = nested_events(flat)
    hot = F.col("user_pseudo_id") == "u0"
    # many 10-minute sessions, or (hot_session) one session id for all of them
    ten_minutes = F.lit(1).cast("bigint") if hot_session else F.floor(F.col("event_timestamp") / F.lit(600_000_000))
    params = F.transform(
        "event_params",
        lambda p: F.when(
            hot & (p["key"] == "ga_session_id"),
            F.struct(p["key"].alias("key"), F.struct(p["value"]["string_value"].alias("string_value"),
                                                     ten_minutes.alias("int_value")).alias("value")),
        ).otherwise(p),
    )
    # the hot user buys only in the last days, so its whole history falls in
    # the attribution look-back and goes through the per-user numbering
    late = F.col("event_date") >= F.lit("20240128")
    name = F.when(hot & (F.col("event_name") == "purchase") & ~late, F.lit("page_view")).otherwise(F.col("event_name"))
    (nested.withColumn("event_params", params).withColumn("event_name", name)
     .repartition(8, "event_date", "export_kind")
     .write.mode("overwrite").partitionBy("event_date", "export_kind").parquet(out))
    return read_events(spark, out)


#: Records from which a single-task stage is reported.
MANY = 3000


def read_log(log_dir: str) -> list[dict]:
    import zstandard

    events = []
    for f in glob.glob(f"{log_dir}/*/events_*") + glob.glob(f"{log_dir}/*"):
        if os.path.isdir(f):
            continue
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode(errors="replace").splitlines():
            try:
                events.append(json.loads(line))
            except ValueError:
                pass
    return events


def stage_shares(events: list[dict], detail: bool = False) -> dict[str, tuple[float, int]]:
    """job group -> (largest task share of records read in any stage with
    >= 1000 records, records in that stage). A stage of one task counts too
    once it holds as many records as MANY: below that, AQE has coalesced a
    small stage; above, everything goes through one task."""
    group_of_stage, per_stage, names = {}, {}, {}
    for e in events:
        if e["Event"] == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            names[info["Stage ID"]] = " <- ".join(r["Name"] for r in info.get("RDD Info", [])[:3])[:90]
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e["Stage IDs"]:
                group_of_stage[s] = g
        elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            m = e["Task Metrics"]
            # shuffle reads only: how keyed work is spread (scan splits follow
            # the file layout, by bytes at scale)
            recs = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
            per_stage.setdefault(e["Stage ID"], []).append(recs)
    out: dict[str, tuple[float, int]] = {}
    for s, recs in per_stage.items():
        g, tot = group_of_stage.get(s), sum(recs)
        if g is None or tot < 1000:
            continue
        share = max(recs) / tot
        if detail:
            print(f"  {g!s:32s} stage {s:4d} tasks={len(recs):3d} records={tot:7d} max={max(recs):7d} "
                  f"share={share:.3f} {names.get(s, '')}", file=sys.stderr)
        if len(recs) == 1 and tot < MANY or "PartitionwiseSampledRDD" in names.get(s, ""):
            # a whole small stage coalesced into one task, or the range
            # partitioner's sampling pass: not keyed work
            continue
        if share > out.get(g, (0.0, 0, 0))[0]:
            out[g] = (share, tot, max(recs))
    return out


def main() -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from clickfold.plans import registry
    from clickfold.session import get_spark

    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="clickfold-skew-", dir="/tmp")
    log_dir = f"{scratch}/eventlog"
    os.makedirs(log_dir)
    spark = get_spark(app="clickfold-skew", cores=8, shuffle_partitions=16, extra={
        "spark.eventLog.enabled": "true",
        "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        # --broadcast: Spark's default, so small sides (buyer flags) are broadcast as in production
        **({} if "--broadcast" in sys.argv else {"spark.sql.autoBroadcastJoinThreshold": "-1"}),
    })
    hot_session = "--hot-session" in sys.argv
    ev = skewed_export(spark, sf_dir, f"{scratch}/export", hot_session)
    total = ev.count()
    hot = ev.where("user_pseudo_id = 'u0'").count()
    sessions = ev.select("user_pseudo_id", F.expr("get(filter(event_params, p -> p.key = 'ga_session_id'), 0).value.int_value").alias("s")).distinct()
    hot_sessions = sessions.where("user_pseudo_id = 'u0'").count()
    all_sessions = sessions.count()
    registry._ev = lambda spark_, sf: ev  # run the catalog's reports on the skewed export
    only = next((a.removeprefix("--only=").split(",") for a in sys.argv if a.startswith("--only=")), None)
    for name in REPORTS if only is None else [r for r in REPORTS if r[:3] in only]:
        spark.sparkContext.setJobGroup(name, name)
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"ran {name} in {time.time() - t:.1f}s", file=sys.stderr)
    # contrast: a plain per-user window over the session rows
    spark.sparkContext.setJobGroup("naive_user_window", "naive")
    sess = ev.groupBy("user_pseudo_id", F.expr("get(filter(event_params, p -> p.key = 'ga_session_id'), 0).value.int_value").alias("sid")).agg(F.min("event_timestamp").alias("t"))
    sess.withColumn("rn", F.row_number().over(Window.partitionBy("user_pseudo_id").orderBy("t", "sid"))) \
        .write.format("noop").mode("overwrite").save()
    spark.stop()
    shares = stage_shares(read_log(log_dir), detail="-v" in sys.argv)
    print(json.dumps({
        "events": total, "hot_user_events": hot, "sessions": all_sessions, "hot_user_sessions": hot_sessions,
        "worst_stage_by_report": {
            k: {"max_task_share": round(v[0], 3), "stage_records": v[1], "max_task_records": v[2]}
            for k, v in sorted(shares.items())
        },
        "balanced_share": round(1 / 16, 3),
    }, indent=1))


if __name__ == "__main__":
    main()
