"""All registered queries against the oracle on freshly generated flat
tables (driver schema, random users/types/values/props), not only on the
driver's one dataset. One set has unique times, as in the driver's data;
the other puts events on a 20-minute grid, so many events of a user share a
time and every tie-break (which the source reports leave open) is
exercised on both sides."""

import datetime as dt
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clickfold.plans.registry import QUERIES
from oracle.compare import compare, duckdb_for
from oracle.queries import SQL

TYPES = ["view", "click", "purchase", "signup", "error"]


def random_tables(seed: int, n_events: int = 1500, n_users: int = 24, equal_times: bool = False) -> str:
    rnd = random.Random(seed)
    d = tempfile.mkdtemp(prefix=f"clickfold-rand-{seed}-", dir="/tmp")
    start = dt.datetime(2023, 12, 20)
    rows = []
    for eid in range(n_events):
        uid = rnd.randrange(n_users) if rnd.random() < 0.7 else rnd.randrange(3)  # a few busy users
        if equal_times:
            ts = start + dt.timedelta(minutes=rnd.randrange(41 * 72) * 20)  # 20-minute grid
        else:
            secs = rnd.uniform(0, 41 * 86400)
            ts = start + dt.timedelta(seconds=secs, microseconds=eid)  # unique per event
        rows.append((eid, ts, uid, rnd.choice(TYPES), round(rnd.uniform(0, 60), 2), f'{{"k": {rnd.randrange(100)}}}'))
    cols = list(zip(*rows))
    events = pa.table({
        "event_id": pa.array(cols[0], pa.int64()),
        "ts": pa.array(cols[1], pa.timestamp("us")),
        "user_id": pa.array(cols[2], pa.int64()),
        "event_type": pa.array(cols[3], pa.string()),
        "value": pa.array(cols[4], pa.float64()),
        "props": pa.array(cols[5], pa.string()),
    })
    pq.write_table(events, f"{d}/events.parquet")
    keys = list(range(n_users + 5))
    pq.write_table(pa.table({
        "c_custkey": pa.array(keys, pa.int64()),
        "c_name": pa.array([f"Customer#{k}" for k in keys]),
    }), f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("seed, equal_times", [(11, False), (5, True)])
def test_random_tables_match_oracle(spark, seed, equal_times):
    d = random_tables(seed, equal_times=equal_times)
    con = duckdb_for(d)
    bad = []
    for name in sorted(QUERIES):
        r = compare(QUERIES[name](spark, d), con, SQL[name])
        if not r.ok:
            bad.append((name, r))
    assert not bad, bad[:3]
