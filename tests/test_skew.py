"""Skew regression: on an export where one user holds most sessions (or one
session a third of all events), no report stage gives one task a large
share of the shuffled records, while a plain per-user window does. Runs
tools/skew_check.py in its own process (it needs its own Spark session with
the event log on)."""

import json
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args):
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "tools", "skew_check.py"), "/root/testdata/sf0.01", *args],
        capture_output=True, text=True, timeout=900, cwd=ROOT,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads(out.stdout)


@pytest.mark.parametrize("variant", ["hot-user", "hot-session", "broadcast"])
def test_no_report_stage_concentrates_the_hot_key(variant):
    # with default broadcasts the user joins of R2 and R9 are the ones to watch
    args = {"hot-user": [], "hot-session": ["--hot-session"], "broadcast": ["--broadcast", "--only=r02,r09"]}[variant]
    res = run(*args)
    worst = res["worst_stage_by_report"]
    naive = worst.pop("naive_user_window")["max_task_share"]
    if variant != "hot-session":
        assert res["hot_user_sessions"] / res["sessions"] > 0.5
        assert naive > 0.5  # the data is skewed
    else:
        assert res["hot_user_events"] / res["events"] > 0.3
    for name, w in worst.items():
        assert w["max_task_share"] < 0.35, (name, w)
