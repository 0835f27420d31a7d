import datetime as dt
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from clickfold import session
from clickfold.plans import daily
from clickfold.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_settings_of_a_submitted_job_are_kept():
    """get_spark() in a fresh process takes master and partitions as given."""
    code = (
        "from clickfold.session import get_spark; s = get_spark(); "
        "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.sparkContext.getConf().get('spark.driver.memory', 'unset'))"
    )
    env = os.environ | {
        "PYTHONPATH": ROOT,
        "PYSPARK_SUBMIT_ARGS": "--master local[1] --conf spark.sql.shuffle.partitions=777 --conf spark.ui.enabled=false pyspark-shell",
    }
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180, check=True).stdout
    got = next(line for line in out.splitlines() if line.startswith("GOT")).split()
    assert got[1:3] == ["local[1]", "777"] and got[3] != "16g"


def _session(master, configured=None):
    conf = {"spark.checkpoint.dir": configured} if configured else {}
    made = []
    sc = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append,
        getConf=lambda: SimpleNamespace(get=lambda k, d=None: conf.get(k, d)),
    )
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(_session(master))
        assert session.ensure_checkpoint_dir(_session(master, "hdfs://shared")) == "hdfs://shared"
    assert session.ensure_checkpoint_dir(_session("local[4]")).startswith("/tmp/clickfold-ckpt-")


def test_default_day_is_utc():
    assert abs((daily.utc_today() - dt.datetime.now(dt.timezone.utc).date()).days) <= 1


def test_nested_scratch_scopes(spark):
    df = spark.range(3)
    exists = lambda d: bool(d.inputFiles()) and os.path.exists(d.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    with tables.scratch_scope(spark) as outer:
        with tables.scratch_scope(spark) as inner:
            a = tables.scratch_table(df, "a")
            assert exists(a) and len(inner) == len(outer) == 1
        assert not exists(a) and outer == []
        b = tables.scratch_table(df, "b")
        with tables.scratch_scope(spark, keep=True):
            c = tables.scratch_table(df, "c")
        assert exists(b) and exists(c) and b.count() == c.count() == 3
    assert not exists(b) and not exists(c)


def test_free_scratch_of_one_report(spark, tmp_path):
    a = tables.scratch_table(spark.range(5), "lone")
    other = spark.range(2)
    other.write.parquet(f"{tmp_path}/kept")
    kept = spark.read.parquet(f"{tmp_path}/kept")
    freed = tables.free_scratch(a.join(kept, "id"))
    assert len(freed) == 1 and "lone-" in freed[0]
    assert kept.count() == 2
    assert tables.free_scratch(kept) == []
