
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickfold.operators import attribution as attr
from clickfold.operators import buyers, funnel, sessions
from clickfold.operators.ordinal import ordinal_by_carry, ordinal_within
from clickfold.sources.fixture import export_for
from tests.helpers import AS_OF

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ev(spark):
    return export_for(spark, SF)


@pytest.fixture(scope="module")
def weights(ev):
    return attr.model_weights(attr.attribution_sessions(ev, AS_OF, 10, 10)).cache()


def test_weights_sum_to_one_without_null_session(weights):
    per_user = weights.groupBy("user_pseudo_id").agg(
        F.max("session_rows").alias("m"), F.max("total_session_per_user").alias("n"),
        F.sum("w_linear").alias("lin"), F.sum("w_time_decay").alias("td"), F.sum("w_position_based").alias("pb"),
    )
    clean = per_user.where("m = n").collect()
    assert len(clean) > 50
    for r in clean:
        for k in ("lin", "td", "pb"):
            assert abs(r[k] - 1.0) < 1e-9, (r, k)
    # a NULL session makes linear still sum to one
    for r in per_user.where("m > n").collect():
        assert abs(r["lin"] - 1.0) < 1e-9


def test_click_models_sum_to_user_counts(ev, weights):
    out = {r["attribution_model"]: r["s"] for r in attr.attribution(ev, AS_OF, 10, 10)
           .groupBy("attribution_model").agg(F.sum("attribution_weight").alias("s")).collect()}
    users = weights.select("user_pseudo_id").distinct().count()
    with_sessions = weights.where("total_session_per_user > 0").select("user_pseudo_id").distinct().count()
    assert out["first click"] == users
    assert out["last click"] == with_sessions
    assert abs(out["linear"] - users) < 1e-6


def test_session_numbers_are_one_to_m(weights):
    bad = weights.groupBy("user_pseudo_id").agg(
        F.count("*").alias("c"), F.max("session_number").alias("mx"),
        F.countDistinct("session_number").alias("d"), F.max("session_rows").alias("m"))
    assert bad.where("c != mx OR d != c OR m != c").count() == 0


def test_funnel_counts_do_not_grow(ev):
    for by_date in (True, False):
        df = funnel.closed_funnel(ev, AS_OF, by_date=by_date)
        assert df.where("sessions_add_to_cart > sessions_page_view OR sessions_purchase > sessions_add_to_cart").count() == 0


def test_r12_equals_r13_reaggregated(ev):
    r13 = sessions.session_source(ev, AS_OF)
    key = F.concat("user_pseudo_id", F.col("session_id").cast("string"))
    again = r13.groupBy("source", "medium", "campaign").agg(
        F.count(key).alias("count_sessions"),
        F.count(F.when(F.col("session_engaged") == "1", key)).alias("count_engaged_sessions"),
        F.countDistinct("user_pseudo_id").alias("count_users"),
    )
    r12 = buyers.session_user_counts(ev, AS_OF)
    assert r12.exceptAll(again).count() == 0 and again.exceptAll(r12).count() == 0


def test_ordinal_within_equals_row_number_with_a_hot_key(spark):
    # key 0 holds most rows, spread over many buckets, with ties in t
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(0)).alias("k"),
        ((F.col("id") * 7919) % 5000).alias("t"),
        F.col("id").alias("tie"),
    )
    got = ordinal_within(df, "k", [F.col("t"), F.col("tie")], bucket_of=F.floor(F.col("t") / 100), name="rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "tie")))
    assert got.select("k", "t", "tie", "rn").exceptAll(want.select("k", "t", "tie", "rn")).count() == 0
    assert got.count() == want.count()


def test_attribution_same_without_scratch_tables(ev):
    a = attr.attribution(ev, AS_OF, 10, 10).select("attribution_model", "source_medium", F.round("attribution_weight", 9))
    b = attr.attribution(ev, AS_OF, 10, 10, materialize=False).select(
        "attribution_model", "source_medium", F.round("attribution_weight", 9))
    raw_a = attr.attribution_sessions(ev, AS_OF, 10, 10).select("user_pseudo_id", "session_id", "session_number")
    raw_b = attr.attribution_sessions(ev, AS_OF, 10, 10, materialize=False).select(
        "user_pseudo_id", "session_id", "session_number")
    assert raw_a.exceptAll(raw_b).count() == 0 and raw_b.exceptAll(raw_a).count() == 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordinal_within_random(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        k = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)      # one hot key
        t = rnd.randint(0, 400) if rnd.random() < 0.9 else None   # ties and NULLs in t
        rows.append((k, t, i))
    df = spark.createDataFrame(rows, "k int, t int, tie int").repartition(7)
    order = [F.col("t").asc_nulls_first(), F.col("tie")]
    for bucket in (F.coalesce(F.floor(F.col("t") / 37), F.lit(-1)),
                   None):
        if bucket is None:
            ranged = df.repartitionByRange(5, "k", *order).withColumn("_b", F.spark_partition_id())
            ranged = ranged.checkpoint()  # fix the partition index, as a written table does
            got = ordinal_within(ranged, "k", order, bucket_of=F.col("_b"), name="rn").drop("_b")
        else:
            got = ordinal_within(df, "k", order, bucket_of=bucket, name="rn")
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_by_carry_random(spark, seed, partitions):
    import random

    rnd = random.Random(seed)
    rows = []
    for i in range(3000):
        k = "hot" if rnd.random() < 0.6 else None if rnd.random() < 0.1 else f"k{rnd.randint(1, 40)}"
        rows.append((k, rnd.randint(0, 400) if rnd.random() < 0.9 else None, i, rnd.random() < 0.05))
    df = spark.createDataFrame(rows, "k string, t int, tie int, mark boolean").repartition(5)
    order = [F.col("t").asc_nulls_first(), F.col("tie").asc()]
    batch, width = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # runs over many batches
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = ordinal_by_carry(
            df, "k", order, name="rn", counts={"n": F.lit(True), "with_t": F.col("t").isNotNull()}, last={"at": (F.col("mark"), F.struct("t", "tie"))}
        )
        whole = Window.partitionBy("k")
        want = df.select(
            "*", F.row_number().over(whole.orderBy(*order)).cast("long").alias("rn"), F.count(F.lit(1)).over(whole).alias("n"),
            F.count("t").over(whole).alias("with_t"), F.max(F.when(F.col("mark"), F.struct("t", "tie"))).over(whole).alias("at"),
        )
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
        empty = ordinal_by_carry(df.limit(0), "k", order, counts={"n": F.lit(True)}, last={"at": (F.col("mark"), F.col("t"))})
        assert empty.collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_attribution_reports_share_one_table(ev):
    both = attr.attribution_reports(ev, AS_OF, 10, 10)
    for got, dims in zip(both, (("source", "medium"), ("source", "medium", "campaign"))):
        want = attr.attribution(ev, AS_OF, 10, 10, dims)
        r = lambda df: df.select(df.columns[0], df.columns[1], F.round("attribution_weight", 9))
        assert r(got).exceptAll(r(want)).count() == 0 and r(want).exceptAll(r(got)).count() == 0


def _same(a, b):
    r = lambda df: df.select(*[F.round(c, 9) if t == "double" else F.col(c) for c, t in df.dtypes])
    return r(a).exceptAll(r(b)).count() == 0 and r(b).exceptAll(r(a)).count() == 0


def test_shared_tables_give_the_standalone_reports(ev):
    from clickfold.operators import acquisition, funnel, sessions

    r5, r6 = funnel.closed_funnel_pair(ev, AS_OF, 30)
    assert _same(r5, funnel.closed_funnel(ev, AS_OF, 30, by_date=True))
    assert _same(r6, funnel.closed_funnel(ev, AS_OF, 30, by_date=False))
    r14, r15, r7 = acquisition.acquisition_reports(ev, AS_OF, 30)
    assert _same(r14, acquisition.traffic_acquisition(ev, AS_OF, 30))
    assert _same(r15, acquisition.user_acquisition(ev, AS_OF, 30))
    assert _same(r7, sessions.geo_by_session(ev, AS_OF, 30))


def test_item_windows_from_one_scan(ev):
    from clickfold.operators import commerce

    for got, days in zip(commerce.items_by_session_windows(ev, AS_OF, (60, 10, 5)), (60, 10, 5)):
        assert _same(got, commerce.items_by_session(ev, AS_OF, days))
