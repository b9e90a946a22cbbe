import math

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from flowmill.functions import flow, time
from flowmill.operators import encode as enc
from flowmill.operators import scale as sc
from flowmill.operators import sessions
from flowmill.plans import features as plan
from flowmill.sources import schemas as S


@pytest.mark.parametrize("unit,factor", [("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)])
def test_units_give_the_same_hour_and_day(flows, unit, factor):
    df = flows({"timestamp": 1_700_000_000 * factor}).withColumns(flow.time_columns("timestamp", unit))
    assert rows_of(df, "hour", "dayofweek") == [(22, 2)]  # 2023-11-14 22:13:20, a Tuesday


def test_unknown_unit_is_refused():
    with pytest.raises(ValueError, match="unit"):
        time.to_timestamp(F.lit(1), "minutes")


def test_weekend_days(flows):
    friday = 1_700_179_200  # 2023-11-17
    df = flows(*[{"timestamp": friday + d * 86_400} for d in range(3)]).withColumns(flow.time_columns())
    both = df.select("event_id", "is_weekend", time.weekend_flag(F.col("dayofweek"), (0, 6)).alias("calendar"))
    assert sorted(rows_of(both, "event_id", "is_weekend", "calendar")) == [(0, 1, 0), (1, 1, 1), (2, 0, 1)]


def test_logs_ratios_and_crosses_of_odd_rows(flows):
    df = flows(
        {"bytes_transferred": 0.0, "packet_count": 0}, {"bytes_transferred": -1.0, "packet_count": -1},
        {"conn_state": None},
    )
    out = df.select(
        "event_id", *[c.alias(n) for n, c in flow.log_columns().items()], flow.bytes_per_packet().alias("bpp"),
        flow.packets_per_byte().alias("ppb"), flow.protocol_conn().alias("cross"),
    ).orderBy("event_id").collect()
    assert (out[0]["bytes_log"], out[0]["packet_log"], out[0]["bpp"], out[0]["ppb"]) == (0.0, 0.0, 0.0, 0.0)
    assert (out[1]["bytes_log"], out[1]["packet_log"], out[1]["bpp"], out[1]["ppb"]) == (None, None, None, None)
    assert out[2]["cross"] == "TCP"


def test_null_and_unseen_categories(flows):
    train = flows({"protocol": "UDP"}, {"protocol": "TCP"}, {"protocol": None})
    other = flows({"protocol": "GRE"}, {"protocol": None}, {"protocol": "UDP"})
    learned = enc.learn_encoders(train, ("protocol",))
    assert learned == {"protocol": {"TCP": 0, "UDP": 1}}
    for encoders in (learned, enc.fit_encoder(train, ("protocol",)), {"protocol": {}}):
        want = [-1, -1, -1] if encoders == {"protocol": {}} else [-1, -1, 1]
        got = enc.encode(other, encoders, ("protocol",)).orderBy("event_id")
        assert [r["protocol_idx"] for r in got.collect()] == want


@pytest.fixture
def few_frequent(monkeypatch):
    def encode(df, table):
        monkeypatch.setattr(enc, "FREQUENT", 5)
        return enc.encode(df, table, ("c",), broadcast_values=10)

    return encode


def test_every_way_to_look_up_an_index_agrees(spark, few_frequent):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), (F.col("id") % 700)).alias("c"))
    df = df.withColumn("c", F.when(F.col("id") % 11 != 0, F.col("c")))
    table = enc.fit_encoder(df, ("c",))
    learned = enc.learn_encoders(df, ("c",))
    assert sorted(learned["c"].values()) == list(range(len(learned["c"])))
    ways = [
        enc.encode(df, learned, ("c",), literal_values=10_000),
        enc.encode(df, learned, ("c",)),
        enc.encode(df, table, ("c",)),
        enc.encode(df, table, ("c",), broadcast_values=10),  # all values frequent
        few_frequent(df, table),
        enc.encode(df, enc.learn_encoders(df, ("c",), driver_values=10), ("c",)),
    ]
    results = [sorted(rows_of(w, "id", "c", "c_idx"), key=str) for w in ways]
    assert all(r == results[0] for r in results) and len(results[0]) == 3000


@pytest.mark.parametrize("by", ["value", "frequency"])
def test_large_vocabulary_is_ranked_like_a_small_one(spark, by):
    df = spark.range(4000).select(
        F.sha1((F.col("id") % 900).cast("string")).alias("a"), (F.col("id") % 7).cast("string").alias("b")
    )
    small = enc.fit_encoder(df, ("a", "b"), by)
    large = enc.fit_encoder(df, ("a", "b"), by, rank_rows=50)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    learned = enc.learn_encoders(df, ("a", "b"), by)
    assert {(r["column"], r["value"], r["idx"]) for r in large.collect()} == {
        (c, v, i) for c, values in learned.items() for v, i in values.items()
    }


def test_constant_column_and_single_row_scale_to_zero(flows):
    for df in (flows({}, {}, {}), flows({})):
        scaler = sc.fit_scaler(df, ("packet_count",))
        assert scaler == {"packet_count": {"mean": 10.0, "std": 1.0}}
        assert {r["packet_count_norm"] for r in sc.scale(df, scaler, ("packet_count",)).collect()} == {0.0}


def test_scaler_needs_values(flows):
    with pytest.raises(ValueError, match="packet_count"):
        sc.fit_scaler(flows({"packet_count": None}), ("packet_count",))


def test_scaler_defaults_for_missing_parameters(flows):
    df = flows({"packet_count": 12})
    assert sc.scale(df, {}, ("packet_count",)).first()["packet_count_norm"] == 12.0
    zero = {"packet_count": {"mean": 2.0, "std": 0.0}}
    assert sc.scale(df, zero, ("packet_count",)).first()["packet_count_norm"] == 10.0


def test_scaled_training_columns_have_mean_0_and_deviation_1(spark, sf_dir):
    from __spark_entry__ import queries

    out = queries()["features_final"](spark, sf_dir)
    stats = out.agg(*[F.avg(f"{c}_norm").alias(f"m_{c}") for c in S.NUMERIC],
                    *[F.stddev_samp(f"{c}_norm").alias(f"s_{c}") for c in S.NUMERIC]).first()
    for c in S.NUMERIC:
        assert abs(stats[f"m_{c}"]) < 1e-5 and abs(stats[f"s_{c}"] - 1) < 1e-5


def test_population_deviation_counts_nulls_as_zero(flows):
    scaler = sc.fit_scaler(flows({"packet_count": 4}, {"packet_count": None}), ("packet_count",), True, True)
    assert scaler == {"packet_count": {"mean": 2.0, "std": 2.0}}


def test_base_features_without_target_and_with_fill(flows):
    df = flows({}, {"bytes_transferred": None, "packet_count": 20})
    fitted = plan.fit_base(df)
    out = plan.apply_base(df.drop("attack"), fitted)
    assert out.columns == list(S.FEATURES)
    assert out.filter("bytes_log_norm IS NULL").count() == 1
    filled = plan.apply_base(df, fitted, fill=0.0)
    assert filled.columns == [*S.FEATURES, "attack"]
    assert filled.filter("bytes_log_norm IS NULL").count() == 0


def test_parameters_survive_storage(spark, flows, tmp_path):
    fitted = plan.fit_base(flows({}, {"protocol": "UDP", "bytes_transferred": 5.5}))
    fitted.save(spark, str(tmp_path / "p"))
    assert plan.Fitted.load(spark, str(tmp_path / "p")) == fitted
    changed = plan.fit_base(flows({"packet_count": 3}))
    changed.save(spark, str(tmp_path / "p"))  # a new artifact replaces the one held in memory
    assert plan.Fitted.load(spark, str(tmp_path / "p")) == changed


def test_feature_set_registry(flows):
    with pytest.raises(ValueError, match="unknown feature set"):
        plan.feature_set("other")
    own = plan.FeatureSet(lambda df: plan.Fitted({}, {}), lambda df, fitted: df.select("src_port"))
    plan.register("own", own)
    try:
        df = flows({})
        assert plan.feature_set("own").apply(df, own.fit(df)).columns == ["src_port"]
    finally:
        del plan.FEATURE_SETS["own"]


# ---- sessions ---------------------------------------------------------------

def with_logs(df):
    return df.withColumns(flow.log_columns())


def test_one_event_session_and_ties(flows):
    df = with_logs(flows(
        {"event_id": 5, "packet_count": 3}, {"event_id": 1, "packet_count": 1}, {"event_id": 9, "packet_count": 7},
        {"event_id": 2, "dst_port": 80},
    ))
    got = {r["event_id"]: r for r in sessions.session_rolling(df).collect()}
    assert got[2]["prev_packet_mean_3"] is None and got[2]["prev_event_count_3"] == 0
    assert got[1]["prev_event_count_3"] == 0  # equal times: ordered by event id
    assert got[5]["prev_packet_mean_3"] == pytest.approx(math.log1p(1))
    assert got[9]["prev_packet_mean_3"] == pytest.approx((math.log1p(1) + math.log1p(3)) / 2)
    filled = {r["event_id"]: r for r in sessions.session_rolling(df, fill=0.0).collect()}
    assert filled[2]["prev_packet_mean_3"] == 0.0


def skewed(spark):
    """One session with most rows (many at the same second), one with a null key, many short ones."""
    e = F.col("event_id")
    return with_logs(spark.range(6000).withColumnRenamed("id", "event_id").select(
        "event_id",
        F.when(e % 3 == 0, 1).when(e % 3 == 1, 2).otherwise(e % 97).alias("src_port"),
        F.lit(443).cast("long").alias("dst_port"),
        F.when(e % 3 != 1, "TCP").alias("protocol"),
        (F.pmod(F.xxhash64(e), F.lit(1000))).alias("packet_count"),
        (F.pmod(F.xxhash64(e, F.lit(1)), F.lit(10_000)) / 7).alias("bytes_transferred"),
        F.when(e % 2 == 0, 50).otherwise(F.pmod(F.xxhash64(e, F.lit(2)), F.lit(100))).alias("timestamp"),
    ))


def test_long_sessions_cut_into_chunks_give_the_same_windows(spark):
    df = skewed(spark)
    columns = ["event_id", *sessions.PREVIOUS_MEANS, *sessions.PREVIOUS_COUNT, *sessions.STATISTICS]

    def result(hot_rows):
        out = sessions.session_windows(df, hot_rows=hot_rows)
        assert set(out.columns) == {*df.columns, *columns}
        return {r["event_id"]: r for r in out.select(*columns).collect()}

    plain, cut = result(10**6), result(150)
    assert len(cut) == 6000 and cut.keys() == plain.keys()
    for k, want in plain.items():
        for c in columns:
            assert cut[k][c] == (want[c] if want[c] is None else pytest.approx(want[c], rel=1e-12)), (k, c)


def test_chunks_shorter_than_the_look_back(spark):
    df = skewed(spark).filter("event_id < 300")
    plain = sessions.session_rolling(df).orderBy("event_id").collect()
    cut = sessions.session_rolling(df, hot_rows=2).orderBy("event_id").collect()
    for a, b in zip(plain, cut, strict=True):
        assert a["prev_event_count_3"] == b["prev_event_count_3"]
        assert b["prev_bytes_mean_3"] == (None if a["prev_bytes_mean_3"] is None else pytest.approx(a["prev_bytes_mean_3"]))


def test_long_sessions_in_slices_of_time(spark, tmp_path):
    """Without values that fill a slice, both ends of the slices come from the one shuffle of the rows."""
    times = F.pmod(F.xxhash64("event_id", F.lit(3)), F.lit(10**9))
    path = str(tmp_path / "flows")
    skewed(spark).withColumn("timestamp", F.when(F.col("event_id") % 501 > 0, times)).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    columns = ["event_id", *sessions.PREVIOUS_MEANS, *sessions.PREVIOUS_COUNT, *sessions.STATISTICS]
    plain = sessions.session_windows(df).select(*columns).orderBy("event_id").collect()
    for hot_rows in (1000, 150, 2):
        cut = sessions.session_windows(df, hot_rows=hot_rows).select(*columns).orderBy("event_id").collect()
        for a, b in zip(plain, cut, strict=True):
            assert all(x == y if x is None else y == pytest.approx(x, rel=1e-12) for x, y in zip(a, b)), (a, b)
    rolling = sessions.session_rolling(df, hot_rows=150)
    rolling.collect()
    plan = rolling._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
    lag = sessions.session_lag(df, "packet_count", "p", hot_rows=100).orderBy("event_id")
    assert rows_of(lag, "event_id", "p") == rows_of(sessions.session_lag(df, "packet_count", "p").orderBy("event_id"), "event_id", "p")


def test_summary_of_a_table(spark):
    from flowmill.operators import skew

    df = spark.range(60_000).repartition(7).select(F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    found = skew.summary(df, ("k",), "t", 2000)
    assert found.rows == 60_000 and not found.tied and len(found.cuts) == 29
    assert sorted(rows_of(df.filter(found.is_hot(("k",))).groupBy("k").count(), "k", "count")) == [(0, 10_000), (1, 10_001)]
    sizes = df.groupBy(found.slice("t").alias("s")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z")).orderBy("s").collect()
    assert [r["s"] for r in sizes] == list(range(30)) and max(r["n"] for r in sizes) < 2400
    assert all(a["z"] < b["a"] for a, b in zip(sizes, sizes[1:]))
    same = skew.summary(df.withColumn("t", F.lit(5)), ("k",), "t", 2000)
    assert same.tied and skew.summary(df, ("k",), None, 20_000).hot == () == skew.summary(df.limit(0), ("k",), "t").hot


def test_lag_over_chunks(spark):
    df = skewed(spark)
    plain = sessions.session_lag(df, "packet_count", "p").orderBy("event_id")
    cut = sessions.session_lag(df, "packet_count", "p", hot_rows=100).orderBy("event_id")
    assert rows_of(plain, "event_id", "p") == rows_of(cut, "event_id", "p")


def test_hot_keys_are_those_above_the_bound(spark):
    from flowmill.operators import skew

    df = spark.range(5000).select(F.when(F.col("id") < 3000, F.col("id") % 3).otherwise(F.col("id")).alias("k"), F.lit("x").alias("j"))
    hot = skew.hot_keys(df, ("k", "j"), 500)
    assert sorted(rows_of(hot, "k", "n_rows")) == [(0, 1000), (1, 1000), (2, 1000)]
    long, short = skew.split_hot(df, hot, ("k", "j"))
    assert (long.count(), short.count()) == (3000, 2000) and skew.hot_keys(df, ("k", "j"), 1000) is None
    assert skew.range_chunks(df, ("k",), 5000, 100).agg(F.max("_chunk")).first()[0] > 5


def test_epsilon_alone_divides_what_a_constant_column_differs(flows):
    scaler = sc.fit_scaler(flows({"packet_count": 5}, {"packet_count": 5}), ("packet_count",), keep_zero=True)
    got = sc.scale(flows({"packet_count": 6}), scaler, ("packet_count",), epsilon=1e-6).first()
    assert got["packet_count_norm"] == pytest.approx(1e6)


def test_extended_vectors_equal_the_vector_scaler(spark, sf_dir):
    from flowmill.catalog.fixture import traffic

    got = plan.extended_vectors(traffic(spark, sf_dir)).select("event_id", "features", "features_scaled").orderBy("event_id").collect()
    vectors = spark.createDataFrame([(r["event_id"], r["features"]) for r in got], ["event_id", "features"])
    want = sc.fit_vector_scaler(vectors).transform(vectors).orderBy("event_id").collect()
    for a, b in list(zip(got, want, strict=True))[:50]:
        assert a["features_scaled"].toArray() == pytest.approx(b["features_scaled"].toArray())


def test_folders_of_a_job_are_cleaned(spark, tmp_path):
    import os

    from flowmill.sources import session

    made = session.pinned(spark.range(3))
    path = session._made[spark.sparkContext.applicationId][-1]
    assert made.count() == 3 and os.path.isdir(path)
    others, session._made[spark.sparkContext.applicationId] = session._made[spark.sparkContext.applicationId][:-1], [path]
    assert session.clean(spark) == 1 and not os.path.isdir(path)
    session._made[spark.sparkContext.applicationId] = others
