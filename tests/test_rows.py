"""Sampling, validation, messages, labels and metrics on small tables."""

import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from flowmill.functions import messages, scalar, scores
from flowmill.operators import labelling, metrics, sampling
from flowmill.operators import validate as val
from flowmill.sources import kafka, runs
from flowmill.sources import schemas as S


# ---- sampling -----------------------------------------------------------------

def classes(spark, sizes):
    rows = [(k * 100_000 + i, k) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k long")


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_small_classes_keep_five_rows(spark, hot_rows):
    out = sampling.stratified_sample(classes(spark, [3, 5, 100]), "k", 0.2, "id", hot_rows=hot_rows)
    assert sorted(rows_of(out.groupBy("k").count(), "k", "count")) == [(0, 3), (1, 5), (2, 20)]


def test_hot_classes_give_the_same_sample(spark):
    df = classes(spark, [5000, 37, 900])
    plain = sampling.stratified_sample(df, "k", 0.3, "id")
    hot = sampling.stratified_sample(df.repartition(7), "k", 0.3, "id", hot_rows=100)
    assert sorted(rows_of(plain, "id", "k")) == sorted(rows_of(hot, "id", "k"))


def test_hash_buckets_with_many_rows_each(spark, monkeypatch):
    """Many rows per bucket: the edge bucket is ranked."""
    df = classes(spark, [3000])
    monkeypatch.setattr(scalar, "hash_key", lambda key, seed: F.concat(F.lit("ab00"), F.md5(F.col(key).cast("string"))))
    got = {r["id"] for r in sampling.cap_rows(df, 100, "id").collect()}
    want = {r["id"] for r in df.orderBy(F.md5(F.col("id").cast("string"))).limit(100).collect()}
    assert got == want


@pytest.mark.parametrize("fraction", [None, 0, -1, 1, 1.5])
def test_fractions_that_mean_all_rows(spark, fraction):
    assert sampling.sample_fraction(spark.range(50), fraction, "id").count() == 50


def test_samples_do_not_depend_on_partitioning(spark):
    a = sampling.sample_fraction(spark.range(0, 5000, 1, 3), 0.2, "id").collect()
    b = sampling.sample_fraction(spark.range(0, 5000, 1, 17), 0.2, "id").collect()
    assert sorted(a) == sorted(b) and 850 < len(a) < 1150


def test_cap(spark):
    df = spark.range(500)
    assert sampling.cap_rows(df, 0, "id").count() == 500
    assert sampling.cap_rows(df, 900, "id").count() == 500
    with pytest.raises(ValueError, match="unique key"):
        sampling.cap_rows(df, 40)
    capped = {r["id"] for r in sampling.cap_rows(df.repartition(5), 40, "id").collect()}
    assert capped == {r["id"] for r in df.orderBy(scalar.hash_key("id", 42)).limit(40).collect()}


@pytest.mark.parametrize("share,names", [(-1, {"stable"}), (0, {"stable"}), (1, {"canary"}), (2, {"canary"})])
def test_share_is_held_inside_0_and_1(spark, share, names):
    out = sampling.assign_variant(spark.range(100), share, "id")
    assert {r["variant"] for r in out.collect()} == names


def test_weights(spark):
    for bad in [(), (-1.0, 2.0), (0.0, 0.0), (float("inf"),)]:
        with pytest.raises(ValueError):
            scalar.weighted_choice(F.lit(0.5), bad)
    out = sampling.assign_weighted(spark.range(2000), "k", (0.0, 3.0, 1.0, 0.0), "id").groupBy("k").count()
    got = dict(rows_of(out, "k", "count"))
    assert set(got) == {1, 2} and 1400 < got[1] < 1600


def test_normal_draws(spark):
    z = spark.range(20_000).select(scalar.normal("id", 1).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


# ---- validation ---------------------------------------------------------------

def test_missing_columns_are_named(flows):
    with pytest.raises(ValueError, match=r"\['bytes_log_norm'.*'src_port_norm'\]"):
        val.require_model_input(flows({}))
    assert val.require_columns(flows({}), ("attack",)).columns


def test_row_rules(flows):
    df = flows({}, {"src_port": 80, "protocol": "GRE"}, {"conn_state": None, "bytes_transferred": 3e6})
    got = sorted(rows_of(val.check_rows(df), "event_id", "violations", "valid"))
    assert got == [(0, [], True), (1, ["src_port", "protocol"], False), (2, ["conn_state", "bytes_transferred"], False)]
    good, bad = val.split_valid(val.check_rows(df))
    assert (good.count(), bad.count()) == (1, 2)


def test_first_matching_rule_wins(flows):
    df = flows({"packet_count": 1}, {"packet_count": 5}, {"packet_count": 9})
    rules = [
        (F.col("packet_count") > 8, {"dst_port": F.lit(1).cast("long")}),
        (F.col("packet_count") > 3, {"dst_port": F.lit(2).cast("long"), "packet_count": F.lit(0).cast("long")}),
    ]
    got = sorted(rows_of(val.update_first_match(df, rules), "event_id", "dst_port", "packet_count"))
    assert got == [(0, 443, 1), (1, 2, 0), (2, 1, 9)]


def test_attack_rules_stay_in_their_ranges(spark, flows):
    df = flows(*[{"event_id": i, "attack": i % 6} for i in range(600)])
    out = labelling.apply_attack_rules(df)
    bad = out.filter(
        "(attack = 0 AND packet_count <> 10)"
        " OR (attack = 1 AND NOT (packet_count BETWEEN 1200 AND 1999 AND protocol IN ('ICMP', 'UDP')))"
        " OR (attack = 2 AND NOT (dst_port IN (21, 22, 23, 80, 443) AND packet_count BETWEEN 200 AND 799))"
        " OR (attack = 3 AND NOT (conn_state = 'RST' AND bytes_transferred BETWEEN 0 AND 200))"
        " OR (attack = 4 AND NOT (conn_state = 'EST' AND bytes_transferred BETWEEN 8e5 AND 1.3e6))"
        " OR (attack = 5 AND NOT (bytes_transferred BETWEEN 1.5e6 AND 2e6 AND packet_count BETWEEN 600 AND 1399))"
    )
    assert bad.count() == 0
    assert out.filter("attack = 2").select("dst_port").distinct().count() == 5


def test_clip(flows):
    df = labelling.clip_ranges(flows({"packet_count": 0, "bytes_transferred": -1.0}, {"packet_count": 9999, "bytes_transferred": 9e9},
                                     {"packet_count": None, "bytes_transferred": None}))
    assert rows_of(df.orderBy("event_id"), "packet_count", "bytes_transferred") == [(1, 0.0), (2000, 2e6), (None, None)]


# ---- labels -------------------------------------------------------------------

def test_first_of_equal_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 0.0],), ([1.0, 2.0, 5.0],)], "s array<double>")
    by_column = [F.col("s")[k] for k in range(3)]
    got = df.select(scalar.argmax(F.col("s")).alias("a"), scalar.argmax_of(by_column).alias("b"))
    assert rows_of(got, "a", "b") == [(1, 1), (0, 0), (2, 2)]


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([-2000.0, 0.0],)], "s array<double>")
    assert [r["p"] for r in scalar.with_softmax(df, "s", "p").collect()] == [[0.5, 0.5], [0.0, 1.0]]


def test_category_spread(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string")
    assert [r[0] for r in df.select(scalar.spread_category("v", ("a", "b", "c"))).collect()] == [-1.0, 0.0, 1.0, None]
    assert df.select(scalar.spread_category("v", ("a",))).first()[0] == 0.0


def test_rules_on_clear_rows(flows):
    df = flows({"bytes_transferred": 1.9e6, "src_port": 1999, "packet_count": 100, "dst_port": 9000},
               {"protocol": "ICMP", "src_port": 1999, "dst_port": 9000, "bytes_transferred": 2e5, "packet_count": 20},
               {"src_port": 3010, "dst_port": 80})
    got = rows_of(df.select("event_id", scores.label("concept").alias("k")).orderBy("event_id"), "k")
    assert got == [(1,), (3,), (2,)]


def test_class_names(flows):
    out = labelling.with_class_name(flows({"attack": 5}, {"attack": 0}, {"attack": 9})).orderBy("event_id")
    assert [r["class_name"] for r in out.collect()] == ["Worm", "Normal", None]
    assert [r["class_id"] for r in labelling.with_class_id(out).orderBy("event_id").collect()] == [5, 0, None]


# ---- messages -------------------------------------------------------------------

def test_requests(spark):
    row = {"src_port": 1, "dst_port": 2, "protocol": "TCP", "packet_count": 3, "conn_state": "EST",
           "bytes_transferred": 4, "timestamp": 5}
    bodies = [json.dumps({"data": row}), json.dumps({"data": [row, {"src_port": 9}]}), "[]", '{"x":1}', '{"data":5}',
              '{"data":"{}"}', '{"data":[]}', '{"data":[5]}', '{"data":null}', "nope", "", "3", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = messages.request_rows(df).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["error"]) for r in got] == [
        (0, 0, None), (1, 0, None), (1, 1, None), (2, 0, "not_an_object"), (3, 0, "missing_data"), (4, 0, "wrong_kind"),
        (5, 0, "wrong_kind"), (6, 0, "no_rows"), (7, 0, "wrong_kind"), (8, 0, "missing_data"),
        (9, 0, "not_an_object"), (10, 0, "not_an_object"), (11, 0, "not_an_object"), (12, 0, "not_an_object"),
    ]
    assert got[0]["hour"] is None
    assert (got[0]["src_port"], got[0]["bytes_transferred"], got[2]["src_port"], got[2]["protocol"]) == (1, 4.0, 9, None)


def test_events_round_trip(flows):
    df = flows({"attack": 3}, {"protocol": "UDP", "bytes_transferred": 0.25})
    texts = df.select(F.col("event_id").alias("id"), messages.encode_event(F.col("event_id")).alias("value"))
    first = json.loads(texts.filter("id = 0").first()["value"])
    assert first == {"timestamp": "2023-11-14T22:13:20", "event_id": "0", "label": 3, "properties": {
        "src_port": 2000, "dst_port": 443, "protocol": "TCP", "packet_count": 10, "conn_state": "EST", "bytes_transferred": 100.0}}
    back = messages.usable(messages.decode_events(texts)).select(*S.FLOW_SCHEMA.fieldNames())
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*S.FLOW_SCHEMA.fieldNames()).collect()))


def test_fractions_of_seconds_are_cut(spark, flows):
    text = flows({}).select(messages.encode_event(F.lit("a")).alias("value")).first()["value"]
    text = text.replace("22:13:20", "22:13:20.987654")
    out = messages.usable(messages.decode_events(spark.createDataFrame([(text,)], "value string")))
    assert out.first()["timestamp"] == 1_700_000_000


def test_broken_events(spark, flows):
    good = flows({}).select(messages.encode_event(F.lit("a")).alias("value")).first()["value"]
    texts = [good, "not json", "{}", '{"data": 5}', "[1]", good.replace("10,", '"ten",'), good.replace("2023-11-14", "soon")]
    df = messages.decode_events(spark.createDataFrame(list(enumerate(texts)), "id long, value string"))
    assert [r["problem"] for r in df.orderBy("id").collect()] == [
        None, "unparsable", "missing_field", "missing_field", "unparsable", "missing_field", "missing_field"]
    assert messages.usable(df).count() == 1
    assert messages.quarantined(df).columns == ["value", "problem"] and messages.quarantined(df).count() == 6


def test_event_ids_are_unique(spark):
    assert spark.range(100).select(messages.new_event_id().alias("u")).distinct().count() == 100


def test_kafka_settings(spark):
    options = kafka.source_options("host:1", min_partitions=12, security_protocol="SASL_SSL")
    assert options["startingOffsets"] == "earliest" and options["kafka.isolation.level"] == "read_committed"
    assert options["minPartitions"] == "12" and options["kafka.security.protocol"] == "SASL_SSL"
    out = kafka.as_messages(spark.createDataFrame([(1, "x")], "id long, v string"), key="id").first()
    assert (out["key"], out["value"]) == ("1", '{"v":"x"}')
    assert kafka.as_messages(spark.range(1)).first()["key"] is None


# ---- metrics ----------------------------------------------------------------------

def pairs(spark, rows):
    return spark.createDataFrame(rows, "label long, prediction long")


def test_absent_class_counts_as_zero(spark):
    df = pairs(spark, [(0, 0)] * 3 + [(1, 0)])
    matrix = metrics.confusion(df, classes=3)
    assert sorted(rows_of(matrix, "label", "prediction", "n")) == sorted(
        [(i, j, {(0, 0): 3, (1, 0): 1}.get((i, j), 0)) for i in range(3) for j in range(3)])
    s = metrics.summary(metrics.class_metrics(matrix)).first()
    assert s["precision_macro"] == pytest.approx(0.25) and s["f1_macro"] == pytest.approx(0.2857142857)
    assert s["accuracy"] == 0.75 and s["f1_avg"] == s["f1_macro"]


def test_pairs_outside_the_classes_are_left_out(spark):
    df = pairs(spark, [(0, 0), (6, 0), (0, -1), (None, 1), (1, None), (5, 5)])
    assert metrics.confusion(df).agg(F.sum("n")).first()[0] == 2
    empty = metrics.confusion(pairs(spark, [(9, 9)]))
    assert (empty.count(), empty.agg(F.sum("n")).first()[0]) == (36, 0)
    s = metrics.summary(metrics.class_metrics(empty)).first()
    assert s["accuracy"] == 0.0 and s["f1_weighted"] == 0.0


def test_report_lines(spark):
    report = metrics.report(metrics.class_metrics(metrics.confusion(pairs(spark, [(0, 0), (1, 0), (1, 1)]), classes=2)))
    got = {r["name"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    assert got == {"0": (0.5, 1.0, 0.6667, 1), "1": (1.0, 0.5, 0.6667, 2), "accuracy": (None, None, 0.6667, 3),
                   "macro avg": (0.75, 0.75, 0.6667, 3), "weighted avg": (0.8333, 0.6667, 0.6667, 3)}


def test_log_loss_leaves_out_other_labels(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (7, [0.5, 0.5]), (-1, [0.5, 0.5]), (None, [0.5, 0.5])], "label long, probability array<double>")
    got = metrics.log_loss(df).first()
    assert got["mlogloss"] == pytest.approx(0.6931471805599453) and (got["n_rows"], got["n_excluded"], got["merror"]) == (1, 3, 0.0)


def test_log_loss_of_impossible_class(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "label long, probability array<double>")
    out = metrics.log_loss(df).first()
    assert out["mlogloss"] == pytest.approx(34.538776 / 2, abs=1e-5) and out["merror"] == 0.5


def test_run_rows(spark, tmp_path):
    rows = runs.metric_rows(spark, "r", {"a": 1, "b": 2.5, "flag": True, "text": "x", "matrix": [[1]]})
    assert sorted(rows_of(rows, "name", "number")) == [("a", 1.0), ("b", 2.5)]
    params = runs.param_rows(spark, "r", "net", {"target": "attack"}, {"lr": 0.1})
    assert sorted(rows_of(params, "name", "text")) == [("framework", "net"), ("pt_lr", "0.1"), ("target", "attack")]
    assert not runs.append(rows, None)
    assert runs.append(rows, str(tmp_path / "runs")) and runs.append(params, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 5


def test_best_run_ties(spark):
    df = spark.createDataFrame([("b", "loss", 1.0), ("a", "loss", 1.0), ("c", "loss", None), ("d", "other", 0.0)],
                               "run_id string, name string, number double")
    assert runs.best_run(df, "loss").first()["run_id"] == "a"
    assert runs.best_run(df, "loss", "max").first()["number"] == 1.0
    assert runs.best_run(df, "none").count() == 0
