"""Storage, split job, models and streams."""

import json

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from __spark_entry__ import queries
from flowmill.catalog import models as catalog_models
from flowmill.catalog.base import fitted_base
from flowmill.catalog.fixture import event_messages, requests, split, traffic
from flowmill.functions import messages
from flowmill.operators import labelling, metrics
from flowmill.plans import features as plan
from flowmill.plans import score, train, training, tune
from flowmill.plans import splits as job
from flowmill.sources import models as stored
from flowmill.sources import parquet
from flowmill.sources import schemas as S
from flowmill.sources.session import new_dir, shared_dir
from flowmill.streaming import events, scoring

SMALL = {"rounds": 2, "max_depth": 3}


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert new_dir(spark, "a") != new_dir(spark, "a")


def test_split_names():
    with pytest.raises(ValueError, match="train"):
        parquet.split_path("/x", "dev")


def test_absent_column_reads_as_null(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("src_port")).write.parquet(str(tmp_path / "f"))
    out = parquet.scan(spark, str(tmp_path / "f"))
    assert out.schema == S.FLOW_SCHEMA
    assert out.filter("attack IS NULL AND src_port IS NOT NULL").count() == 3


def test_records_per_file(spark, tmp_path):
    path = str(tmp_path / "f")
    parquet.write(spark.range(0, 1050, 1, 1), path, 100)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count()
    assert files.count() == 11 and files.agg(F.max("count")).first()[0] == 100
    parquet.write(spark.range(5), path)  # replaces
    assert spark.read.parquet(path).count() == 5


def test_read_size(spark, tmp_path):
    path = str(tmp_path / "f")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(0, 400_000, 1, 1).write.parquet(path)
    try:
        parquet.set_read_size(spark, 1)
        small = spark.read.parquet(path).rdd.getNumPartitions()
        parquet.set_read_size(spark, 512)
        assert spark.read.parquet(path).rdd.getNumPartitions() <= small
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(512 * 1024 * 1024)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parquet.scan_partitions(spark, path, 5, None).rdd.getNumPartitions() == 5


def test_scan_reads_only_the_needed_columns(spark, sf_dir):
    plan_text = traffic(spark, sf_dir).filter("protocol = 'ICMP'").select("protocol")._jdf.queryExecution().toString()
    scan = [line for line in plan_text.splitlines() if "ReadSchema" in line][-1]
    assert "ReadSchema: struct<event_type:string>" in scan


def test_val_needs_train_parameters(spark, sf_dir, tmp_path):
    raw = str(tmp_path / "raw")
    for s in S.SPLITS:
        parquet.write(split(traffic(spark, sf_dir), s).select(*S.FLOW_SCHEMA.fieldNames()), parquet.split_path(raw, s))
    with pytest.raises(Exception, match="(?i)path"):
        job.prepare_split(spark, raw, str(tmp_path / "out"), str(tmp_path / "none"), "val")
    job.prepare_all(spark, raw, str(tmp_path / "out"), str(tmp_path / "params"))
    counts = dict(rows_of(job.read_splits(spark, str(tmp_path / "out")).groupBy("split").count(), "split", "count"))
    assert counts == {"train": 600, "val": 200, "test": 200}


def test_session_features_of_the_split_job(spark, sf_dir, tmp_path):
    schema = "event_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.FLOW_SCHEMA)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for s in S.SPLITS:
        df = split(traffic(spark, sf_dir), s).select("event_id", *S.FLOW_SCHEMA.fieldNames())
        parquet.write(df, parquet.split_path(raw, s))
    job.prepare_all(spark, raw, out, str(tmp_path / "params"), name="session", schema=schema, keep=("event_id",))
    got = job.read_splits(spark, out).filter("split = 'val'").drop("split")
    flows = traffic(spark, sf_dir)
    want = plan.apply_session(split(flows, "val"), plan.fit_session(split(flows, "train")), keep=("event_id",))
    assert got.columns == want.columns == ["event_id", *plan.feature_set("session").columns, "attack"]
    for a, b in zip(got.orderBy("event_id").collect(), want.orderBy("event_id").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))


# ---- models -------------------------------------------------------------------

@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return catalog_models.feature_rows(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def trees(rows):
    return train.fit("trees", rows.filter("split = 'train'"), **SMALL)


@pytest.fixture(scope="module")
def net(rows):
    return train.fit("net", rows.filter("split = 'train'"), hidden=(8,), max_epochs=3)


def test_unknown_framework(rows):
    with pytest.raises(ValueError, match="unknown framework"):
        train.fit("forest", rows)


def test_training_checks_its_columns(rows):
    with pytest.raises(ValueError, match="hour_norm"):
        train.fit("trees", rows.drop("hour_norm"))


def test_scores_are_probabilities(rows, trees, net):
    for framework, model in (("trees", trees), ("net", net)):
        out = score.score(rows, model, framework=framework)
        assert out.count() == rows.count()
        total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
        assert out.filter(F.abs(total - 1) > 1e-9).count() == 0
        best = F.array_position("probability", F.array_max("probability")) - 1
        assert out.filter(best != F.col("prediction")).count() == 0
        tags = out.select("variant", "framework", "model_key").distinct().collect()
        assert [tuple(t) for t in tags] == [("stable", framework, f"model_{framework}")]


def test_no_python_on_the_scoring_path(rows, trees):
    text = score.score(rows, trees)._jdf.queryExecution().toString()
    assert "Python" not in text


def test_trees_learn_the_concept_rule(spark, sf_dir):
    flows = traffic(spark, sf_dir.replace("sf0.001", "sf0.01"))
    data = plan.apply_base(labelling.with_label(flows, "concept"), plan.fit_base(flows), keep=("bucket",)).cache()
    model = train.fit("trees", data.filter("bucket < 6"))
    held_out = score.score(data.filter("bucket >= 6"), model)
    assert metrics.accuracy(held_out, "attack").first()["accuracy"] > 0.9


def test_model_survives_storage(rows, trees, tmp_path):
    stored.save_model(trees, str(tmp_path), "trees")
    again = stored.load_model(str(tmp_path), "trees")
    a = score.score(rows, trees).select("event_id", "probability")
    b = score.score(rows, again).select("event_id", "probability")
    assert sorted(a.collect()) == sorted(b.collect())


def test_foreign_models(rows, trees):
    columns = ("hour_sin_norm", "bytes_log_norm")
    many = score.score_foreign(rows, lambda x: np.tile([0.2, 0.7, 0.1], (len(x), 1)), columns)
    assert many.columns == score.score(rows, trees).columns
    assert many.select("prediction", "probability", "framework").distinct().collect() == [(1, [0.2, 0.7, 0.1], "foreign")]
    one = score.score_foreign(rows, lambda x: np.where(x[:, 1] > 0, 0.75, 0.25), columns)
    assert one.filter((F.col("bytes_log_norm") > 0) != (F.col("prediction") == 1)).count() == 0
    assert one.filter("probability[prediction] <> 0.75").count() == 0


def test_canary_rows_get_the_canary_model(rows, trees, net):
    out = score.score_routed(rows, score.Tagged(trees), score.Tagged(net, "net"), 0.3)
    assert out.count() == rows.count()
    tags = out.select("variant", "framework", "model_key").distinct().collect()
    assert sorted(map(tuple, tags)) == [("canary", "net", "model_net"), ("stable", "trees", "model_trees")]
    assert out.filter("variant = 'stable'").join(score.score(rows, trees).select("event_id", F.col("prediction").alias("p")), "event_id").filter(
        "prediction <> p").count() == 0
    alone = score.score(rows, net).select("event_id", F.col("prediction").alias("p"))
    canary = out.filter("variant = 'canary'").join(alone, "event_id")
    assert canary.filter("prediction <> p").count() == 0 and 200 < canary.count() < 400


def test_replies_to_requests(spark, sf_dir, rows, trees):
    fitted = fitted_base(spark, sf_dir)
    got = score.answer_requests(requests(spark, sf_dir), fitted, trees)
    assert got.columns == ["request_id", "n_predictions", "error", "reply"] and got.count() == 1000
    alone = {r["event_id"]: r for r in score.score(rows, trees).collect()}
    for r in got.filter("request_id < 80").collect():
        reply = json.loads(r["reply"])
        if r["request_id"] % 8 in (0, 6):
            want, n = alone[r["request_id"]], 2 if r["request_id"] % 8 == 0 else 1
            assert reply["predictions"] == [want["prediction"]] * n and len(reply["probabilities"]) == n == r["n_predictions"]
            assert reply["probabilities"][0] == pytest.approx(want["probability"])
            assert reply["model"] == {"variant": "stable", "framework": "trees", "model_key": "model_trees"}
        elif r["request_id"] % 8 != 7:
            assert set(reply) == {"error"}


def test_request_brings_its_time_features(spark, trees, sf_dir):
    record = {"src_port": 40000, "dst_port": 443, "protocol": "TCP", "packet_count": 10, "conn_state": "EST", "bytes_transferred": 900.0}
    brought = record | {"hour": 13, "dayofweek": 2, "is_weekend": 0, "hour_sin": -0.2588, "hour_cos": -0.9659}
    bodies = [(1, json.dumps({"data": brought})), (2, json.dumps({"data": record | {"timestamp": 1768240837}})), (3, json.dumps({"data": [brought, record]}))]
    df = spark.createDataFrame(bodies, "request_id long, body string").withColumn("at", F.current_timestamp())
    fitted = fitted_base(spark, sf_dir)
    rows = {(r["request_id"], r["pos"]): r for r in plan.apply_base(messages.request_rows(df), fitted, keep=("request_id", "pos"), fill=0.0).collect()}
    hour = fitted.scaler["hour"]
    assert rows[1, 0]["hour_norm"] == pytest.approx((13 - hour["mean"]) / hour["std"])
    assert rows[2, 0]["hour_norm"] == pytest.approx((18 - hour["mean"]) / hour["std"]) and rows[3, 1]["hour_norm"] == 0.0
    got = {r["request_id"]: json.loads(r["reply"]) for r in score.answer_requests(df, fitted, trees, received="at").collect()}
    assert len(got[3]["predictions"]) == 2 and got[1]["latency_ms"] >= 0


def test_evaluation_tables(rows, trees, tmp_path, spark):
    tables = score.evaluate(score.score(rows, trees))
    assert tables["confusion"].count() == 3 * 36
    assert sorted(rows_of(tables["summary"], "split", "support")) == [("test", 200), ("train", 600), ("val", 200)]
    direct = metrics.log_loss(score.score(rows, trees), "attack", by=("split",))
    for a, b in zip(tables["loss"].orderBy("split").collect(), direct.orderBy("split").collect(), strict=True):
        assert a["n_rows"] == b["n_rows"]
        assert a["mlogloss"] == pytest.approx(b["mlogloss"]) and a["merror"] == pytest.approx(b["merror"])
    one = metrics.confusion(score.score(rows.filter("split = 'val'"), trees), "attack")
    paths = stored.save_evaluation(str(tmp_path), "r1", {"confusion_matrix": one, "test_confusion_matrix": one})
    assert [p.split("run_id=")[1] for p in paths] == ["r1/split=val", "r1/split=test"]
    assert stored.save_evaluation(str(tmp_path), "r2", {"val_confusion_matrix": None}) == []
    back = spark.read.parquet(str(tmp_path / "confusion_matrix"))
    assert back.filter("run_id = 'r1' AND split = 'val'").count() == 36


def test_training_job(spark, rows, tmp_path):
    processed, output, log = (str(tmp_path / n) for n in ("processed", "models", "runs"))
    for s in S.SPLITS:
        parquet.write(rows.filter(F.col("split") == s).select(*S.FEATURES, S.TARGET), parquet.split_path(processed, s))
    model, numbers = training.run(
        spark, processed, output, "net", "r1", search=True, fraction=0.5, trials=2, runs_path=log, hidden=(6,),
    )
    assert set(numbers) >= {"val_accuracy", "test_f1_avg", "val_mlogloss", "test_recall_class_5", "val_support_class_0"}
    assert sum(numbers[f"val_support_class_{k}"] for k in range(6)) == 200
    again = score.score(rows, stored.load_model(output, "net"), framework="net").filter("split = 'test'")
    assert metrics.accuracy(again, "attack").first()["accuracy"] == pytest.approx(numbers["test_accuracy"])
    logged = {r["name"]: (r["kind"], r["text"], r["number"]) for r in spark.read.parquet(log).collect()}
    assert logged["val_accuracy"] == ("metric", None, numbers["val_accuracy"])
    assert logged["pt_hidden"] == ("param", "(6,)", None) and "pt_lr" in logged and logged["num_classes"][1] == "6"
    assert spark.read.parquet(f"{output}/classification_report").filter("split = 'test'").count() == 9
    parquet.write(rows.drop("hour_norm"), parquet.split_path(processed, "test"))
    with pytest.raises(ValueError, match="hour_norm"):
        training.run(spark, processed, output, "net")


def test_split_job_uses_one_time_unit(spark, sf_dir, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for s in S.SPLITS:
        df = split(traffic(spark, sf_dir), s).withColumn("timestamp", F.col("timestamp") * 1000)
        parquet.write(df.select(*S.FLOW_SCHEMA.fieldNames()), parquet.split_path(raw, s))
    job.prepare_all(spark, raw, out, str(tmp_path / "params"), shared={"unit": "ms"})
    flows = traffic(spark, sf_dir)
    want = plan.apply_base(split(flows, "val"), plan.fit_base(split(flows, "train")))
    got = job.read_splits(spark, out).filter("split = 'val'").drop("split")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_search_draws(rows):
    assert tune.draw_trials("trees", seed=1) == tune.draw_trials("trees", seed=1)
    drawn = tune.draw_trials("trees", 200)
    assert {t["max_depth"] for t in drawn} == set(range(3, 11)) and all(1e-4 <= t["eta"] <= 0.3 for t in drawn)
    assert len(tune.draw_trials("net")) == 5


def test_search_finds_the_smallest_loss(rows):
    trials = tune.random_search(
        rows.filter("split = 'train'"), rows.filter("split = 'val'"), "net", trials=2, fraction=0.5, hidden=(4,)
    )
    table = trials.collect()
    assert table[0]["number"] != table[1]["number"]
    assert [r["run_id"] for r in table] == ["net-000", "net-001"]
    assert tune.best_params(trials)["lr"] in [d["lr"] for d in tune.draw_trials("net", 2)]


# ---- streams --------------------------------------------------------------------

def topic(spark, sf_dir, path, broken=False):
    event_messages(spark, sf_dir, broken).repartition(4).write.parquet(path)
    return events.file_stream(spark, path, files_per_batch=1)


def test_stream_scores_equal_batch_scores(spark, sf_dir, trees, tmp_path):
    fitted = fitted_base(spark, sf_dir)
    stream = topic(spark, sf_dir, str(tmp_path / "topic"))
    scored = scoring.scores(stream, fitted, trees)
    query = events.write_files(scored, str(tmp_path / "out"), str(tmp_path / "progress"), finish=True)
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = score.score(plan.apply_base(traffic(spark, sf_dir), fitted, keep=("event_id",)), trees)
    want = batch.select(F.col("event_id").cast("string"), "prediction", "probability")
    assert sorted(got.select("event_id", "prediction", "probability").collect()) == sorted(want.collect())
    assert got.filter("key <> event_id").count() == 0


def test_restart_goes_on_where_it_stopped(spark, sf_dir, tmp_path):
    path, out, progress = (str(tmp_path / n) for n in ("topic", "out", "progress"))
    for _ in range(2):
        stream = topic(spark, sf_dir, f"{path}", False) if _ == 0 else events.file_stream(spark, path)
        flows = messages.usable(events.decoded(stream)).select("event_id")
        events.write_files(flows, out, progress, finish=True).awaitTermination()
    assert spark.read.parquet(out).count() == 1000


def test_batches_replace_their_own_output(spark, sf_dir, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for attempt in ("a", "b"):  # the second run has lost its progress and repeats all batches
        stream = topic(spark, sf_dir, str(tmp_path / f"topic-{attempt}"), broken=True)
        events.write_split(events.decoded(stream), good, bad, str(tmp_path / attempt), finish=True).awaitTermination()
        assert spark.read.parquet(good).count() == 600 and spark.read.parquet(bad).count() == 400


def test_copies_of_one_event_are_dropped_across_batches(spark, flows, tmp_path):
    text = messages.encode_event(F.lit("same"))
    copies = flows({}).select(text.alias("value")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(399)).cast("array<bigint>")))
    path = str(tmp_path / "topic")
    copies.select(F.lit("k").alias("key"), "value", F.lit(0).alias("partition"), "offset", F.current_timestamp().alias("message_time")
                  ).repartition(4).write.parquet(path)
    events.keep_state_on_disk(spark)
    decoded = messages.usable(events.decoded(events.file_stream(spark, path, files_per_batch=1)))
    query = events.write_files(events.deduplicated(decoded), str(tmp_path / "out"), str(tmp_path / "progress"), finish=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_late_events_are_kept(spark, flows, tmp_path):
    """One file per trigger, hours apart and backwards: every distinct event comes through."""
    path = str(tmp_path / "topic")
    for i in range(4):
        rows = [{"event_id": 250 * i + j, "timestamp": 1_700_000_000 - 40_000 * i - j} for j in range(250)]
        text = messages.encode_event(F.col("event_id"))
        df = flows(*rows).select(F.col("event_id").cast("string").alias("key"), text.alias("value"), F.lit(0).alias("partition"),
                                 F.col("event_id").alias("offset"), F.current_timestamp().alias("message_time"))
        df.unionByName(df.limit(20)).coalesce(1).write.mode("append").parquet(path)
    events.keep_state_on_disk(spark)
    decoded = messages.usable(events.decoded(events.file_stream(spark, path, files_per_batch=1)))
    out = str(tmp_path / "out")
    events.write_files(events.deduplicated(decoded), out, str(tmp_path / "progress"), finish=True).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(out).select("event_id").distinct().count() == 1000
    recent, timed = events.recent_distinct(decoded, "1 hour")
    few = str(tmp_path / "few")
    events.write_files(recent, few, str(tmp_path / "progress2"), finish=True).awaitTermination()
    everything = messages.usable(events.decoded(spark.read.schema(S.MESSAGE_SCHEMA).parquet(path)))
    landed = spark.read.parquet(few)
    assert landed.count() + events.late_rows(everything.dropDuplicates(["event_id"]), landed).count() == 1000 > landed.count()


def test_empty_messages_are_skipped(spark):
    df = spark.createDataFrame([("k", None), ("k", " "), ("k", "x")], "key string, value string")
    assert events.present(df).count() == 1


def test_every_query_is_named_once():
    assert len(queries()) >= 80
