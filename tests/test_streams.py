"""The id ledger, the outbox and session features on streams, with repeats and late rows."""

import pytest
from pyspark.sql import functions as F

from flowmill.functions import flow
from flowmill.operators import sessions as batch
from flowmill.streaming import events, ledger, outbox, sessions

ROW = "event_id string, partition int, offset long, n long"


def rows(spark, *ids):
    """A micro-batch: ids with their offsets."""
    return spark.createDataFrame([(i, 0, o, o) for i, o in ids], ROW)


def landed(spark, path):
    return sorted((str(r["event_id"]), r["n"]) for r in spark.read.schema(ROW).parquet(path).collect())


def test_ledger_over_batches_and_repeats(spark, tmp_path):
    out, ids = str(tmp_path / "out"), str(tmp_path / "ledger")
    first = rows(spark, ("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 5))
    second = rows(spark, ("b", 6), ("c", 7), ("c", 8))
    third = rows(spark, ("a", 9), ("d", 10), *[(f"e{i}", 20 + i) for i in range(30)])
    ledger.let_through(first, 0, out, ids, buckets=4)
    assert landed(spark, out) == [("None", 4), ("None", 5), ("a", 1), ("b", 3)]
    for _ in range(2):  # the second attempt replaces the first
        ledger.let_through(second, 1, out, ids, buckets=4)
    ledger.let_through(third, 2, out, ids, buckets=4, folders=1)  # puts two folders together first
    want = sorted([("None", 4), ("None", 5), ("a", 1), ("b", 3), ("c", 7), ("d", 10)] + [(f"e{i}", 20 + i) for i in range(30)])
    assert landed(spark, out) == want
    seen, single = ledger._folders(spark, ids, 3)
    assert [f.rsplit("/", 1)[1] for f in seen] == ["upto-1", "batch-2"] and single == 1
    for number, df in ((2, third), (3, second), (4, rows(spark)), (5, first.limit(0))):
        ledger.let_through(df, number, out, ids, buckets=4)
    assert landed(spark, out) == want


def test_ledger_without_looking_ids_up_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FEW_IDS", 2)
    out, ids = str(tmp_path / "out"), str(tmp_path / "ledger")
    for number, names in enumerate(("abcde", "defgh", "xaz")):
        ledger.let_through(rows(spark, *[(n, 10 * number + i) for i, n in enumerate(names)]), number, out, ids)
    assert [i for i, _ in landed(spark, out)] == list("abcdefghxz")


def test_a_restarted_stream_keeps_no_state(spark, tmp_path):
    path, out, ids, progress = (str(tmp_path / n) for n in ("topic", "out", "ledger", "progress"))
    for start in (0, 50):  # half of the second part was delivered before
        sent = spark.range(start, start + 100).select(
            F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.lit(0).alias("partition"),
            (F.col("id") + 1000 * start).alias("offset"), F.current_timestamp().alias("message_time"))
        sent.repartition(3).write.mode("append").parquet(path)
        stream = events.file_stream(spark, path, files_per_batch=1).withColumn("event_id", F.col("value"))
        query = ledger.write_distinct(stream, out, ids, progress, finish=True)
        query.awaitTermination()
        assert all(not p["stateOperators"] for p in query.recentProgress)
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == 150


def test_outbox_publishes_each_reply_once(spark, tmp_path):
    box, sent = str(tmp_path / "box"), str(tmp_path / "sent")
    for number in range(3):
        df = spark.range(20).select(F.lit(number).cast("long").alias("batch"), F.lit(0).alias("partition"), F.col("id").alias("offset"),
                                    F.lit("k").alias("key"), F.concat(F.lit(f"{number}-"), "id").alias("value"))
        df.write.parquet(f"{box}/batch-{number}")
    shape = "key string, value string, headers array<struct<key:string,value:binary>>"
    spark.createDataFrame([], shape).write.parquet(sent)
    asked = []

    def send(df):
        outbox.as_messages(df).write.mode("append").parquet(sent)

    def dies_in(number):
        def one(df):
            if df.filter(F.col("batch") == number).isEmpty():
                return send(df)
            send(df.filter("offset < 7"))
            raise InterruptedError
        return one

    def arrived(number):
        asked.append(number)
        return outbox.keys_of(spark.read.schema(shape).parquet(sent)).filter(F.col("batch") == number)

    for number in (0, 2):
        with pytest.raises(InterruptedError):
            outbox.publish(spark, box, dies_in(number), arrived)
    assert outbox.publish(spark, box, send, arrived) == 1 and outbox.publish(spark, box, send, arrived) == 0
    assert asked == [0, 2]  # only what was begun and not finished
    values = [r["value"] for r in spark.read.schema(shape).parquet(sent).collect()]
    assert sorted(values) == sorted(f"{n}-{i}" for n in range(3) for i in range(20))


def test_session_features_follow_the_stream(spark, flows, tmp_path):
    path = str(tmp_path / "flows")
    parts = [[0, 1, 2], [3, 4], [5, 2, 6, 7]]  # the event of second 2 comes again late
    for k, times in enumerate(parts):
        made = [{"event_id": 10 * k + i, "timestamp": 1000 + t, "packet_count": 3 + t, "src_port": 7} for i, t in enumerate(times)]
        made.append({"event_id": 900 + k, "timestamp": 5000 - k, "src_port": 8 + k})
        df = flows(*made).withColumns(flow.log_columns())
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    events.write_files(sessions.session_features(stream), out, str(tmp_path / "progress"), finish=True).awaitTermination()
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    late = got.pop(21)  # sorted first in its batch, behind the event of second 4
    assert late["late"] and late["prev_event_count_3"] == 3 and not any(r["late"] for r in got.values())
    in_order = spark.read.parquet(path).filter("event_id <> 21")
    want = batch.session_rolling(in_order).collect()
    assert len(want) == len(got) == 11
    for r in want:
        for c in (*batch.PREVIOUS_MEANS, *batch.PREVIOUS_COUNT):
            assert got[r["event_id"]][c] == (None if r[c] is None else pytest.approx(r[c])), (r["event_id"], c)


def test_session_features_keep_state_by_bucket(spark, flows, tmp_path):
    path = str(tmp_path / "flows")
    for k in range(2):  # 40 sessions of one event a file, the second file in order behind the first
        made = [{"event_id": 100 * k + p, "timestamp": 1000 + k, "packet_count": 3 + k, "src_port": 7 + p} for p in range(40)]
        df = flows(*made).withColumns(flow.log_columns())
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    run = events.write_files(sessions.session_features(stream, buckets=4), out, str(tmp_path / "progress"), finish=True)
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # a row per bucket, not per session
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [100 * k + p for k in range(2) for p in range(40)] and "_session" not in spark.read.parquet(out).columns
    for p in range(40):
        assert got[p]["prev_event_count_3"] == 0 and got[p]["prev_bytes_mean_3"] is None
        assert got[100 + p]["prev_event_count_3"] == 1 and not got[100 + p]["late"]
        assert got[100 + p]["prev_packet_mean_3"] == pytest.approx(got[p]["packet_log"])


def test_topic_files_stay_small_as_the_topic_grows(spark, sf_dir, monkeypatch):
    from flowmill.catalog import streams as catalog

    def result():
        return sorted(map(tuple, catalog.stream_quarantine(spark, sf_dir).collect()), key=str)

    whole = result()
    monkeypatch.setattr(catalog, "FILE_ROWS", 40)
    path, scale = catalog._topic(spark, sf_dir, broken=True)
    sizes = [r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert scale > 1 and len(sizes) == catalog.FILES * scale and max(sizes) <= 2 * 40  # no file holds a share of all messages
    assert result() == whole
