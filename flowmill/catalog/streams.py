"""Streaming queries. Messages derived from ``events`` are written as files, read back as a
stream that ends at the last file, and the sink's table is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.catalog import models
from flowmill.catalog.base import BASE, FINAL, FINAL_COLUMNS, ROLLING, fitted_base
from flowmill.catalog.fixture import TRAFFIC, event_messages
from flowmill.catalog.registry import query, r, rounded
from flowmill.catalog.rows import FLOW_SQL
from flowmill.functions import messages
from flowmill.functions.flow import log_columns
from flowmill.operators.sessions import PREVIOUS_COUNT, PREVIOUS_MEANS
from flowmill.plans.features import apply_base
from flowmill.sources import kafka
from flowmill.sources.session import new_dir, pinned
from flowmill.streaming import events, ledger, outbox, scoring
from flowmill.streaming import sessions as stream_sessions

FILES = 4
FILE_ROWS = 500_000  # messages of a topic file at most: no task writes or reads a share of the topic that grows with it


def _topic(spark, sf_dir, broken: bool = False, copies: bool = False) -> tuple[str, int]:
    """The messages as ``FILES`` times ``scale`` files, and that ``scale``."""
    path = new_dir(spark, "topic")
    out = event_messages(spark, sf_dir, broken)
    if copies:  # every fifth event is delivered again at another offset
        again = out.filter(F.col("key").cast("long") % 5 == 0).withColumn("offset", F.col("offset") + 1)
        out = out.unionByName(again)
    scale = max(1, -(-out.count() // (FILES * FILE_ROWS)))
    # by hash of the message: each file spans the whole time, in no order
    out.repartition(FILES * scale, F.xxhash64("key", "offset")).write.parquet(path)
    return path, scale


def _stream(spark, topic: tuple[str, int], files: int = 2):
    """The topic in ``FILES / files`` micro-batches, however many files it has."""
    path, scale = topic
    return events.file_stream(spark, path, files_per_batch=files * scale)


MESSAGE_COLUMNS = ("key", "value", "partition", "offset", "message_time")


def _finish(df, spark):
    """Run the stream to the end of its input and read the sink."""
    path = new_dir(spark, "sink")
    events.write_files(df, path, new_dir(spark, "progress"), finish=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_source", """SELECT CAST(event_id AS VARCHAR) AS key, CAST(event_id % 6 AS INTEGER) AS "partition",
  CAST(floor(event_id / 6) AS BIGINT) AS "offset", CAST(floor(epoch(ts)) AS BIGINT) AS message_epoch FROM events""")
def stream_source(spark, sf_dir):
    stream = events.present(_stream(spark, _topic(spark, sf_dir)))
    return _finish(stream.select("key", "partition", "offset", F.unix_timestamp("message_time").alias("message_epoch")), spark)


@query("kafka_records", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS event_id, {FLOW_SQL}, attack FROM traffic".replace(", attack, attack", ", attack"))
def kafka_records(spark, sf_dir):
    """Records in the connector's own shape (bytes, a ``timestamp`` column), decoded."""
    sent = event_messages(spark, sf_dir)
    records = sent.select(F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), F.lit("t").alias("topic"),
                          "partition", "offset", F.col("message_time").alias("timestamp"), F.lit(0).alias("timestampType"))
    return messages.usable(events.decoded(kafka.as_rows(records))).drop(*MESSAGE_COLUMNS)


@query("empty_polls", "SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_id % 7 > 1")
def empty_polls(spark, sf_dir):
    path = new_dir(spark, "topic")
    kind = F.col("key").cast("long") % 7
    blank = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("  ")).otherwise(F.col("value"))
    event_messages(spark, sf_dir).withColumn("value", blank).write.parquet(path)
    return _finish(events.present(_stream(spark, (path, 1))).select("key"), spark)


@query("stream_land", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS event_id, {FLOW_SQL}, attack FROM traffic")
def stream_land(spark, sf_dir):
    flows = messages.usable(events.decoded(_stream(spark, _topic(spark, sf_dir))))
    return _finish(flows.drop(*MESSAGE_COLUMNS), spark)


@query("stream_dedup", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS event_id, {FLOW_SQL}, attack FROM traffic")
def stream_dedup(spark, sf_dir):
    flows = messages.usable(events.decoded(_stream(spark, _topic(spark, sf_dir, copies=True), files=1)))
    out, ids = new_dir(spark, "distinct"), new_dir(spark, "ledger")
    ledger.write_distinct(flows, out, ids, new_dir(spark, "progress"), finish=True, folders=2).awaitTermination()
    return spark.read.parquet(out).drop(*MESSAGE_COLUMNS, "batch_id")


@query("stream_dedup_state", f"WITH {TRAFFIC} SELECT CAST(event_id AS VARCHAR) AS event_id, {FLOW_SQL}, attack FROM traffic")
def stream_dedup_state(spark, sf_dir):
    """The same with the ids in the streaming state."""
    events.keep_state_on_disk(spark)
    flows = messages.usable(events.decoded(_stream(spark, _topic(spark, sf_dir, copies=True), files=1)))
    return _finish(events.deduplicated(flows).drop(*MESSAGE_COLUMNS), spark)


@query("stream_quarantine", """SELECT CASE WHEN event_id % 10 > 3 THEN 'good' ELSE 'bad' END AS sink,
  CASE WHEN event_id % 10 > 3 THEN CAST(event_id AS VARCHAR) END AS event_id,
  CASE WHEN event_id % 10 IN (0, 3) THEN 'unparsable' WHEN event_id % 10 IN (1, 2) THEN 'missing_field' END AS problem
FROM events""")
def stream_quarantine(spark, sf_dir):
    decoded = events.decoded(_stream(spark, _topic(spark, sf_dir, broken=True)))
    good, bad = new_dir(spark, "good"), new_dir(spark, "bad")
    events.write_split(decoded, good, bad, new_dir(spark, "progress"), finish=True).awaitTermination()
    kept = spark.read.parquet(good).select(F.lit("good").alias("sink"), "event_id", F.lit(None).cast("string").alias("problem"))
    rejected = spark.read.parquet(bad).select(F.lit("bad").alias("sink"), F.lit(None).cast("string").alias("event_id"), "problem")
    return kept.unionByName(rejected)


@query("stream_features", f"WITH {FINAL} SELECT {FINAL_COLUMNS.replace('event_id', 'CAST(event_id AS VARCHAR) AS event_id', 1)} FROM final")
def stream_features(spark, sf_dir):
    flows = messages.usable(events.decoded(_stream(spark, _topic(spark, sf_dir))))
    features = apply_base(flows, fitted_base(spark, sf_dir), keep=("event_id",), fill=0.0)
    return rounded(_finish(features, spark))


@query("stream_score", """SELECT CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 10 > 3 THEN 'scored'
  WHEN event_id % 10 IN (0, 3) THEN 'unparsable' ELSE 'missing_field' END AS outcome,
  CASE WHEN event_id % 10 > 3 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_predictions,
  CASE WHEN event_id % 10 > 3 THEN 'model_trees' END AS model_key FROM events""")
def stream_score(spark, sf_dir):
    """Scores and rejected messages; together they are all messages."""
    fitted, model = fitted_base(spark, sf_dir), models.model(spark, sf_dir)
    decoded = events.decoded(_stream(spark, _topic(spark, sf_dir, broken=True)))
    good, bad = new_dir(spark, "good"), new_dir(spark, "bad")
    events.write_split(decoded, good, bad, new_dir(spark, "progress"), finish=True, carried=("key",),
                       prepare=lambda flows: scoring.score_messages(scoring.score_flows(flows, fitted, model))).awaitTermination()
    reply = F.from_json("value", "predictions array<long>, model struct<model_key string>")
    scored = spark.read.parquet(good).withColumn("reply", reply).select(
        "key", F.lit("scored").alias("outcome"), F.size("reply.predictions").cast("long").alias("n_predictions"), "reply.model.model_key")
    rejected = spark.read.parquet(bad).select("key", F.col("problem").alias("outcome"), F.lit(0).cast("long").alias("n_predictions"),
                                              F.lit(None).cast("string").alias("model_key"))
    return scored.unionByName(rejected)


@query("stream_session_features", f"""WITH {TRAFFIC}, {BASE}, {ROLLING}
SELECT event_id, {r('prev_bytes_mean_3')}, {r('prev_packet_mean_3')}, prev_event_count_3, FALSE AS late FROM rolling""")
def stream_session_features(spark, sf_dir):
    """Events in order, a file after another: the windows of the batch job from a session's last three events."""
    path = new_dir(spark, "topic")
    # ranges of time, then event id, one after another: files in order without sorting all events in one task
    ordered = event_messages(spark, sf_dir).repartitionByRange(FILES, "message_time", F.col("key").cast("long"))
    sent = pinned(ordered.withColumn("nth", F.spark_partition_id() + 1), "ordered")
    for i in range(1, FILES + 1):
        sent.filter(F.col("nth") == i).drop("nth").coalesce(1).write.mode("append").parquet(path)
    flows = messages.usable(events.decoded(_stream(spark, (path, 1), files=1))).withColumn("event_id", F.col("event_id").cast("long"))
    found = stream_sessions.session_features(flows.withColumns(log_columns()))
    return rounded(_finish(found.select("event_id", *PREVIOUS_MEANS, *PREVIOUS_COUNT, "late"), spark))


@query("stream_outbox", """SELECT CAST(event_id AS VARCHAR) AS key, CAST(event_id % 6 AS INTEGER) AS "partition",
  CAST(floor(event_id / 6) AS BIGINT) AS "offset", CAST(1 AS BIGINT) AS n_copies, CAST(1 AS BIGINT) AS n_predictions FROM events""")
def stream_outbox(spark, sf_dir):
    """Scored messages through the outbox to a topic kept as files; the publisher dies in the middle of the first batch."""
    fitted, model = fitted_base(spark, sf_dir), models.model(spark, sf_dir)
    flows = messages.usable(events.decoded(_stream(spark, _topic(spark, sf_dir))))
    messages_ = scoring.replies(scoring.score_flows(flows, fitted, model), scoring.CARRIED).withColumnRenamed("reply", "value")
    box, sent = new_dir(spark, "outbox"), new_dir(spark, "sent")
    outbox.write_outbox(messages_, box, new_dir(spark, "progress"), finish=True).awaitTermination()
    shape = "key string, value string, headers array<struct<key:string,value:binary>>"
    spark.createDataFrame([], shape).write.parquet(sent)

    def send(rows):
        outbox.as_messages(rows).write.mode("append").parquet(sent)

    def die(rows):
        send(rows.filter("offset % 3 = 0"))
        raise InterruptedError

    def arrived(batch):
        return outbox.keys_of(spark.read.schema(shape).parquet(sent)).filter(F.col("batch") == batch)

    try:
        outbox.publish(spark, box, die, arrived)
    except InterruptedError:
        outbox.publish(spark, box, send, arrived)
    there = spark.read.schema(shape).parquet(sent)
    keyed = there.select("key", "value", F.filter("headers", lambda h: h["key"] != "batch").alias("h"))
    said = F.size(F.from_json("value", "predictions array<long>")["predictions"]).cast("long")
    place = {"partition": F.col("h")[0]["value"].cast("string").cast("int"), "offset": F.col("h")[1]["value"].cast("string").cast("long")}
    return keyed.withColumns(place).groupBy("key", "partition", "offset").agg(F.count(F.lit(1)).alias("n_copies"), F.max(said).alias("n_predictions"))
