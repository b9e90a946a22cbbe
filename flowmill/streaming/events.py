"""Event streams: sources, landing and quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowmill.functions import messages
from flowmill.sources.schemas import MESSAGE_SCHEMA


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages kept as Parquet files, in the schema of a topic's messages."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def present(stream: DataFrame) -> DataFrame:
    """Messages that have a body; deletions and empty records are skipped."""
    return stream.filter(F.col("value").isNotNull() & (F.trim("value") != ""))


def decoded(stream: DataFrame) -> DataFrame:
    """Flat flow rows with ``problem``, next to the message's key, partition and offset."""
    return messages.decode_events(present(stream))


def deduplicated(flows: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per event id, however late a copy or an event comes.

    Every id that was seen stays in the state, so nothing is dropped for being late; keep the
    state on disk (:func:`keep_state_on_disk`). An id that is delivered very often is first reduced
    in ``salts`` groups by message offset (default: one per shuffle partition), so that no task
    receives all of its copies.
    """
    if salts is None:
        salts = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = flows.withColumn("_salt", F.pmod(F.col("offset"), F.lit(salts)))
    reduced = salted.dropDuplicates(["event_id", "_salt"]) if salts > 1 else salted
    return reduced.dropDuplicates(["event_id"]).drop("_salt")


def recent_distinct(flows: DataFrame, delay: str) -> tuple[DataFrame, DataFrame]:
    """``(distinct, timed)`` with ids remembered for ``delay`` of event time only.

    For sources whose copies never come later than that, this bounds the state. Rows behind the
    watermark do not get through; ``timed`` carries the event time with which :func:`late_rows`
    counts them, so that none is lost unseen.
    """
    timed = flows.withColumn("event_time", F.timestamp_seconds("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("event_time"), timed


def late_rows(timed: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows of ``timed`` (a finished table) whose event id has not been landed."""
    return timed.join(landed.select("event_id"), "event_id", "left_anti")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Hold streaming state in RocksDB, so that it is not limited by executor memory."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def write_files(df: DataFrame, path: str, checkpoint: str, finish: bool = False) -> StreamingQuery:
    """Exactly-once Parquet sink; ``finish`` stops at the end of the available input."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if finish:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def write_split(
    decoded_stream: DataFrame, good: str, bad: str, checkpoint: str, finish: bool = False,
    prepare: Callable[[DataFrame], DataFrame] | None = None, carried: tuple[str, ...] = (),
) -> StreamingQuery:
    """Usable rows to ``good`` and unusable ones, with the ``carried`` columns, to ``bad``.

    Each micro-batch overwrites its own ``batch_id`` folder, so a batch that runs again after
    a failure replaces its earlier output. Errors other than bad input stop the query.
    """
    change = prepare or (lambda df: df)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            folder = f"batch_id={batch_id}"
            change(messages.usable(batch)).write.mode("overwrite").parquet(f"{good}/{folder}")
            messages.quarantined(batch, carried=carried).write.mode("overwrite").parquet(f"{bad}/{folder}")
        finally:
            batch.unpersist()

    writer = decoded_stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if finish:
        writer = writer.trigger(availableNow=True)
    return writer.start()
