"""Kafka options, source and sink (the connector jar comes with the cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: delivery settings of the score sink and of the event publisher
SCORE_SINK = {
    "kafka.enable.idempotence": "true",
    "kafka.acks": "all",
    "kafka.max.in.flight.requests.per.connection": "5",
    "kafka.compression.type": "lz4",
}
EVENT_SINK = {
    "kafka.compression.type": "gzip",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "16384",
}
EVENT_TOPIC = "topic-traffic"


def source_options(servers: str, topic: str = EVENT_TOPIC, min_partitions: int | None = None,
                   **security: str) -> dict[str, str]:
    """Subscribe one topic from the earliest offset, committed records only.

    ``min_partitions`` above the topic's partition count splits large offset ranges over
    more tasks; ``security`` holds plain ``kafka.*`` settings with dots as underscores.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
    }
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    return options | {f"kafka.{k.replace('_', '.')}": v for k, v in security.items()}


def stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Unbounded rows of :data:`flowmill.sources.schemas.MESSAGE_SCHEMA`, key and value as text.

    The broker's time is ``message_time``; the decoded event has a ``timestamp`` of its own.
    """
    return as_rows(spark.readStream.format("kafka").options(**options).load())


def as_rows(records: DataFrame) -> DataFrame:
    """Records as the connector gives them, in the common message schema."""
    return records.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "partition", "offset", F.col("timestamp").alias("message_time"),
    )


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as ``(key, value)`` messages: optional text key, JSON value of all other columns."""
    key_column = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    body = [c for c in df.columns if c != key]
    return df.select(key_column.alias("key"), F.to_json(F.struct(*body)).alias("value"))


def publish(messages: DataFrame, servers: str, topic: str = EVENT_TOPIC) -> None:
    """Write a finite set of event messages."""
    (messages.write.format("kafka").options(**EVENT_SINK)
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def score_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Unstarted writer of score messages; progress is kept in ``checkpoint``."""
    return (messages.writeStream.format("kafka").options(**SCORE_SINK)
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint))
