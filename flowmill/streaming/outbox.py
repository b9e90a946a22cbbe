"""Replies that are published once each, whatever is killed on the way.

Scoring writes replies to an outbox: a folder per micro-batch, every reply under its key (batch, partition, offset). A
batch that runs again replaces its folder. A publisher takes the folders in order. It notes which batch it begins and
which it has finished; of a batch that was begun but not finished, it asks the destination which keys have arrived
and sends the others. A destination must therefore be readable by key and keep what it was sent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("batch", "partition", "offset")

Send = Callable[[DataFrame], None]
Arrived = Callable[[int], DataFrame]  # the keys of a batch that the destination has


def write_outbox(replies: DataFrame, outbox: str, checkpoint: str, finish: bool = False,
                 prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Rows ``(partition, offset, key, value)`` of a stream, prepared if that is given, as folders of the outbox."""
    change = prepare or (lambda df: df)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = change(batch).select(F.lit(batch_id).cast("long").alias("batch"), "partition", "offset", "key", "value")
        rows.write.mode("overwrite").parquet(f"{outbox}/batch-{batch_id}")

    writer = replies.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if finish else writer).start()


def _numbers(spark: SparkSession, outbox: str, kind: str, below: str = "") -> set[int]:
    """The batches of the paths ``<kind>-<batch><below>`` in the outbox."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{outbox}/{kind}-*{below}")
    found = path.getFileSystem(conf).globStatus(path) or []
    return {int(re.findall(rf"/{kind}-(\d+)", f.getPath().toString())[-1]) for f in found}


def _mark(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).create(place, True).close()


def publish(spark: SparkSession, outbox: str, send: Send, arrived: Arrived) -> int:
    """Send every reply of the outbox's finished folders that was not sent yet; returns how many batches that took."""
    written, done, begun = _numbers(spark, outbox, "batch", "/_SUCCESS"), _numbers(spark, outbox, "done"), _numbers(spark, outbox, "begun")
    for batch in sorted(written - done):
        rows = spark.read.parquet(f"{outbox}/batch-{batch}")
        if batch in begun:
            here = arrived(batch).select(*KEY).distinct()
            rows = rows.join(here, list(KEY), "left_anti")
        else:
            _mark(spark, f"{outbox}/begun-{batch}")
        send(rows.select(*KEY, "key", "value"))
        _mark(spark, f"{outbox}/done-{batch}")
    return len(written - done)


def as_messages(rows: DataFrame) -> DataFrame:
    """Replies as Kafka messages: the key of the outbox goes along in the headers."""
    header = lambda name: F.struct(F.lit(name).alias("key"), F.col(name).cast("string").cast("binary").alias("value"))
    return rows.select("key", "value", F.array(*map(header, KEY)).alias("headers"))


def keys_of(messages: DataFrame) -> DataFrame:
    """The keys ``(batch, partition, offset)`` of messages with headers."""
    named = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    kinds = zip(KEY, ("long", "int", "long"))
    return messages.select(named.alias("h")).select(*[F.col("h")[name].cast(kind).alias(name) for name, kind in kinds])
