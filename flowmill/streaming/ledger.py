"""Exact de-duplication against a ledger of all ids, without streaming state.

The ledger is a table of the ids that have been let through: a folder per micro-batch, cut into hash buckets, with a
Bloom filter in every file. A micro-batch of few ids reads only the buckets they fall into, and of these only the
files whose filters may have one; a large one, which falls into every bucket, is joined with the ledger. Memory does not grow with the stream; the ledger on storage does, by
one id per event. From time to time older folders are put together into one.

A micro-batch that runs again after a failure reads the folders of earlier batches only and replaces what its first
attempt left, so it lets the same ids through. The ledger, the sink and the query's progress belong together: start all
three anew, or none.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 16
FEW_IDS = 1000  # of a batch, that are looked up one by one
FOLDERS = 20  # of single batches, before they are put together
SHAPE = "id string, bucket int"


def _bucket(id_column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column).cast("string")), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, ledger: str, before: int) -> tuple[list[str], int]:
    """Finished folders with the ids of all batches before that one, and how many of them hold a single batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(ledger)
    done = root.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS")) or []
    named = [re.fullmatch(r"(upto|batch)-(\d+)", f.getPath().getParent().getName()) for f in done]
    upto = max((int(m[2]) for m in named if m and m[1] == "upto" and int(m[2]) < before), default=-1)
    single = sorted(int(m[2]) for m in named if m and m[1] == "batch" and upto < int(m[2]) < before)
    return ([f"{ledger}/upto-{upto}"] if upto >= 0 else []) + [f"{ledger}/batch-{k}" for k in single], len(single)


def _write(ids: DataFrame, path: str, id_column: str, buckets: int) -> None:
    rows = ids.select(F.col(id_column).cast("string").alias("id"), _bucket(id_column, buckets).alias("bucket")).repartition("bucket")
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(path)


def _ids(spark: SparkSession, folders: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(SHAPE).parquet(f) for f in folders])


def _known(first: DataFrame, folders: list[str], id_column: str, buckets: int) -> DataFrame:
    """Ids of the ledger that the rows may have: all of it for a batch of many ids, which fall into every bucket."""
    spark = first.sparkSession
    known = _ids(spark, folders)
    ids = F.col(id_column).cast("string")
    few = first.select(ids.alias("id"), _bucket(id_column, buckets).alias("bucket")).limit(FEW_IDS + 1).collect()
    if len(few) <= FEW_IDS:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(FEW_IDS))
        known = known.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few}))).filter(F.col("id").isin([r["id"] for r in few]))
    return known.select("id")


def let_through(batch: DataFrame, batch_id: int, out: str, ledger: str, id_column: str = "event_id",
                order: tuple[str, ...] = ("partition", "offset"), buckets: int = BUCKETS, folders: int = FOLDERS) -> None:
    """Write the rows of a micro-batch whose ids are new to ``out``, and the ids to the ledger.

    Of rows with one id the first by ``order`` is taken. Rows with a null id are all let through.
    """
    spark = batch.sparkSession
    place = f"{out}/batch_id={batch_id}"
    row, names = F.struct(*[F.col(f"`{c}`") for c in batch.columns]), batch.columns
    # grouping starts inside the tasks, so copies of one id do not travel
    named = batch.filter(F.col(id_column).isNotNull())
    first = named.groupBy(F.col(id_column).alias("_id")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*").persist()
    try:
        seen, single = _folders(spark, ledger, batch_id)
        if single > folders:
            together = f"{ledger}/upto-{batch_id - 1}"
            _write(_ids(spark, seen).select("id"), together, "id", buckets)
            seen = [together]
        new = first
        if seen:
            known = _known(first, seen, id_column, buckets)
            new = first.join(known, first[id_column].cast("string") == known["id"], "left_anti")
        new = new.select(*names).persist()
        nameless = batch.filter(F.col(id_column).isNull())
        new.unionByName(nameless).write.mode("overwrite").parquet(place)
        _write(new, f"{ledger}/batch-{batch_id}", id_column, buckets)
        new.unpersist()
    finally:
        first.unpersist()


def write_distinct(stream: DataFrame, out: str, ledger: str, checkpoint: str, finish: bool = False, **options) -> StreamingQuery:
    """The rows of a stream whose ids come for the first time, as a table; ``finish`` stops at the end of the available input."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        let_through(batch, batch_id, out, ledger, **options)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if finish else writer).start()
