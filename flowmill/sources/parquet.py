"""Parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.sources.schemas import FLOW_SCHEMA, SPLITS

RECORDS_PER_FILE = 100_000


def scan(spark: SparkSession, path: str, schema: T.StructType | None = FLOW_SCHEMA) -> DataFrame:
    """Scan a directory with an imposed schema; a column absent from a file reads as null."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def split_path(root: str, split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {list(SPLITS)}, got {split!r}")
    return f"{root.rstrip('/')}/{split}"


def scan_split(
    spark: SparkSession, root: str, split: str, schema: T.StructType | None = FLOW_SCHEMA
) -> DataFrame:
    return scan(spark, split_path(root, split), schema)


def scan_partitions(
    spark: SparkSession, path: str, partitions: int | None = None,
    schema: T.StructType | None = FLOW_SCHEMA,
) -> DataFrame:
    """Scan with a chosen number of partitions; ``None`` leaves it to the file splits.

    Fewer partitions than file splits are merged without a shuffle.
    """
    df = scan(spark, path, schema)
    if partitions is None:
        return df
    return df.coalesce(partitions) if partitions <= df.rdd.getNumPartitions() else df.repartition(partitions)


def set_read_size(spark: SparkSession, megabytes: int = 256) -> None:
    """Cap the bytes of input one scan task reads."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", megabytes * 1024 * 1024)


def write(df: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Overwrite ``path``; no file holds more than ``records_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(path)


def row_and_column_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")
    )
