"""The three-split feature job: fit on train, apply to train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.plans.features import Fitted, feature_set
from flowmill.sources import parquet
from flowmill.sources.schemas import FLOW_SCHEMA, SPLITS
from flowmill.sources.session import pinned


def split_of(bucket: str = "bucket") -> Column:
    """Split by a 0..9 bucket column: 0-5 train, 6-7 val, 8-9 test."""
    b = F.col(bucket)
    return F.when(b < 6, "train").when(b < 8, "val").otherwise("test")


def prepare_split(
    spark: SparkSession, raw: str, processed: str, params: str, split: str, name: str = "base",
    schema=FLOW_SCHEMA, records_per_file: int = parquet.RECORDS_PER_FILE, shared: dict | None = None, **options,
) -> None:
    """Process one split; ``train`` fits and stores the parameters the others load.

    ``shared`` options, such as the time unit, go to fitting and applying; ``options`` to applying.
    """
    features, shared = feature_set(name), shared or {}
    df = parquet.scan_split(spark, raw, split, schema)
    if split == "train":
        if features.derive:
            df = pinned(features.derive(df, **shared))
        fitted = features.fit(df, **shared)
        fitted.save(spark, params)
    else:
        fitted = Fitted.load(spark, params)
    out = features.apply(df, fitted, **shared, **options)
    parquet.write(out, parquet.split_path(processed, split), records_per_file)


def prepare_all(spark: SparkSession, raw: str, processed: str, params: str, **options) -> None:
    for split in SPLITS:
        prepare_split(spark, raw, processed, params, split, **options)


def read_splits(spark: SparkSession, processed: str) -> DataFrame:
    """All processed splits with their name in ``split``."""
    frames = [
        parquet.scan_split(spark, processed, s, schema=None).withColumn("split", F.lit(s)) for s in SPLITS
    ]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
