"""Fitted parameters on storage: encoders as a Parquet table, the scaler as one JSON document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

ENCODER_SCHEMA = "column string, value string, idx int, n long"
DRIVER_VALUES = 10_000

_LOADED: dict[tuple[str, str], dict] = {}


def save(spark: SparkSession, encoders: dict | DataFrame, scaler: dict, path: str) -> None:
    """Write both parts through the session's file system; the scaler comes last, so a folder
    that has one is complete. A vocabulary of any size fits."""
    if isinstance(encoders, dict):
        rows = [(c, v, i, 0) for c, values in encoders.items() for v, i in values.items()]
        encoders = spark.createDataFrame(rows, ENCODER_SCHEMA)
    counted = encoders if "n" in encoders.columns else encoders.selectExpr("*", "0L AS n")
    counted.select("column", "value", "idx", "n").write.mode("overwrite").parquet(f"{path}/encoders")
    text = json.dumps(scaler, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/scaler")
    _LOADED.pop((spark.sparkContext.applicationId, path), None)


def load(spark: SparkSession, path: str, refresh: bool = False, driver_values: int = DRIVER_VALUES) -> dict:
    """``{"encoders": ..., "scaler": ...}``; a second call in the session is served from memory unless
    refreshed. Up to ``driver_values`` values the encoders are a dictionary, beyond that the table."""
    key = (spark.sparkContext.applicationId, path)
    if refresh or key not in _LOADED:
        scaler = json.loads(spark.read.text(f"{path}/scaler", wholetext=True).first()["value"])
        table = spark.read.schema(ENCODER_SCHEMA).parquet(f"{path}/encoders")
        rows = table.limit(driver_values + 1).collect()
        encoders: dict | DataFrame = table
        if len(rows) <= driver_values:
            encoders = {}
            for r in sorted(rows, key=lambda r: (r["column"], r["idx"])):
                encoders.setdefault(r["column"], {})[r["value"]] = r["idx"]
        _LOADED[key] = {"encoders": encoders, "scaler": scaler}
    return _LOADED[key]


def as_table(spark: SparkSession, params: dict) -> DataFrame:
    """Parameters as rows ``(kind, column, key, value)``."""
    schema = "kind string, column string, key string, value double"
    rows = [("scaler", c, key, float(stats[key])) for c, stats in params["scaler"].items() for key in ("mean", "std")]
    encoders = params["encoders"]
    if isinstance(encoders, dict):
        rows += [("encoder", c, v, float(i)) for c, values in encoders.items() for v, i in values.items()]
        return spark.createDataFrame(rows, schema)
    table = encoders.selectExpr("'encoder' AS kind", "column", "value AS key", "CAST(idx AS DOUBLE) AS value")
    return table.unionByName(spark.createDataFrame(rows, schema))
