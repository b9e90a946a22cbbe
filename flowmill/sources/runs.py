"""Run log: one long table of parameters and numeric metrics."""

from __future__ import annotations

import numbers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, kind string, name string, text string, number double"
# fixed values: parameter prefixes by framework
PREFIXES = {"trees": "xgb_", "net": "pt_"}


def param_rows(spark: SparkSession, run_id: str, framework: str, common: dict, params: dict) -> DataFrame:
    """Parameters of a run; those of the framework carry its prefix."""
    named = {"framework": framework} | common
    named |= {PREFIXES[framework] + k: v for k, v in params.items()}
    rows = [(run_id, "param", k, str(v), None) for k, v in named.items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_rows(spark: SparkSession, run_id: str, metrics: dict) -> DataFrame:
    """Numeric metrics of a run; booleans, text and tables are left out."""
    rows = [
        (run_id, "metric", k, None, float(v))
        for k, v in metrics.items()
        if isinstance(v, numbers.Real) and not isinstance(v, bool)
    ]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def metric_table_rows(metrics: DataFrame, run_id: str, prefix_column: str) -> DataFrame:
    """Rows from a wide metrics table: one per numeric column, named ``<prefix>_<column>``."""
    numeric = [c for c, t in metrics.dtypes if c != prefix_column and t in ("double", "bigint")]
    long = metrics.select(prefix_column, *[F.col(c).cast("double") for c in numeric]).unpivot(
        [prefix_column], numeric, "metric", "number"
    )
    return long.select(
        F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"),
        F.concat_ws("_", prefix_column, "metric").alias("name"),
        F.lit(None).cast("string").alias("text"), "number",
    )


def append(rows: DataFrame, path: str | None) -> bool:
    """Append to the runs table; without a destination nothing happens."""
    if not path:
        return False
    rows.write.mode("append").parquet(path)
    return True


def log_run(
    spark: SparkSession, path: str | None, run_id: str, framework: str, common: dict, params: dict, metrics: dict
) -> bool:
    """Append one run's parameters and numeric metrics; without a destination nothing happens."""
    if not path:
        return False
    rows = param_rows(spark, run_id, framework, common, params).unionByName(metric_rows(spark, run_id, metrics))
    return append(rows, path)


def best_run(runs: DataFrame, metric: str, mode: str = "min") -> DataFrame:
    """The run with the smallest (or largest) value of one metric; ties go to the first run id."""
    wanted = runs.filter((F.col("name") == metric) & F.col("number").isNotNull())
    # min over (value, run id): partial per task, one row shuffled from each
    value = F.col("number") if mode == "min" else -F.col("number")
    best = wanted.agg(F.min(F.struct(value.alias("v"), "run_id", "number")).alias("b"))
    return best.filter(F.col("b").isNotNull()).select("b.run_id", "b.number")
