"""Scalers: fit mean and deviation in one aggregation, apply as column arithmetic."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scaler = dict[str, dict[str, float]]


def scaler_table(
    df: DataFrame, columns: tuple[str, ...], population: bool = False, nulls_as_zero: bool = False,
    keep_zero: bool = False,
) -> DataFrame:
    """Rows ``(column, mean, std)``; a missing deviation becomes 1, and so does a zero one unless
    ``keep_zero``, which is for :func:`scale` with an epsilon."""
    deviation = F.stddev_pop if population else F.stddev_samp
    inputs = {c: F.col(c).cast("double") for c in columns}
    if nulls_as_zero:
        inputs = {c: F.coalesce(x, F.lit(0.0)) for c, x in inputs.items()}
    wide = df.agg(
        *[F.avg(x).alias(f"mean_{c}") for c, x in inputs.items()],
        *[deviation(x).alias(f"std_{c}") for c, x in inputs.items()],
    )
    entry = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"),
            F.coalesce(F.col(f"std_{c}") if keep_zero else F.nullif(F.col(f"std_{c}"), F.lit(0.0)), F.lit(1.0)).alias("std"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*entry)))


def fit_scaler(df: DataFrame, columns: tuple[str, ...], population: bool = False,
               nulls_as_zero: bool = False, keep_zero: bool = False) -> Scaler:
    """Scaler parameters on the driver: one row per column."""
    rows = scaler_table(df, columns, population, nulls_as_zero, keep_zero).collect()
    empty = [r["column"] for r in rows if r["mean"] is None]
    if empty:
        raise ValueError(f"no values to fit a scaler on: {empty}")
    return {r["column"]: {"mean": r["mean"], "std": r["std"]} for r in rows}


def scale(
    df: DataFrame, scaler: Scaler, columns: tuple[str, ...], nulls_as_zero: bool = False,
    epsilon: float = 0.0,
) -> DataFrame:
    """Add ``<column>_norm = (x - mean) / (std + epsilon)``.

    A column without parameters counts as mean 0, deviation 1; a deviation of 0 as 1 unless
    ``epsilon`` keeps the division defined.
    """
    added = {}
    for c in columns:
        stats = scaler.get(c, {})
        std = stats.get("std", 1.0)
        divisor = std + epsilon if epsilon else (std or 1.0)
        x = F.col(c).cast("double")
        if nulls_as_zero:
            x = F.coalesce(x, F.lit(0.0))
        added[f"{c}_norm"] = (x - F.lit(float(stats.get("mean", 0.0)))) / F.lit(float(divisor))
    return df.withColumns(added)


def assemble(df: DataFrame, columns: tuple[str, ...], out: str = "features") -> DataFrame:
    """Columns as one vector; nulls count as 0."""
    filled = df.withColumns({f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    vectors = VectorAssembler(inputCols=[f"_v_{c}" for c in columns], outputCol=out).transform(filled)
    return vectors.drop(*[f"_v_{c}" for c in columns])


def moments(columns: tuple[str, ...]) -> list[Column]:
    """Mean and sample deviation of each column, nulls as 0, as aggregates of one pass."""
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    return [F.avg(x).alias(f"mean_{c}") for c, x in values.items()] + [F.stddev_samp(x).alias(f"std_{c}") for c, x in values.items()]


def standardised(columns: tuple[str, ...], found: dict, prefix: str) -> dict[str, Column]:
    """Columns scaled by the values of :func:`moments`; a constant column becomes 0."""
    out = {}
    for c in columns:
        x, std = F.coalesce(F.col(c).cast("double"), F.lit(0.0)), found.get(f"std_{c}")
        out[f"{prefix}{c}"] = (x - F.lit(found[f"mean_{c}"])) / F.lit(std) if std else F.lit(0.0)
    return out


def fit_vector_scaler(df: DataFrame, column: str = "features", out: str = "features_scaled"):
    """Scaler of whole vectors by mean and sample deviation."""
    return StandardScaler(inputCol=column, outputCol=out, withMean=True, withStd=True).fit(df)
