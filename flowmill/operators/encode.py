"""Category encoders: fit to a table ``(column, value, n, idx)``, apply as an index lookup."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.operators import skew
from flowmill.sources.session import pinned

UNKNOWN = -1
LITERAL_VALUES = 64  # a map literal is searched value by value, so only short ones are used
BROADCAST_VALUES = 100_000
DRIVER_VALUES = 10_000
FREQUENT = 10_000  # values looked up by broadcast where a vocabulary is too large for that

Encoders = dict[str, dict[str, int]]


def vocabulary(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct non-null values of several columns with their counts, from one scan."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_encoder(
    df: DataFrame, columns: tuple[str, ...], by: str = "value", rank_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """Number each column's values from 0: ascending by ``value``, or by falling ``frequency``.

    Nulls are ignored; equal frequencies are numbered alphabetically. A vocabulary of more
    than ``rank_rows`` values is ranked in range-partitioned chunks.
    """
    values = pinned(vocabulary(df, columns).withColumn("_falling", -F.col("n")))
    order = {"value": ("value",), "frequency": ("_falling", "value")}[by]
    total = values.count()
    if total <= rank_rows:
        position = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    else:
        values = skew.range_chunks(values, ("column", *order), total, rank_rows)
        sizes = values.groupBy("column", "_chunk").agg(F.count(F.lit(1)).alias("_size"))
        earlier = Window.partitionBy("column").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(
            "column", "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
        )
        # one row per chunk and column: bounded by the chunk count plus the column count
        values = values.join(F.broadcast(starts), ["column", "_chunk"])
        position = F.row_number().over(Window.partitionBy("column", "_chunk").orderBy(*order)) + F.col("_start")
    return values.select("column", "value", "n", (position - 1).cast("int").alias("idx"))


def learn_encoders(df: DataFrame, columns: tuple[str, ...], by: str = "value",
                   driver_values: int = DRIVER_VALUES) -> Encoders | DataFrame:
    """Encoders as a dictionary, or as the table of :func:`fit_encoder` when the columns have
    more than ``driver_values`` values in all."""
    rows = vocabulary(df, columns).limit(driver_values + 1).collect()
    if len(rows) > driver_values:
        return fit_encoder(df, columns, by)
    rank = {"value": lambda r: r["value"], "frequency": lambda r: (-r["n"], r["value"])}[by]
    return {
        c: {r["value"]: i for i, r in enumerate(sorted((r for r in rows if r["column"] == c), key=rank))}
        for c in columns
    }


def _literal_index(column: str, mapping: dict[str, int]) -> Column:
    if not mapping:
        return F.lit(UNKNOWN)
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(literal[F.col(column).cast("string")], F.lit(UNKNOWN))


def _lookup(df: DataFrame, column: str, values: DataFrame, broadcast: bool) -> DataFrame:
    """Left join to one column's values. Too many to broadcast: the ``FREQUENT`` most frequent ones are
    looked up by broadcast, and only rows that are left, and not null, are matched by their value; all
    others are spread evenly. Larger partitions of that join are split at run time."""
    named = values.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))
    key = F.col(column).cast("string")
    if broadcast:
        joined = df.join(F.broadcast(named), key == F.col("_value"), "left")
        index = F.coalesce("_idx", F.lit(UNKNOWN)).alias(f"{column}_idx")
        return joined.select(*df.columns, index)
    frequent = values.orderBy(F.desc("n"), "value").limit(FREQUENT) if "n" in values.columns else values.limit(0)
    frequent = frequent.select(F.col("value").alias("_often"), F.col("idx").alias("_often_idx"))
    found = df.join(F.broadcast(frequent), key == F.col("_often"), "left")
    open_ = F.col("_often_idx").isNull() & key.isNotNull()
    # rows without a match to find get numbers that no value has
    spread = found.withColumns({"_spread": F.when(open_, F.lit(-1)).otherwise(F.monotonically_increasing_id()), "_key": F.when(open_, key)})
    rest = named.withColumn("_place", F.lit(-1).cast("long"))
    joined = spread.join(rest, (F.col("_spread") == F.col("_place")) & F.col("_key").eqNullSafe(F.col("_value")), "left")
    index = F.coalesce("_often_idx", "_idx", F.lit(UNKNOWN)).alias(f"{column}_idx")
    return joined.select(*df.columns, index)


def encode(
    df: DataFrame, encoders: Encoders | DataFrame, columns: tuple[str, ...],
    literal_values: int = LITERAL_VALUES, broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Add ``<column>_idx``; null and unseen values become ``-1``."""
    if isinstance(encoders, dict):
        short = [c for c in columns if len(encoders.get(c, {})) <= literal_values]
        df = df.withColumns({f"{c}_idx": _literal_index(c, encoders.get(c, {})) for c in short})
        for c in [c for c in columns if c not in short]:
            values = df.sparkSession.createDataFrame(list(encoders[c].items()), "value string, idx int")
            df = _lookup(df, c, values, len(encoders[c]) <= broadcast_values)
        return df
    sizes = {r["column"]: r["n"] for r in encoders.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in columns:
        df = _lookup(df, c, encoders.filter(F.col("column") == c), sizes.get(c, 0) <= broadcast_values)
    return df
