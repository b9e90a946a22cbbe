"""Keys that hold too many rows for one task.

A key is *hot* when it has more than ``hot_rows`` rows, so work per task is bounded by rows alone. :func:`summary`
finds them with a sketch in one scan of the key columns. :func:`hot_keys` counts them exactly: rows are first
counted by a hash of the key, many keys to a bucket, which moves a few numbers per task; only keys
of buckets above the bound are then counted one by one. Tables no larger than ``hot_rows`` cannot have a
hot key; for a plain Parquet scan that check only reads footers.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.sources.session import pinned

HOT_ROWS = 1_000_000
BUCKETS = 4096  # at least, and 16 for each hot key there could be
BROADCAST_KEYS = 100_000
TRACKED = 49_000  # keys that a summary counts at a time
GROUPS = 64  # of partial summaries
SLICES = 4096  # at most, of an order


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def hot_keys(df: DataFrame, keys: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Rows ``(*keys, n_rows)`` of the hot keys, or ``None`` when there are none."""
    total = df.count()
    if total <= hot_rows:
        return None
    buckets = max(BUCKETS, 16 * total // max(1, hot_rows))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    heavy = pinned(df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows), "heavy")
    n_heavy = heavy.count()
    if not n_heavy:
        return None
    rows = df.select(*keys).join(few(heavy.select("_bucket"), n_heavy), bucket == F.col("_bucket"), "left_semi")
    hot = pinned(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > hot_rows), "hot")
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, hot: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``(hot rows, other rows)``; up to ``BROADCAST_KEYS`` keys are broadcast and no row is shuffled."""
    listed = few(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]), hot.count())
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(listed, on, "left_semi"), df.join(listed, on, "left_anti")


def range_chunks(df: DataFrame, order: tuple[str, ...], rows: int, chunk_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` cut into chunks of about ``chunk_rows`` rows along ``order``, numbered by ``_chunk``.

    Chunk numbers rise with ``order``. The result is pinned because range bounds are sampled: a second
    evaluation could cut elsewhere.
    """
    chunks = max(1, -(-rows // chunk_rows))
    return pinned(df.repartitionByRange(chunks, *order).withColumn("_chunk", F.spark_partition_id()), "chunks")


@dataclass(frozen=True)
class Summary:
    """What one scan tells of a table: its rows, hashes of its hot keys, and values that cut its order into slices."""

    rows: int
    hot: tuple[int, ...]
    cuts: tuple
    tied: bool  # a single value of the order may fill a slice

    def is_hot(self, keys: tuple[str, ...]) -> Column:
        return F.xxhash64(*keys).isin(list(self.hot))

    def slice(self, value: str) -> Column:
        """How many cuts are at most the value, by halving; 0 for null."""
        if not self.cuts:
            return F.lit(0)
        cuts, steps = F.array(*[F.lit(c) for c in self.cuts]), [1 << i for i in range(len(self.cuts).bit_length() - 1, -1, -1)]
        passed = lambda at, step: (at + step <= len(self.cuts)) & (F.get(cuts, at + step - 1) <= F.col(value))
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))


def summary(df: DataFrame, keys: tuple[str, ...], along: str | None = None, hot_rows: int = HOT_ROWS) -> Summary:
    """Count a table's rows, find its hot keys and cut it along a numeric column, all in one scan of those columns.

    Keys are counted by a mergeable sketch of ``TRACKED`` counters whose error is below one row in 30,000, so a key
    is hot above ``hot_rows`` rows or that many, whichever is more. There are at most 30,000 of them. A key that
    shares its 64-bit hash with a hot one counts as hot, which changes the plan only. Tasks are summed up in ``GROUPS``
    groups, and their quantiles put together by weight.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(_key, {TRACKED})").alias("top")]
    merged = [F.sum("n").alias("rows"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(top), {TRACKED})").alias("top")]
    keyed = df.select(F.xxhash64(*keys).alias("_key"), *([F.col(along).alias("_along")] if along else []))
    if along:
        sums.append(F.percentile_approx("_along", [i / SLICES for i in range(1, SLICES)], 4 * SLICES).alias("cuts"))
        merged.append(F.collect_list(F.struct("n", "cuts")).alias("cuts"))
    parts = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("_group")).agg(*sums)
    r = parts.groupBy(F.lit("all")).agg(*merged).first()
    if r is None:
        return Summary(0, (), (), False)
    rows = r["rows"]
    bound = max(hot_rows, rows // 30_000)
    hot = tuple(t["item"] for t in r["top"] or [] if t["count"] > bound)
    cuts = _cuts([(g["n"], g["cuts"]) for g in r["cuts"] if g["cuts"]], min(SLICES, -(-rows // bound))) if along and hot else []
    return Summary(rows, hot, tuple(sorted(set(cuts))), len(set(cuts)) < len(cuts))


def _cuts(groups: list[tuple[int, list]], slices: int) -> list:
    """Values that cut the groups' rows into about equal slices; a value that fills a slice comes several times."""
    points = sorted((v, n) for n, values in groups for v in values)
    upto, total = list(accumulate(n for _, n in points)), sum(n for _, n in points)
    return [points[bisect_left(upto, total * i / slices)][0] for i in range(1, slices)]
