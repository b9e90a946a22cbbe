"""Repeatable samples and row caps. Draws come from hashes of a unique key, so they depend
neither on partitioning nor on task retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.operators import skew

BUCKET_ROWS = 50_000  # rows of a group that are ranked together, about
MIN_PER_CLASS = 5


def sample_fraction(df: DataFrame, fraction: float | None, key: str | None, seed: int = 42) -> DataFrame:
    """Keep each row with probability ``fraction``; none, 0 or less and 1 or more mean all rows.

    Without a key the draw is Spark's own, which is repeatable for the same input files only.
    """
    if fraction is None or not 0.0 < fraction < 1.0:
        return df
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.filter(scalar.uniform(key, seed) < fraction)


def _first_by_hash(df: DataFrame, by: tuple[str, ...], quota: DataFrame, key: str, seed: int) -> DataFrame:
    """Per group, the ``_quota`` rows with the smallest key hash, without sorting whole groups.

    ``quota`` has one row ``(*by, _quota, _rows)`` per group and must be small enough to broadcast.
    Rows are counted by as many hash digits as make buckets of at most ``BUCKET_ROWS`` rows; the last
    wanted row lies in the bucket where a group's running count passes its quota, and only that bucket
    is ranked. The rows up to that one are then a plain filter of the input.
    """
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("_rows") / F.lit(BUCKET_ROWS)))).cast("int")
    sized = quota.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_quota", digits.alias("_digits"))
    named = sized.drop("_digits")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    hashes = df.select(*by, key, scalar.hash_key(key, seed).alias("_hash")).join(F.broadcast(sized.drop("_quota")), on)
    hashes = hashes.withColumn("_digits_hash", F.substring(F.col("_hash"), F.lit(1), F.col("_digits"))).drop(
        "_digits", *[f"_of_{c}" for c in by])
    bucket = F.col("_digits_hash")

    counts = hashes.groupBy(*by, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto, before = F.col("_upto"), F.col("_upto") - F.col("_n")
    edge = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .join(F.broadcast(named), on)
        .filter((upto >= F.col("_quota")) & (before < F.col("_quota")))
        .select(*named.columns[:-1], F.col("_bucket").alias("_edge"), (F.col("_quota") - before).alias("_rest"))
    )
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_hash", key))
    last = (
        hashes.join(F.broadcast(edge), [*on, bucket == F.col("_edge")])
        .withColumn("_place", place).filter(F.col("_place") == F.col("_rest"))
        .select(*named.columns[:-1], F.struct("_hash", key).alias("_last"))
    )
    placed = df.withColumn("_at", F.struct(scalar.hash_key(key, seed).alias("_hash"), F.col(key)))
    return placed.join(F.broadcast(last), on).filter(F.col("_at") <= F.col("_last")).select(*df.columns)


def _class_quota(n: Column, fraction: float) -> Column:
    wanted = F.greatest(F.lit(MIN_PER_CLASS), F.floor(n * F.lit(fraction)))
    return F.least(n, wanted).cast("long")


def stratified_sample(
    df: DataFrame, by: str, fraction: float, key: str, seed: int = 42, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """``fraction`` of each class, but at least 5 rows of it (all of a smaller class).

    Small classes are ranked by hash in one task each; classes above ``hot_rows`` rows go
    through hash-bucket counts.
    """
    hot = skew.hot_keys(df, (by,), hot_rows)
    large, small = (None, df) if hot is None else skew.split_hot(df, hot, (by,))
    group = Window.partitionBy(by)
    ranked = small.withColumns({
        "_rank": F.row_number().over(group.orderBy(scalar.hash_key(key, seed), key)),
        "_n": F.count(F.lit(1)).over(group),
    })
    out = ranked.filter(F.col("_rank") <= _class_quota(F.col("_n"), fraction)).drop("_rank", "_n")
    if large is None:
        return out
    quota = hot.select(by, _class_quota(F.col("n_rows"), fraction).alias("_quota"), F.col("n_rows").alias("_rows"))
    return out.unionByName(_first_by_hash(large, (by,), quota, key, seed))


def cap_rows(df: DataFrame, n: int, key: str | None = None, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, 0 or less for no cap: those with the smallest hashes of the unique ``key``."""
    if n <= 0:
        return df
    if key is None:
        raise ValueError("a row cap draws by hashes of a unique key; name that column")
    one = df.withColumn("_all", F.lit(0))
    total = df.count()
    if total <= n:
        return df
    quota = df.sparkSession.createDataFrame([(0, n, total)], "_all int, _quota long, _rows long")
    return _first_by_hash(one, ("_all",), quota, key, seed).drop("_all")


def assign_weighted(df: DataFrame, out: str, weights: tuple[float, ...], key: str, seed: int = 42) -> DataFrame:
    """Draw a class (or split) number per row with the given weights."""
    return df.withColumn(out, scalar.weighted_choice(scalar.uniform(key, seed), weights))


def assign_variant(df: DataFrame, share: float, key: str, seed: int = 42) -> DataFrame:
    """Add ``variant``: ``canary`` for a ``share`` of rows, held inside [0, 1], else ``stable``."""
    share = max(0.0, min(1.0, float(share)))
    chosen = F.when(scalar.uniform(key, seed) < share, "canary").otherwise("stable")
    return df.withColumn("variant", chosen)
