"""Numeric, hashing and array expressions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(column: Column, low: float, high: float) -> Column:
    """``column`` held inside ``[low, high]``; null stays null."""
    return F.when(column < low, low).when(column > high, high).otherwise(column)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def spread_category(column: str, values: tuple[str, ...]) -> Column:
    """Position of a category among ``values``, spaced evenly over [-1, 1]; one value maps to 0."""
    step = 2.0 / (len(values) - 1) if len(values) > 1 else 0.0
    start = -1.0 if len(values) > 1 else 0.0
    branches = [(F.col(column) == v, F.lit(start + step * i)) for i, v in enumerate(values)]
    return reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest element of a stored array; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def argmax_of(scores: list[Column]) -> Column:
    """:func:`argmax` of separate expressions, each of them evaluated once.

    The largest (score, -position) pair has the first of the largest scores.
    """
    pairs = [F.struct(s.alias("score"), F.lit(-k).alias("position")) for k, s in enumerate(scores)]
    return (-F.greatest(*pairs)["position"]).cast("long")


def above_half(probability: Column) -> Column:
    """Class of a two-class model that returns one probability."""
    return (probability > 0.5).cast("long")


def with_softmax(df: DataFrame, scores: str, out: str) -> DataFrame:
    """Add class probabilities of an array column of raw scores.

    Scores are shifted by their maximum so that exp cannot overflow. Maximum, powers and sum
    get a projection each, so that none is computed once per element.
    """
    shifted = df.withColumn("_max", F.array_max(scores)).withColumn(
        "_powers", F.transform(scores, lambda x: F.exp(x - F.col("_max")))
    )
    summed = shifted.withColumn("_sum", F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x))
    return summed.withColumn(out, F.transform("_powers", lambda x: x / F.col("_sum"))).drop("_max", "_powers", "_sum")


def hash_key(key: str, seed: int | str) -> Column:
    """Seeded 32-digit hash text: the same row gets the same text in any partitioning."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def uniform(key: str, seed: int | str) -> Column:
    """Repeatable draw in [0, 1) from the first 32 bits of :func:`hash_key`."""
    digits = F.substring(hash_key(key, seed), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def normal(key: str, seed: int | str) -> Column:
    """Repeatable standard normal draw (Box-Muller over two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(key, f"{seed}a")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(key, f"{seed}b"))


def weighted_choice(draw: Column, weights: tuple[float, ...]) -> Column:
    """Position of the weight interval that a uniform draw falls into."""
    if not weights or min(weights) < 0 or not math.isfinite(sum(weights)) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive finite sum")
    total = sum(weights)
    bounds = [c / total for c in accumulate(weights)][:-1]
    # rounding may leave the last interval open: everything past the last bound is the last
    # position that has a weight
    last = max(i for i, w in enumerate(weights) if w > 0)
    if not bounds:
        return F.lit(last).cast("long")
    branches = [(draw < b, i) for i, b in enumerate(bounds)]
    chosen = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
    return chosen.otherwise(last).cast("long")
