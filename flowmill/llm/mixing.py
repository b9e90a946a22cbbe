"""Mix sources to target weights by fitting the budget as a subset sum.

Documents are counted by (source, exact size). A source's target is met with whole passes over
its documents and, for the rest, one more copy of some of them: how many of each size follows
from a bounded knapsack over the size counts, which documents from a seeded hash. Only counts
leave the tasks; documents are never gathered or ranked by source or by size.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a
source without words gets target 0. Documents are chosen by a hash of ``doc_id`` and text. Of rows
equal in both as many are taken as the quota has left, in the order in which tasks read them. An empty table gives an empty result. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import saved, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 20_261
KNAPSACK_WORDS = 65_536  # budget that the knapsack settles; the rest is taken in proportion
BUCKET_ROWS = 512  # rows of one size that are ranked together


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(_source, source_size, target)`` from rows ``(_source, _size)``.

    Sources in code point order, null last, take ``weights`` in turn and share all words. A
    target stops at ``repeats`` times its source's size; sorted by that bound over weight, the
    first source which stays below fixes the level for all the others below.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    named = totals.withColumn("w", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
    by_bound = Window.orderBy((F.col("bound") / F.col("w")).asc(), F.col("_source").asc_nulls_last())
    earlier = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        named.withColumn("bound", F.col("source_size") * float(repeats))
        .withColumns({
            "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0)),
            "shares": F.sum("w").over(rest),
            "place": F.row_number().over(by_bound),
        })
        .withColumn("level", F.col("left") / F.col("shares"))
        .withColumn("open", F.col("bound") > F.col("level") * F.col("w"))
    )
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"]
    return levels.withColumn("level", level).select(
        "_source", "source_size",
        F.least("bound", F.coalesce(F.col("level") * F.col("w"), F.col("bound"))).alias("target"),
    )


def fit_counts(sizes: list[int], counts: list[int], budget: int, window: int = KNAPSACK_WORDS) -> list[int]:
    """How many of ``counts[i]`` documents of ``sizes[i]`` words to take, so that they hold about
    ``budget`` words in all. Most are taken in proportion, the last ``window`` words by a bounded
    knapsack; of two sums equally near the smaller one wins."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    share = max(0, budget - window)
    taken = [c * share // total if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * n for s, n in zip(sizes, taken))
    places = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: hash((sizes[i], 7)))
    for i in places:  # what rounding down has left beyond the window
        if left > window and taken[i] < counts[i] and sizes[i] <= left - window // 2:
            taken[i] += 1
            left -= sizes[i]
    spare = [i for i in places if taken[i] < counts[i]]
    most = left + min((sizes[i] for i in spare), default=0)
    reach, steps, mask = 1, [], (1 << (most + 1)) - 1
    for i in spare:
        free, several = min(counts[i] - taken[i], most // sizes[i]), 1
        while free > 0 and not reach >> left & 1:
            several = min(several, free)
            steps.append((i, several, reach))
            reach |= (reach << several * sizes[i]) & mask
            free -= several
            several *= 2
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    above = left + 1 + (above & -above).bit_length() - 1 if above else None
    at = below if above is None or left - below <= above - left else above
    for i, several, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += several
            at -= several * sizes[i]
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One source's rows, a row for each size it has."""
    group = group.sort_values("_size")
    words, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = math.floor(target / words) if words else 0
    extra = fit_counts(group["_size"].tolist(), group["n"].tolist(), round(target - passes * words))
    return group.assign(passes=passes, extra=extra)


def mix_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(_source, _size, n, source_size, target, passes, extra, cut, tie, short)`` from rows
    ``(_source, _size, _hash)``: each document of that source and size is taken ``passes`` times,
    and once more if its hash is at most ``cut``, as are ``short`` of those with the hash ``tie``; these
    are ``extra`` in all."""
    key = ["_source", "_size"]
    counts = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, weights, repeats).withColumnRenamed("_source", "_s")
    fitted = saved(
        counts.join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").groupBy("_source").applyInPandas(
            _fit, "_source string, _size long, n long, source_size long, target double, passes long, extra long"
        ), "mix-counts",
    )
    # the hash of the last document wanted: find the bucket in which the quota ends, rank only there
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(BUCKET_ROWS)))).cast("int")
    wanted = fitted.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n"))).select(
        F.col("_source").alias("_s"), F.col("_size").alias("_z"), "extra", bits.alias("bits")
    )
    rows = sizes.join(wanted, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))).withColumn(
        "bucket", F.expr("shiftright(_hash, 63 - bits)")
    )
    part = [*key, "extra", "bucket"]
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        rows.groupBy(*part).agg(F.count(F.lit(1)).alias("k"))
        .withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
        .filter((F.col("before") < F.col("extra")) & (F.col("before") + F.col("k") >= F.col("extra")))
        .select(F.col("_source").alias("_es"), F.col("_size").alias("_ez"), F.col("bucket").alias("_eb"), "before")
    )
    on_edge = (
        F.col("_source").eqNullSafe(F.col("_es")) & (F.col("_size") == F.col("_ez")) & (F.col("bucket") == F.col("_eb"))
    )
    so_far = Window.partitionBy(*key).orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        rows.join(edges, on_edge).groupBy(*part, "before", "_hash").agg(F.count(F.lit(1)).alias("k"))
        .withColumn("rank", F.col("before") + F.sum("k").over(so_far))
        # the buckets before the edge are wanted in any case
        .groupBy(*part).agg(F.max(F.when(F.col("rank") <= F.col("extra"), F.col("_hash"))).alias("cut"),
                            F.min("_hash").alias("first"),
                            F.min(F.when(F.col("rank") > F.col("extra"), F.struct("_hash", F.col("rank") - F.col("k")))).alias("over"))
        .select(F.col("_source").alias("_cs"), F.col("_size").alias("_cz"),
                F.coalesce("cut", F.col("first") - 1).alias("cut"), F.col("over._hash").alias("tie"),
                (F.col("extra") - F.col("over.col2")).alias("short"))
    )
    same = F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_size") == F.col("_cz"))
    full = F.when(F.col("extra") >= F.col("n"), F.lit(2**63 - 1)).when(F.col("extra") == 0, F.lit(-1))
    return fitted.join(cuts, same, "left").withColumn("cut", F.coalesce(full, "cut", F.lit(-1))).drop("_cs", "_cz")


def _keys(docs: DataFrame, seed: int) -> dict:
    # 63 bits, not negative
    return {"_source": F.col("source"), "_size": word_count(F.col("text")),
            "_hash": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)}


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.select(F.col("_source").alias("_ps"), F.col("_size").alias("_pz"), F.col("source_size").alias("_words"),
                       F.col("target").alias("_target"), "passes", "cut", "tie", "short")
    on = F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_size") == F.col("_pz"))
    more = F.when(F.col("_hash") <= F.col("cut"), 1).otherwise(0)
    planned = rows.join(plan, on)
    copies = planned.withColumn("_copies", F.col("passes") + more)
    if plan.filter("short > 0").isEmpty():
        return copies
    in_tie = F.coalesce((F.col("short") > 0) & (F.col("_hash") == F.col("tie")), F.lit(False))
    # numbered within the task that read them, after the rows of the tasks before
    tied = saved(planned.filter(in_tie).withColumn("_task", F.spark_partition_id()), "mix-ties")
    tasks = tied.groupBy("_source", "_size", "_task").agg(F.count(F.lit(1)).alias("_k"))
    order = Window.partitionBy("_source", "_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col("_source").alias("_ts"), F.col("_size").alias("_tz"), F.col("_task").alias("_tt"),
                         F.coalesce(F.sum("_k").over(order), F.lit(0)).alias("_before"))
    same = F.col("_source").eqNullSafe(F.col("_ts")) & (F.col("_size") == F.col("_tz")) & (F.col("_task") == F.col("_tt"))
    place = F.row_number().over(Window.partitionBy("_source", "_size", "_task").orderBy("_hash"))
    numbered = tied.withColumn("_place", place).join(F.broadcast(tasks), same)
    some = F.when(F.col("_before") + F.col("_place") <= F.col("short"), 1).otherwise(0)
    numbered = numbered.withColumn("_copies", F.col("passes") + some)
    return copies.filter(~in_tie).unionByName(numbered.select(*copies.columns))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    sizes = saved(docs.select("doc_id", *[c.alias(n) for n, c in _keys(docs, seed).items()]), "mix-sizes")
    plan = saved(mix_plan(sizes, weights, repeats), "mix-plan")
    return _copies(sizes, plan).select(
        "doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_words").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").cast("long").alias("copies"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mixture itself: each row of ``docs`` as many times as it is taken, columns unchanged."""
    columns = docs.columns
    keys = _keys(docs, seed)
    plan = saved(mix_plan(saved(docs.select(*[c.alias(n) for n, c in keys.items()]), "mix-sizes"), weights, repeats),
                 "mix-plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), *[c.alias(n) for n, c in keys.items()])
    taken = _copies(whole, plan).filter(F.col("_copies") > 0)
    each = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return each.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])
