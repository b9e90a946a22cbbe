"""Per-session windows: previous events and whole-session statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowmill.operators import skew
from flowmill.sources.schemas import SESSION_KEYS

ORDER = ("timestamp", "event_id")
PREVIOUS_MEANS = {"prev_bytes_mean_3": "bytes_log", "prev_packet_mean_3": "packet_log"}
PREVIOUS_COUNT = {"prev_event_count_3": "packet_count"}
STATISTICS = {
    "session_bytes_max": (F.max, "bytes_log"),
    "session_bytes_min": (F.min, "bytes_log"),
    "session_packet_mean": (F.avg, "packet_log"),
}

Keys = tuple[str, ...]
# window columns for given partition and order columns
Backward = Callable[[Keys, Keys], dict[str, Column]]


def _previous_events(n: int) -> Backward:
    def build(keys: Keys, order: Keys) -> dict[str, Column]:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
        means = {out: F.avg(c).over(frame) for out, c in PREVIOUS_MEANS.items()}
        return means | {out: F.count(c).over(frame) for out, c in PREVIOUS_COUNT.items()}

    return build


def _statistic_columns(keys: Keys) -> dict[str, Column]:
    whole = Window.partitionBy(*keys)
    return {out: fn(c).over(whole) for out, (fn, c) in STATISTICS.items()}


def _backward_in_chunks(
    df: DataFrame, build: Backward, measured: Keys, n: int, keys: Keys, order: Keys,
    rows: int, chunk_rows: int,
) -> DataFrame:
    """Window columns that look back ``n`` rows, for sessions too long for one task.

    Rows are range-partitioned by session and time, so a session is cut into chunks. A chunk
    also needs the ``n`` rows before it. Those are among the last ``n`` rows of every
    (chunk, session): a table of at most ``n`` rows for each.
    """
    chunks = skew.range_chunks(df, (*keys, *order), rows, chunk_rows)
    carried = [c for c in (*order, *measured) if c not in keys]
    per_chunk = Window.partitionBy("_chunk", *keys)

    from_end = F.row_number().over(per_chunk.orderBy(*[F.desc(c) for c in order]))
    tails = (
        chunks.select("_chunk", *keys, *carried)
        .withColumn("_from_end", from_end).filter(F.col("_from_end") <= n).drop("_from_end")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk", *order).rowsBetween(-n, -1)
    halo = (
        tails.withColumn("_before", F.collect_list(F.struct(*carried)).over(before))
        .withColumn("_position", F.row_number().over(per_chunk.orderBy(*order)))
        .filter(F.col("_position") == 1)
        .select("_chunk", *keys, F.inline("_before"))
        .withColumn("_halo", F.lit(True))
    )
    padded = chunks.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    done = padded.withColumns(build(("_chunk", *keys), order))
    return done.filter(~F.col("_halo")).drop("_halo", "_chunk")


def _in_slices(df: DataFrame, build: Backward, n: int, keys: Keys, order: Keys) -> DataFrame:
    """Window columns that look back ``n`` rows, where ``_slice`` cuts the ``_hot`` sessions along their order.

    Windows inside a slice are right from its ``n + 1``-th row on. The first and last ``n`` rows of all slices of a session
    are windowed together once more: next to one another they have the same rows before them as in the session.
    Both parts read one shuffle.
    """
    by = (*keys, "_slice")
    inside = Window.partitionBy(*by)
    places = {"_nth": F.row_number().over(inside.orderBy(*order)), "_of": F.count(F.lit(1)).over(inside)}
    done = df.withColumns(build(by, order) | places)
    first, last = F.col("_nth") <= n, F.col("_nth") > F.col("_of") - n
    mended = done.filter(F.col("_hot") & (first | last)).withColumns(build(keys, order)).filter(first)
    return done.filter(~(F.col("_hot") & first)).unionByName(mended).drop("_nth", "_of")


def _with_statistics(df: DataFrame, totals_of: DataFrame, keys: Keys, n_hot: int) -> DataFrame:
    """Statistics of hot sessions: pre-aggregated, a row for each, and joined back; of others by a window."""
    totals = totals_of.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(
        *[fn(c).alias(f"_of_{out}") for out, (fn, c) in STATISTICS.items()]
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_hot"))
    windows = _statistic_columns((*keys, "_slice"))
    joined = df.withColumns(windows).join(skew.few(totals, n_hot), on, "left")
    chosen = {out: F.when(F.col("_hot"), F.col(f"_of_{out}")).otherwise(F.col(out)) for out in STATISTICS}
    return joined.withColumns(chosen).drop(*[f"_of_{c}" for c in (*keys, *STATISTICS)])


def _apply(
    df: DataFrame, build: Backward | None, measured: Keys, n: int, statistics: bool,
    keys: Keys, order: Keys, hot_rows: int,
) -> DataFrame:
    columns = build(keys, order) if build else {}
    if statistics:
        columns = columns | _statistic_columns(keys)
    along = order[0] if build and isinstance(df.schema[order[0]].dataType, NumericType) else None
    found = skew.summary(df, keys, along, hot_rows)
    if not found.hot:
        return df.withColumns(columns)
    rows = df.withColumn("_hot", found.is_hot(keys))
    if build and (along is None or found.tied):
        # no column to cut along, or one value of it fills a slice: cut by the whole order
        long, short = rows.filter("_hot"), rows.filter("NOT _hot")
        out = short.withColumns(build(keys, order)).unionByName(
            _backward_in_chunks(long, build, measured, n, keys, order, found.rows, hot_rows))
        out = out.withColumn("_slice", F.when(F.col("_hot"), _spread(order, found)).otherwise(0))
    elif build:
        cut = rows.withColumn("_slice", F.when(F.col("_hot"), found.slice(along)).otherwise(0))
        out = _in_slices(cut, build, n, keys, order)
    else:
        out = rows.withColumn("_slice", F.when(F.col("_hot"), _spread(order, found)).otherwise(0))
    if statistics:
        out = _with_statistics(out, rows.filter("_hot"), keys, len(found.hot))
    return out.drop("_hot", "_slice")


def _spread(order: Keys, found: skew.Summary) -> Column:
    return F.pmod(F.xxhash64(*order), F.lit(max(2, min(found.rows, skew.SLICES)))).cast("int")


def session_windows(
    df: DataFrame, previous: bool = True, statistics: bool = True, fill: float | None = None,
    n: int = 3, keys: Keys = SESSION_KEYS, order: Keys = ORDER, hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Add previous-event columns and/or whole-session statistics.

    Previous means and counts cover up to ``n`` earlier events of the session, the current
    one excluded; ``fill`` replaces their nulls. ``order`` must be unique within a session.
    All windows share the session partitioning, so rows are shuffled once. One scan of the keys and of the first
    column of ``order`` comes before: sessions that it shows to have more than ``hot_rows`` rows are cut into slices of
    their order, and their statistics are pre-aggregated from their rows. ``order`` may begin with a column that is no
    number, or has one value in as many rows; such sessions' rows are written to the shared folder on the way.
    """
    measured = tuple(sorted({*PREVIOUS_MEANS.values(), *PREVIOUS_COUNT.values()}))
    build = _previous_events(n) if previous else None
    out = _apply(df, build, measured, n, statistics, keys, order, hot_rows)
    if fill is not None and previous:
        out = out.fillna(fill, subset=[*PREVIOUS_MEANS, *PREVIOUS_COUNT])
    return out


def session_rolling(df: DataFrame, fill: float | None = None, **options) -> DataFrame:
    return session_windows(df, statistics=False, fill=fill, **options)


def session_stats(df: DataFrame, **options) -> DataFrame:
    return session_windows(df, previous=False, **options)


def session_lag(
    df: DataFrame, column: str, out: str, keys: Keys = SESSION_KEYS, order: Keys = ORDER,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Value of the session's preceding event, null for the first."""

    def build(by: Keys, along: Keys) -> dict[str, Column]:
        return {out: F.lag(column, 1).over(Window.partitionBy(*by).orderBy(*along))}

    return _apply(df, build, (column,), 1, False, keys, order, hot_rows)
