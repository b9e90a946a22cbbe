"""Column contracts and row rules."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.sources import schemas as S


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``df`` itself, or an error that names every missing column. Extra columns are allowed."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_model_input(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    return require_columns(df, (*S.FEATURES, target))


def column_report(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows ``(column, required, present, non_null)`` over required and actual columns."""
    names = sorted({*required, *df.columns})
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entry = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(int(c in required)).alias("required"),
            F.lit(int(c in df.columns)).alias("present"),
            (F.col(c) if c in df.columns else F.lit(0).cast("long")).alias("non_null"),
        )
        for c in names
    ]
    return counts.select(F.inline(F.array(*entry)))


@dataclass(frozen=True)
class Rule:
    """What a value must be: present, inside a range, one of a list."""

    column: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()

    def broken(self) -> Column:
        c = F.col(self.column)
        bad = c.isNull()
        if self.low is not None:
            bad = bad | (c < self.low)
        if self.high is not None:
            bad = bad | (c > self.high)
        if self.values:
            bad = bad | ~c.isin(*self.values)
        return F.coalesce(bad, F.lit(True))


# fixed values: ranges and value lists of the flow columns
FLOW_RULES = (
    Rule("src_port", 1024, 65535),
    Rule("dst_port", 1, 65535),
    Rule("protocol", values=S.PROTOCOLS),
    Rule("packet_count", 1, 2000),
    Rule("conn_state", values=S.CONN_STATES),
    Rule("bytes_transferred", 0.0, 2e6),
    Rule("timestamp"),
)


def check_rows(df: DataFrame, rules: tuple[Rule, ...] = FLOW_RULES) -> DataFrame:
    """Add ``violations`` (names of the broken columns, in rule order) and ``valid``."""
    broken = F.array(*[F.when(r.broken(), r.column) for r in rules])
    named = df.withColumn("violations", F.array_compact(broken))
    return named.withColumn("valid", F.size("violations") == 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid rows, rejected rows)``."""
    return checked.filter("valid"), checked.filter("NOT valid")


def update_first_match(df: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Replace columns of the rows a rule applies to; the first rule that matches a row wins."""
    matches = [c for c, _ in rules]
    number = reduce(lambda acc, im: acc.when(im[1], im[0]), list(enumerate(matches))[1:], F.when(matches[0], 0))
    changed = sorted({c for _, updates in rules for c in updates})
    numbered = df.withColumn("_rule", number)
    updated = {}
    for c in changed:
        branches = [(F.col("_rule") == i, u[c]) for i, (_, u) in enumerate(rules) if c in u]
        chain = reduce(lambda acc, b: acc.when(*b), branches[1:], F.when(*branches[0]))
        updated[c] = chain.otherwise(F.col(c))
    return numbered.withColumns(updated).drop("_rule")
