"""Rule labels, class names and class-wise value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import scalar, scores
from flowmill.operators.validate import update_first_match
from flowmill.sources import schemas as S


def with_label(df: DataFrame, rule: str, out: str = S.TARGET, noise_key: str | None = None,
               seed: int = 42) -> DataFrame:
    """Set ``out`` to the class of the ``normal`` or ``concept`` rule; features stay as they are."""
    return df.withColumn(out, scores.label(rule, noise_key, seed))


def class_names(spark) -> DataFrame:
    """The six classes as a table ``(class_id, class_name)``."""
    return spark.createDataFrame(list(enumerate(S.CLASS_NAMES)), "class_id long, class_name string")


def with_class_name(df: DataFrame, column: str = S.TARGET) -> DataFrame:
    names = F.broadcast(class_names(df.sparkSession))  # six rows
    return df.join(names, df[column] == names["class_id"], "left").drop("class_id")


def with_class_id(df: DataFrame, column: str = "class_name") -> DataFrame:
    names = F.broadcast(class_names(df.sparkSession).withColumnRenamed("class_name", "_name"))
    return df.join(names, df[column] == names["_name"], "left").drop("_name")


def attack_rules(key: str = "event_id", seed: int = 42, label: str = S.TARGET) -> list[tuple[Column, dict[str, Column]]]:
    """Value ranges that go with each attack class, drawn by key. The bounds are fixed values."""

    def draw(name: str) -> Column:
        return scalar.uniform(key, f"{seed}:{name}")

    def between(name: str, low: float, high: float) -> Column:
        return F.lit(float(low)) + draw(name) * F.lit(float(high - low))

    def whole(name: str, low: int, high: int) -> Column:
        return F.floor(between(name, low, high)).cast("long")

    def one_of(name: str, values: tuple) -> Column:
        index = F.floor(draw(name) * len(values)).cast("int")
        return F.array(*[F.lit(v) for v in values])[index]

    def is_class(name: str) -> Column:
        return F.col(label) == S.CLASS_NAMES.index(name)

    return [
        (is_class("DoS"), {"packet_count": whole("packets", 1200, 2000), "protocol": one_of("protocol", ("ICMP", "UDP"))}),
        (is_class("Probe"), {"dst_port": one_of("port", S.PROBE_PORTS).cast("long"), "packet_count": whole("packets", 200, 800)}),
        (is_class("R2L"), {"conn_state": F.lit("RST"), "bytes_transferred": between("bytes", 0, 200)}),
        (is_class("U2R"), {"bytes_transferred": between("bytes", 8e5, 1.3e6), "conn_state": F.lit("EST")}),
        (is_class("Worm"), {"bytes_transferred": between("bytes", 1.5e6, 2e6), "packet_count": whole("packets", 600, 1400)}),
    ]


def apply_attack_rules(df: DataFrame, key: str = "event_id", seed: int = 42) -> DataFrame:
    return update_first_match(df, attack_rules(key, seed))


def clip_ranges(df: DataFrame) -> DataFrame:
    """Packets held to 1..2000 and bytes to 0..2e6."""
    return df.withColumns({
        "packet_count": scalar.clip(F.col("packet_count"), 1, int(S.PACKETS_MAX)).cast("long"),
        "bytes_transferred": scalar.clip(F.col("bytes_transferred"), 0.0, S.BYTES_MAX),
    })
