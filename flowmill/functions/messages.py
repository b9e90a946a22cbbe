"""JSON events and scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions import time
from flowmill.sources.schemas import EVENT_SCHEMA, FLOW_SCHEMA, PROPERTIES

# a request's record: the flow, and the time features if the sender has them already
REQUEST_ROW = "struct<" + ",".join(
    [f"{f.name}:{f.dataType.simpleString()}" for f in FLOW_SCHEMA if f.name != "attack"]
    + ["hour:int", "dayofweek:int", "is_weekend:int", "hour_sin:double", "hour_cos:double"]
) + ">"


def encode_event(event_id: Column, unit: str = "s", label: str = "attack") -> Column:
    """Flow row as event text: ISO time, id, nested properties and label."""
    return F.to_json(
        F.struct(
            time.iso_seconds(time.to_timestamp("timestamp", unit)).alias("timestamp"),
            event_id.cast("string").alias("event_id"),
            F.struct(*PROPERTIES).alias("properties"),
            F.col(label).alias("label"),
        )
    )


def new_event_id() -> Column:
    return F.uuid()


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Flat flow rows plus ``event_id`` and ``problem``.

    ``problem`` is null for a usable event, ``unparsable`` for text that is not a JSON
    object, ``missing_field`` when the id, the time or a property is absent or of the wrong type.
    """
    parsed = F.from_json(F.col(value), EVENT_SCHEMA)
    df = messages.withColumn("_event", parsed)
    instant = F.try_to_timestamp(F.col("_event.timestamp"))  # ISO text, with or without fractions
    flat = df.select(
        *messages.columns,
        F.col("_event.event_id").alias("event_id"),
        *[F.col(f"_event.properties.{c}").alias(c) for c in PROPERTIES],
        F.unix_timestamp(instant).alias("timestamp"),
        F.col("_event.label").alias("attack"),
    )
    needed = ["event_id", "timestamp", *PROPERTIES]
    absent = F.greatest(*[F.col(c).isNull().cast("int") for c in needed]) == 1
    is_object = F.schema_of_variant(F.try_parse_json(F.col(value))).startswith("OBJECT")
    problem = F.when(absent, F.when(is_object, "missing_field").otherwise("unparsable"))
    return flat.withColumn("problem", problem)


def _keep_if(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Filter and select, written as an inline of zero or one row: a filter would be pushed
    below the parser and parse each text once per field it looks at."""
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def usable(decoded: DataFrame) -> DataFrame:
    columns = [c for c in decoded.columns if c != "problem"]
    return _keep_if(decoded, F.col("problem").isNull(), columns)


def quarantined(decoded: DataFrame, value: str = "value", carried: tuple[str, ...] = ()) -> DataFrame:
    return _keep_if(decoded, F.col("problem").isNotNull(), [*carried, value, "problem"])


def request_rows(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row per flow record of each request: ``{"data": {...}}`` or ``{"data": [{...}, ...]}``.

    A request that cannot be read gives a single row whose ``error`` says why.
    """
    keep = [c for c in requests.columns if c != body]
    # every step gets a projection of its own, so that a body is parsed and cast once
    documents = requests.select(*keep, F.try_parse_json(F.col(body)).alias("_document"))
    data = documents.select(
        *keep, F.coalesce(F.schema_of_variant("_document"), F.lit("TEXT")).alias("_kind"),
        F.try_variant_get("_document", "$.data", "variant").alias("_data"),
    )
    kinds = data.withColumn("_data_kind", F.coalesce(F.schema_of_variant("_data"), F.lit("VOID")))
    kind, data_kind, rows = F.col("_kind"), F.col("_data_kind"), F.col("_rows")
    one, many = data_kind.startswith("OBJECT"), data_kind.startswith("ARRAY")
    typed = kinds.select(
        *keep, "_kind", "_data_kind",
        F.when(one, F.array(F.try_variant_get("_data", "$", REQUEST_ROW)))
        .when(many, F.try_variant_get("_data", "$", f"array<{REQUEST_ROW}>")).alias("_rows"),
    )
    error = (
        F.when(~kind.startswith("OBJECT"), "not_an_object")
        .when(data_kind == "VOID", "missing_data")
        .when(rows.isNull() | F.exists(rows, lambda r: r.isNull()), "wrong_kind")
        .when(F.size(rows) == 0, "no_rows")
    )
    checked = typed.select(*keep, error.alias("error"), "_rows")
    read = checked.withColumn("_rows", F.when(F.col("error").isNull(), rows))
    return read.select(*keep, "error", F.posexplode_outer("_rows").alias("pos", "_row")).select(
        *keep, F.coalesce("pos", F.lit(0)).alias("pos"), "error", "_row.*"
    )
