"""Feature sets: derive columns, fit on one table, apply the same parameters to any other."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowmill.functions import flow, time
from flowmill.operators import encode as enc
from flowmill.operators import scale as sc
from flowmill.operators import sessions, skew
from flowmill.sources import params as stored
from flowmill.sources import schemas as S
from flowmill.sources.session import pinned


# ---- base set: 14 features ------------------------------------------------

def base_columns(df: DataFrame, unit: str = "s", weekend_days: tuple[int, ...] = (5, 6)) -> DataFrame:
    """Time, log and crossed columns, in one projection. Time columns that a row brings along are
    kept and only derived where they are null."""
    derived = flow.time_columns("timestamp", unit, weekend_days)
    brought = {c: F.coalesce(F.col(c), derived[c]) for c in flow.TIME_FEATURES if c in df.columns}
    return df.withColumns(derived | brought | flow.log_columns() | {"protocol_conn": flow.protocol_conn()})


@dataclass(frozen=True)
class Fitted:
    """Encoders and scaler of a training table.

    ``encoders`` is a dictionary, or a table when the vocabulary is too large for the driver. Both
    are stored as a table.
    """

    encoders: enc.Encoders | DataFrame
    scaler: sc.Scaler

    def save(self, spark, path: str) -> None:
        stored.save(spark, self.encoders, self.scaler, path)

    @staticmethod
    def load(spark, path: str) -> "Fitted":
        params = stored.load(spark, path)
        return Fitted(params["encoders"], params["scaler"])


def fit_base(df: DataFrame, unit: str = "s", weekend_days: tuple[int, ...] = (5, 6)) -> Fitted:
    """Two scans, each reading only the columns it needs: one for all vocabularies, one for
    all statistics. The input is not cached: a second pruned scan is cheaper than keeping it."""
    derived = base_columns(df, unit, weekend_days)
    return Fitted(enc.learn_encoders(derived, S.CATEGORICAL), sc.fit_scaler(derived, S.NUMERIC))


def apply_base(
    df: DataFrame, fitted: Fitted, unit: str = "s", weekend_days: tuple[int, ...] = (5, 6),
    keep: tuple[str, ...] = (), fill: float | None = None,
) -> DataFrame:
    """Indexes, z-scores and the target if there is one, preceded by the ``keep`` columns.

    ``fill`` replaces null features; batch training tables keep them, scoring uses 0.
    """
    derived = base_columns(df, unit, weekend_days)
    scaled = sc.scale(enc.encode(derived, fitted.encoders, S.CATEGORICAL), fitted.scaler, S.NUMERIC)
    wanted = [*keep, *S.FEATURES, S.TARGET]
    out = scaled.select(*[c for c in wanted if c in scaled.columns])
    return out if fill is None else out.fillna(fill, subset=list(S.FEATURES))


# ---- extended set: 20 features with previous-event windows ----------------

def extended_columns(df: DataFrame, unit: str = "s", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    derived = base_columns(df, unit).withColumns({
        "dst_well_known": flow.well_known_flag(),
        "src_port_bucket": flow.port_bucket(),
        "pkt_per_byte": flow.packets_per_byte(),
        "session_id": flow.session_key("_"),
    })
    return sessions.session_rolling(derived, hot_rows=hot_rows)


def apply_extended(df: DataFrame, encoders: enc.Encoders | DataFrame, unit: str = "s",
                   hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """The 20 columns, with category indexes by falling frequency."""
    return enc.encode(extended_columns(df, unit, hot_rows), encoders, S.CATEGORICAL)


def fit_extended_encoders(df: DataFrame, unit: str = "s") -> enc.Encoders | DataFrame:
    # the windows do not touch the categories, so fitting leaves them out
    return enc.learn_encoders(base_columns(df, unit), S.CATEGORICAL, by="frequency")


def extended_vectors(df: DataFrame, unit: str = "s") -> DataFrame:
    """``features`` and its scaled form ``features_scaled`` for the 20 columns."""
    # the windows are computed once: their moments are taken while the rows are written
    rows = apply_extended(df, fit_extended_encoders(df, unit), unit)
    seen = Observation()
    ready = pinned(rows.observe(seen, *sc.moments(S.EXTENDED_FEATURES)), "extended")
    scaled = ready.withColumns(sc.standardised(S.EXTENDED_FEATURES, seen.get, "_z_"))
    both = sc.assemble(sc.assemble(scaled, S.EXTENDED_FEATURES), tuple(f"_z_{c}" for c in S.EXTENDED_FEATURES), "features_scaled")
    return both.drop(*[f"_z_{c}" for c in S.EXTENDED_FEATURES])


# ---- session set: 17 features with previous-event and whole-session columns

def session_columns(df: DataFrame, unit: str = "s", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """The derived columns; a table that has them already is returned as it is."""
    if set(sessions.STATISTICS) <= set(df.columns):
        return df
    ratio = flow.bytes_per_packet()
    derived = df.withColumns(
        flow.log_columns()
        | {
            "timestamp_epoch": time.epoch_seconds(time.to_timestamp("timestamp", unit)),
            "bytes_per_packet": ratio,
            "bytes_per_packet_log": F.log1p(ratio),
            "session_id": flow.session_key("-"),
        }
    )
    return sessions.session_windows(derived, fill=0.0, hot_rows=hot_rows)


SESSION_CATEGORICAL = ("protocol", "conn_state")


def fit_session(df: DataFrame, unit: str = "s", hot_rows: int = skew.HOT_ROWS) -> Fitted:
    """Encoders by value, population deviation, nulls counted as 0."""
    encoders = enc.learn_encoders(df, SESSION_CATEGORICAL)
    ready = enc.encode(session_columns(df, unit, hot_rows), encoders, SESSION_CATEGORICAL)
    scaler = sc.fit_scaler(ready, S.SESSION_FEATURES, population=True, nulls_as_zero=True)
    return Fitted(encoders, scaler)


def apply_session(
    df: DataFrame, fitted: Fitted, unit: str = "s", keep: tuple[str, ...] = (),
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    ready = enc.encode(session_columns(df, unit, hot_rows), fitted.encoders, SESSION_CATEGORICAL)
    scaled = sc.scale(ready, fitted.scaler, S.SESSION_FEATURES, nulls_as_zero=True)
    wanted = [*keep, *[f"{c}_norm" for c in S.SESSION_FEATURES], S.TARGET]
    return scaled.select(*[c for c in wanted if c in scaled.columns])


# ---- registry ---------------------------------------------------------------

@dataclass(frozen=True)
class FeatureSet:
    """A named pair: ``fit(df) -> Fitted`` and ``apply(df, fitted, **options) -> DataFrame``.

    ``derive(df)``, if given, adds the costly columns both of them need. A job that fits and
    applies on one table calls it first and keeps the result.
    """

    fit: Callable[..., Fitted]
    apply: Callable[..., DataFrame]
    columns: tuple[str, ...] = ()
    derive: Callable[..., DataFrame] | None = None


FEATURE_SETS: dict[str, FeatureSet] = {
    "base": FeatureSet(fit_base, apply_base, S.FEATURES),
    "session": FeatureSet(
        fit_session, apply_session, tuple(f"{c}_norm" for c in S.SESSION_FEATURES), session_columns
    ),
}


def register(name: str, feature_set: FeatureSet) -> None:
    """Make a feature set of one's own available to the split job by name."""
    FEATURE_SETS[name] = feature_set


def feature_set(name: str) -> FeatureSet:
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}; known: {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[name]
