"""Previous-event features of sessions on a stream.

For each session the last ``n`` events are kept as state, together with the place of the last one. Inside a micro-batch the
events of a session are taken in the order of time, then event id. An event that comes behind the last place of its
session is late: it gets the features of the events kept then, is marked as late, and changes no state. On input that
comes in order the features are those of the batch windows.

The state holds a short entry per session that has been seen, and stays, in one row per bucket of sessions: keep it on disk
(:func:`flowmill.streaming.events.keep_state_on_disk`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowmill.operators.sessions import ORDER, PREVIOUS_COUNT, PREVIOUS_MEANS
from flowmill.sources.schemas import SESSION_KEYS

SESSION, BUCKET = "_session", "_session_bucket"
BUCKETS = 256
FEATURES = "prev_bytes_mean_3 double, prev_packet_mean_3 double, prev_event_count_3 long, late boolean"


def _mean(values: list) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def session_features(flows: DataFrame, keys: tuple[str, ...] = SESSION_KEYS, order: tuple[str, str] = ORDER, n: int = 3,
                     buckets: int = BUCKETS) -> DataFrame:
    """``flows`` (a stream with ``bytes_log``, ``packet_log`` and ``packet_count``) with :data:`FEATURES`.

    Sessions go to ``buckets`` groups by the hash of their keys, and a group's state holds its sessions: a call per group
    and micro-batch, not per session."""
    measured = [*PREVIOUS_MEANS.values(), *PREVIOUS_COUNT.values()]
    columns = flows.columns
    types = dict(flows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{SESSION}` string, " + FEATURES
    kept = f"sessions array<string>, events array<array<array<double>>>, at array<{types[order[0]]}>, then array<{types[order[1]]}>"

    def follow(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {}
        if state.exists:
            for session, events, at, then in zip(*state.get):
                known[session] = ([list(e) for e in events], at, then)
        # the events of a group's sessions in one micro-batch; Arrow gives them in parts
        rows = pd.concat(list(frames)).sort_values([SESSION, *order], kind="stable")[[*columns, SESSION]]
        values = [[None if pd.isna(v) else float(v) for v in row] for row in rows[measured].itertuples(index=False)]
        found = []
        for session, place, row in zip(rows[SESSION].tolist(), zip(*(rows[c].tolist() for c in order)), values):
            events, *last = known.get(session, ([], None, None))
            late = last[0] is not None and place < tuple(last)
            *means, counted = zip(*events) if events else [[]] * len(measured)
            found.append((*map(_mean, means), sum(v is not None for v in counted), late))
            if not late:
                known[session] = ((events + [row])[-n:], *place)
        state.update(tuple(map(list, zip(*((s, *v) for s, v in known.items())))))
        names = [*PREVIOUS_MEANS, *PREVIOUS_COUNT, "late"]
        yield rows.reset_index(drop=True).join(pd.DataFrame(found, columns=names))

    keyed = flows.withColumn(SESSION, F.to_json(F.struct(*keys))).withColumn(BUCKET, F.pmod(F.xxhash64(SESSION), F.lit(buckets)))
    found = keyed.groupBy(BUCKET).applyInPandasWithState(follow, schema, kept, "append", GroupStateTimeout.NoTimeout)
    return found.drop(SESSION)
