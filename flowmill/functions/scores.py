"""Scores of the six classes under the two labelling rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowmill.functions import scalar
from flowmill.sources import schemas as S


def _flag(condition: Column) -> Column:
    """1.0 when true, 0.0 when false or unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def unit_columns() -> tuple[Column, Column, Column, Column]:
    """Packets, bytes, source port and destination port over their largest values."""
    return (
        F.col("packet_count") / S.PACKETS_MAX,
        F.col("bytes_transferred") / S.BYTES_MAX,
        F.col("src_port") / S.PORT_MAX,
        F.col("dst_port") / S.PORT_MAX,
    )


def normal_scores() -> list[Column]:
    """Baseline rule. The weights are fixed values."""
    pc, bt, sp, dp = unit_columns()
    proto = scalar.spread_category("protocol", S.PROTOCOLS)
    state = scalar.spread_category("conn_state", S.CONN_STATES)
    probe = _flag(F.col("dst_port").isin(*S.PROBE_PORTS))
    not_icmp = _flag(F.col("protocol") != "ICMP")
    return [
        1.0 - F.abs(pc - 0.3) - F.abs(bt - 0.3) + 0.2 * (1 - F.abs(proto)) + 0.1 * (1 - F.abs(state)),
        3.0 * pc * pc + 1.5 * scalar.sigmoid(proto - 0.5) + 0.5 * (1 - sp) + 0.3 * pc * proto,
        1.5 * probe + 2.0 * pc * (1 - pc) + 0.5 * dp * pc + 0.3 * dp * state,
        2.0 * state * (1 - bt) + 0.5 * (1 - dp) + 0.3 * bt * state + state * (1 - pc),
        1.5 * bt * bt + 0.5 * state * sp + 0.3 * bt * pc + 0.5 * sp * (1 - dp),
        2.0 * bt * pc + 0.5 * not_icmp + 0.3 * sp * dp,
    ]


def concept_scores() -> list[Column]:
    """Shifted rule that stands for concept drift. The weights are fixed values."""
    pc, bt, sp, dp = unit_columns()
    icmp = _flag(F.col("protocol") == "ICMP")
    low_source = _flag((F.col("src_port") % 1000) / 1000.0 < 0.2)
    probe = _flag(F.col("dst_port").isin(*S.PROBE_PORTS))
    return [
        0.8 - 0.2 * (F.abs(pc - 0.35) + F.abs(bt - 0.35)),
        4.0 * bt + 0.8 * icmp - 0.3 * pc,
        3.0 * low_source + probe,
        2.0 * icmp + _flag((bt > 0.05) & (bt < 0.2)),
        2.0 * _flag(pc > 0.7) + 1.2 * bt,
        1.5 * sp * dp + 0.7 * _flag((pc > 0.2) & (pc < 0.6)),
    ]


RULES = {"normal": (normal_scores, 0.02), "concept": (concept_scores, 0.05)}


def label(rule: str, noise_key: str | None = None, seed: int = 42) -> Column:
    """Class id with the highest score; with ``noise_key`` each score gets the rule's noise."""
    build, sigma = RULES[rule]
    scores = build()
    if noise_key is not None:
        scores = [s + scalar.normal(noise_key, f"{seed}:{k}") * sigma for k, s in enumerate(scores)]
    return scalar.argmax_of(scores)
