"""Periodic runs of words by a dictionary of basic factors.

For each power of two ``L`` every stretch of ``L`` words gets a name; equal stretches of one document have
equal names. Names of length ``2 L`` come from pairs of names of length ``L``. Where a name's next
occurrence is ``p`` words on, ``p`` at most ``L``, the text repeats with period ``p`` there; neighbouring
starts with the same ``p`` are one arithmetic progression's, and together they span the whole run. Each period
is looked for at one length only, ``L / 2 < p <= L``, so that no run is found twice: a stretch of ``L >= p`` words
recurs inside a run at multiples of its smallest period alone, so the next occurrence gives that period.

A stretch that does not recur within a third of its document's words cannot lie in a run of three periods;
it is left out at greater lengths, so ordinary prose is nearly done after lengths 1 and 2.

Documents are independent: the job has no shuffle and works on slices of some megabytes of text.

Defined cases: a null text has no words; null, repeated or clashing ids matter to :func:`rewritten` only, which
leaves documents with a null id as they are; repeated rows each give their result. Of the other columns none is
kept. An empty table gives an empty result. A document must fit in a worker's memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import words

MIN_WORDS = 24
MIN_PERIODS = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(codes: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, by start, then period; ``start`` counts from the first word of all.

    A run has at least ``min_words`` words and ``min_periods`` (three or more) times its smallest period; of two
    periods only, it might be too short to hold a stretch of ``L`` words and its next occurrence.
    """
    if min_periods < 3:
        raise ValueError("a run needs three periods")
    sizes = np.diff(offsets)
    document = np.repeat(np.arange(len(sizes)), sizes)
    reach = (sizes // min_periods)[document]  # the longest period a run of that document can have
    at = np.arange(len(codes))
    name = document * (int(codes.max(initial=0)) + 1) + codes
    found, size, longest = [], 1, int(reach.max(initial=0))
    while len(at) and size < 2 * longest:
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        here, there = order[:-1][same], order[1:][same]
        gap = at[there] - at[here]
        near = gap <= reach[at[here]]
        here, there, gap = here[near], there[near], gap[near]
        period = np.zeros(len(at), np.int64)
        fits = (gap <= size) & (2 * gap > size)
        period[here[fits]] = gap[fits]
        found.append(_merged(at, period, size))
        dense = np.empty(len(at), np.int64)
        dense[order] = np.concatenate(([0], np.cumsum(~same)))
        recurs = np.zeros(len(at), bool)
        recurs[here] = recurs[there] = True
        at, dense = at[recurs], dense[recurs]
        half = np.searchsorted(at, at + size)
        whole = half < len(at)
        whole[whole] = at[half[whole]] == at[whole] + size
        name = dense[whole] * (int(dense.max(initial=0)) + 1) + dense[half[whole]]
        at, size = at[whole], 2 * size
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[rows[:, 1] >= np.maximum(min_words, min_periods * rows[:, 2])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _merged(at: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
    """Neighbouring starts with one period as one stretch ``(start, length, period)``."""
    at, period = at[period > 0], period[period > 0]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])))
    firsts = np.flatnonzero(new)
    lasts = np.concatenate((firsts[1:], [len(at)])) - 1
    return np.column_stack((at[firsts], at[lasts] - at[firsts] + size + period[firsts], period[firsts]))


def _rewrite(codes: np.ndarray, offsets: np.ndarray, ids: list) -> set[int]:
    """Make the ends of some documents periodic, in place; returns their positions."""
    changed = set()
    for i, doc_id in enumerate(ids):
        n = int(offsets[i + 1] - offsets[i])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            first = int(offsets[i]) + a
            codes[first:offsets[i + 1]] = codes[first + np.arange(n - a) % p]
            changed.add(i)
    return changed


def find(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, rewrite: bool = False) -> DataFrame:
    """``(doc_id, runs, collapsed)``: every run of each text, and its words without those that a run has after
    its first period, joined by one space. ``rewrite`` first makes the ends of some texts periodic (by a hash of the id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.chunks(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                codes, offsets, vocabulary = words.coded(texts)
                codes = codes.copy()
                changed = _rewrite(codes, offsets, ids.to_pylist()) if rewrite else set()
                rows = runs(codes, offsets, min_words, min_periods)
                owner = np.searchsorted(offsets, rows[:, 0], "right") - 1
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                turns = np.zeros(len(codes) + 1, np.int64)
                np.add.at(turns, rows[:, 0] + rows[:, 2], 1)
                np.add.at(turns, rows[:, 0] + rows[:, 1], -1)
                kept = np.cumsum(turns[:-1]) == 0
                listed = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(rows[:, 0] - offsets[owner]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], fields=list(RUN)))
                collapsed = []
                for i, text in enumerate(texts.to_pylist()):
                    a, b = offsets[i], offsets[i + 1]
                    if i in changed:
                        collapsed.append(" ".join(vocabulary.take(pa.array(codes[a:b][kept[a:b]])).to_pylist()))
                        continue
                    said = text.encode().split()
                    if edges[i] < edges[i + 1]:
                        said = compress(said, kept[a:b].tolist())
                    collapsed.append(b" ".join(said).decode())
                yield pa.RecordBatch.from_arrays([ids, listed, pa.array(collapsed, pa.string())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def report(docs: DataFrame, **params) -> DataFrame:
    """Per document the number of runs, the one with the greatest exponent, and digests of all runs and of what is kept."""
    found = find(docs, **params)
    # a / p > b / q exactly when a * q > b * p; runs come by start, then period, so the first of equal ones stays
    better = lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    picked = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                          F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return picked.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                         F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
