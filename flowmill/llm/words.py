"""Words of texts inside Arrow batches. A word is a run of bytes other than the six ASCII spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 8 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(position, texts)`` of slices without nulls of about ``limit`` bytes; a longer text is a slice of its own."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, offsets, vocabulary)``: text ``i`` has the words ``vocabulary[codes[offsets[i]:offsets[i + 1]]]``."""
    lists = pc.ascii_split_whitespace(texts)
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    nothing = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    if nothing >= 0:  # beside leading and trailing spaces
        kept = codes != nothing
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return codes, offsets, found.dictionary


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends, offsets)``: the bytes of all texts, where each word starts and ends, and the words before each text."""
    _, at, raw = texts.buffers()
    at = np.frombuffer(at, "<i4")[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    space = IS_SPACE[data]
    first, last = ~space, ~space
    edges = at[(at > 0) & (at < len(data))]
    first[1:] &= space[:-1]
    first[edges] = ~space[edges]
    last[:-1] &= space[1:]
    last[edges - 1] = ~space[edges - 1]
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)
