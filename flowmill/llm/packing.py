"""Packing without crossing documents: every document is cut into power-of-two pieces.

A document of ``n`` tokens gives ``n // longest`` pieces of the longest length and one piece for each
binary digit of the rest, longest first. Each piece is a sequence of its own; sequences of equal
length form a bucket, so that a batch taken from one bucket needs no padding at all.

Defined cases: a null or empty text is the end token alone; repeated rows are packed once per row.
``sequence_id`` is unique. Only ``doc_id`` is kept of the other columns. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import tokens

LONGEST = 2048
END_ID = 1
PIECES_PER_BATCH = 20_000


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length)`` of the pieces of documents of these sizes, in order."""
    whole, rest = sizes // longest, sizes % longest
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    doc, bit = np.nonzero(rest[:, None] & bits)
    length = bits[bit]
    start = (sizes - rest)[doc] + (rest[doc] & -(2 * length))  # what the longer digits take
    first = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    doc, start = np.concatenate((np.repeat(np.arange(len(sizes)), whole), doc)), np.concatenate((first * longest, start))
    length = np.concatenate((np.full(len(first), longest), length))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset)`` per piece; ``ids`` are
    little-endian unsigned 32-bit numbers and ``bucket`` is the binary logarithm of the length."""
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, offsets in tokens.encoded_chunks(batch.column(1), tokenizer_path):
                # one buffer of all ids, an end token after each document's
                raw = np.insert(ids, offsets[1:], end_id).astype("<u4", copy=False)
                sizes = np.diff(offsets) + 1
                doc, start, length = pieces_of(sizes, longest)
                before = np.cumsum(sizes) - sizes
                for a in range(0, len(doc), PIECES_PER_BATCH):
                    z = min(len(doc), a + PIECES_PER_BATCH)
                    first = int(before[doc[a]] + start[a])
                    ends = np.concatenate(([0], np.cumsum(length[a:z]))) * 4
                    cuts = pa.BinaryArray.from_buffers(pa.binary(), z - a, [
                        None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(raw[first:first + int(ends[-1]) // 4])])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(doc[a:z] + at)), pa.array(start[a:z]), pa.array(length[a:z]), cuts, pa.array(sizes[doc[a:z]]),
                    ], schema=schema)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )
    return pieces.withColumns({
        "bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per length, so a reader takes batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
