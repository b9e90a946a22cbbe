"""Token counts from flat token files that have no index.

A token file is a run of fixed-width numbers in which every document ends with one separator. Files
are read in blocks of equal size, each block anywhere on the cluster; a block finds its separators with
one vectorised comparison. Documents that cross blocks are stitched by a prefix scan over block
summaries, in two levels, so no task scans a whole large file.

Defined cases: tokens after a file's last separator are one more document, not terminated; two
neighbouring separators enclose a document of 0 tokens; a file without tokens has no documents. When
writing, a null text counts as empty and each row, repeated or not, is a document. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import saved
from flowmill.sources.session import new_dir

BLOCK_TOKENS = 1 << 20
SUPER_BLOCKS = 1024
END_ID = 50_256
WIDTHS = {2: "<u2", 4: "<u4"}

_encoders: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_token_files(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Writes one token file per task; returns ``(path, ordinal, doc_id, n_bytes)``, a row per document;
    ``n_bytes`` is the length of its file. A task that runs again leaves at most an unlisted file."""
    folder = new_dir(docs.sparkSession, "tokens")
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids, size = None, [], 0
        name = f"{folder}/{uuid.uuid4().hex}.bin"
        encoder = _encoder(ranks_path, pattern)
        end = np.array([end_id], WIDTHS[width]).tobytes()
        for batch in batches:
            if out is None and batch.num_rows:
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None)
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                data = encoder.encode_to_numpy(text, disallowed_special=()).astype(WIDTHS[width]).tobytes() + end
                out.write(data)
                size += len(data)
            ids.append(batch.column(0))
        if out is not None:
            out.close()
            found = pa.concat_arrays(ids)
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), found, pa.array([size] * n, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(write, "path string, ordinal long, doc_id long, n_bytes long"), "token-files")


def _blocks(files: DataFrame, end_id: int, width: int, block_tokens: int) -> DataFrame:
    """``(path, block, n, last, ends)``: positions of the separators of each block."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    raw = file.read_at(block_tokens * width, block * block_tokens * width)
                ends = np.flatnonzero(np.frombuffer(raw, WIDTHS[width]) == end_id) + block * block_tokens
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([
                    pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()),
                    pa.array([ends], pa.list_(pa.int64())),
                ], schema=schema)

    n_blocks = F.ceil(F.col("n_tokens") / block_tokens)
    each = files.filter("n_tokens > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    spread = each.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return saved(spread.mapInArrow(scan, "path string, block long, n long, last long, ends array<long>"), "token-blocks")


def _before(df: DataFrame, keys: list[str], order: str, names: tuple[str, str]) -> DataFrame:
    """Adds the number of separators before each row and the last one's position."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({names[0]: F.coalesce(F.sum("n").over(w), F.lit(0)), names[1]: F.max("last").over(w)})


def scan_token_files(files: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS,
                     super_blocks: int = SUPER_BLOCKS) -> DataFrame:
    """``(path, ordinal, start, n_tokens, terminated)`` of every document in the files ``(path, n_bytes)``."""
    files = files.select("path", (F.col("n_bytes") / width).cast("long").alias("n_tokens"))
    blocks = _blocks(files, end_id, width, block_tokens).withColumn("super", F.floor(F.col("block") / super_blocks))
    upper = blocks.groupBy("path", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    upper = _before(upper, ["path"], "super", ("n_above", "last_above")).select("path", "super", "n_above", "last_above")
    inside = _before(blocks, ["path", "super"], "block", ("n_before", "last_before")).join(upper, ["path", "super"])
    # positions only rise, so the later of two separators is the larger one
    carried = F.coalesce(F.greatest("last_before", "last_above"), F.lit(-1).cast("long"))
    stitched = inside.select("path", (F.col("n_above") + F.col("n_before")).alias("first"), "ends", carried.alias("carried"))
    before = F.concat(F.array("carried"), F.col("ends"))
    found = stitched.withColumn("starts", before).select("path", "first", F.posexplode(F.arrays_zip("starts", "ends")))
    terminated = found.filter(F.col("col.ends").isNotNull()).select(
        "path", (F.col("first") + F.col("pos")).alias("ordinal"), (F.col("col.starts") + 1).alias("start"),
        (F.col("col.ends") - F.col("col.starts") - 1).alias("n_tokens"), F.lit(True).alias("terminated"),
    )
    totals = blocks.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    tails = files.join(totals, "path").filter(F.col("n_tokens") > F.col("start")).select(
        "path", "ordinal", "start", (F.col("n_tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated")
    )
    return terminated.unionByName(tails)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document, counted in the token files written from them."""
    rows = write_token_files(docs, ranks_path, pattern)
    files = saved(rows.select("path", "n_bytes").distinct(), "token-paths")
    return scan_token_files(files).join(rows, ["path", "ordinal"]).select("doc_id", "n_tokens")
