"""Web archives whose repeated payloads are revisit records.

Only headers (id, digest, length) are shuffled by payload digest to find the first page of every
payload. Each task then writes archives of its own, one gzip member per record, into the shared
folder; a table of the files that finished tasks wrote is what a reader follows, so a task that
runs again leaves at most an unlisted file. Reading measures and
hashes every response's payload against its headers and joins revisit records to their responses by
digest.

Defined cases: a null html is an empty payload. Payloads below ``MIN_BYTES`` are never revisits.
Rows that repeat the smallest ``page_id`` of a payload are all responses; a null ``page_id`` counts
as the largest, and if a payload has no other id, its records are all responses. A null url is
written as empty. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import saved
from flowmill.sources.session import new_dir

MIN_BYTES = 100
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no time of capture
RECORD_ID = re.compile(r"<urn:page:(-?\d+|none)>")
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("refers_to_record", pa.int64()), ("payload", pa.binary()),
])


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` as ``(page_id, url, payload, digest, first_id)``; ``first_id`` is the page which a
    revisit refers to, null for responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n")
    )
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("first_id")
    )


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, first_id) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first_id is None else http
    url = re.sub(r"\s", "", url or "")  # a line break would end the header
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if first_id is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first_id)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(resolved: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records; returns the written files as ``(path, records, bytes)``."""
    folder = new_dir(resolved.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        done = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _member(record(*row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d)) for d in done], schema=pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]
        ))

    return saved(resolved.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


def _headers(stream) -> dict[str, str]:
    found = {}
    while line := stream.readline().strip():
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def parse_archive(stream) -> Iterator[dict]:
    """Records of one decompressed archive. Raises where a response's payload differs from its headers."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        head = _headers(stream)
        block = stream.read(int(head["content-length"]))
        http, _, body = block.partition(b"\r\n\r\n")
        full = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        ids = [RECORD_ID.fullmatch(head.get(k, "")) for k in ("warc-record-id", "warc-refers-to")]
        page_id, refers_to = (int(m[1]) if m and m[1] != "none" else None for m in ids)
        digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(full[1]) if full else len(body)
        if head["warc-type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
            raise ValueError(f"{head.get('warc-record-id')}: payload of {len(body)} bytes is not that of its headers, {size} bytes, {digest}")
        yield {
            "page_id": page_id, "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "payload_digest": digest, "payload_bytes": size, "refers_to_record": refers_to, "payload": body,
        }


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """Rows of ``RECORDS`` from the archives listed in column ``path``; a task reads whole archives."""
    schema = RECORDS if payload else RECORDS.remove(RECORDS.get_field_index("payload"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as raw:
                    rows, size = [], 0
                    for r in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                        size += len(r["payload"]) if payload else 0
                        rows.append({k: r[k] for k in schema.names})
                        if size > 1 << 24 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    ddl = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)
    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, ddl)


def join_revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``refers_to``: for a revisit, the page of the response with its payload digest."""
    responses = records.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    original = responses.groupBy("payload_digest").agg(F.min("page_id").alias("original"))
    revisited = records.filter(F.col("record_type") == "revisit").select("payload_digest").distinct()
    original = original.join(revisited, "payload_digest", "left_semi")
    refers = F.when(F.col("record_type") == "revisit", F.col("original"))
    return records.join(original, "payload_digest", "left").withColumn("refers_to", refers).drop("original")
