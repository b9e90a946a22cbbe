"""Repeated passages removed by counting windows of words in super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the smallest, by hash, of its stretches of ``mer``
words; consecutive windows with the same minimiser form a super-k-mer, which travels as one packed string to
the minimiser's bucket. Equal windows have equal minimisers, so they meet in one bucket; there a sort of
the windows' hashes brings equal ones together, and their words are compared. Hashes only say where a window goes
and what is compared; no result rests on one.

How large a bucket gets:

* Stretches that are very frequent come last in the order. They are counted beforehand, all of
  them, in a fixed number of counters (65,536 to 4,194,304, by the size of the input); a counter far above the mean
  marks its stretches as frequent. A window of such stretches only goes by its own hash, alone.
* Equal super-k-mers of a batch travel once; the later ones are known to be repeats and are marked at once.
* The number of buckets grows with the text. One that is too large nevertheless is counted in parts by a hash of the
  minimiser; its strings stay compressed until their part is due.

A task sends a bucket all its super-k-mers as one compressed row, so Spark moves some thousands of large rows.
Marks go back to their documents by (id, digest of the text).

Defined cases: documents come in the order of their ids, null ids last, rows with one id by a digest of their
texts. Rows with the same id and text are one document: each gets the same result, none makes the other a repeat. A
null text has no words. Extra columns are not returned. An empty table gives an empty result. A document is cut into
super-k-mers inside one task and must fit in a worker's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import words

WINDOW = 20
MER = 3
LONGEST = 256  # windows of a super-k-mer, so that a monotonous text is cut as well
COUNTERS = (16, 22)  # binary logarithm of their number, at least and at most
HOT_MERS = 20_000  # a counter below this is never frequent
HOT_TIMES = 4  # nor one below that many times the mean
BUCKET_BYTES, PART_BYTES = 12 << 20, 20 << 20  # super-k-mers of a bucket as a rule, and of a part at most
SLOT = 4096
MIXERS = tuple(np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
BLOCK = 1 << 20
CODEC, LEVEL = "zstd", 5
CUT_BYTES = 4 << 20  # text that is cut at a time
SENT_BYTES = 12 << 20  # text whose super-k-mers travel together


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIXERS[0]
    x = (x ^ (x >> np.uint64(27))) * MIXERS[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over blocks of bytes that begin and end with words."""
    base = 0x2545F4914F6CDD1D
    out, at = np.empty(len(starts), np.uint64), 0
    size = min(BLOCK, len(data)) + 1
    up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first, last = int(starts[at]), int(ends[end - 1])
        if last - first >= len(up):  # a single word of more than a block
            up, down = _powers(base, last - first + 1), _powers(pow(base, -1, 1 << 64), last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[:last - first], out=sums[1:])
        a, b = starts[at:end] - first, ends[at:end] - first
        out[at:end] = (sums[b] - sums[a]) * down[a]
        at = end
    return _mix(out)


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each stretch of ``size`` neighbours, built from stretches of powers of two."""
    out, covered, step, at = None, 0, hashes, 1
    while True:
        if size & at:
            n = len(hashes) - covered - at + 1
            out = step if out is None else _mix(out[:n] * MIXERS[2] + step[covered:covered + n])
            covered += at
        at *= 2
        if at > size:
            return out
        step = _mix(step[:len(step) - at // 2] * MIXERS[2] + step[at // 2:])


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    at = 1
    while 2 * at <= size:
        values = np.minimum(values[:-at], values[at:])
        at *= 2
    return np.minimum(values[:len(values) - (size - at)], values[size - at:]) if at < size else values


def _whole(offsets: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` words from each word on lie in its document."""
    return np.arange(offsets[-1]) + size <= np.repeat(offsets[1:], np.diff(offsets))


def counter_bits(text_bytes: int) -> int:
    return min(max(math.ceil(math.log2(text_bytes / 12_288 + 1)), COUNTERS[0]), COUNTERS[1])


def frequent_mers(docs: DataFrame, bits: int, mer: int = MER, hot_mers: int = HOT_MERS) -> np.ndarray:
    """For each of ``2 ** bits`` counters, whether the stretches of words that fall into it are frequent."""
    shift, slot = np.uint64(64 - bits), min(SLOT, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, texts in words.chunks(batch.column(0)):
                data, starts, ends, offsets = words.bounds(texts)
                if len(starts) >= mer:
                    mers = _joined(word_hashes(data, starts, ends), mer)[_whole(offsets, mer)[:len(starts) - mer + 1]]
                    counts += np.bincount((mers >> shift).astype(np.int64), minlength=1 << bits)
        parts = counts.astype("<i8").reshape(-1, slot)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), "<i8")
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "counts"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "slot int, counts binary")
    total = np.zeros((1 << bits) // slot * slot, np.int64)
    for r in parts.repartition("slot").mapInArrow(add, "slot int, counts binary").toLocalIterator():  # as many numbers as counters
        total[r["slot"] * slot:(r["slot"] + 1) * slot] = np.frombuffer(r["counts"], "<i8")
    return total > max(hot_mers, HOT_TIMES * total.mean())


def _cut(texts: pa.Array, hot: np.ndarray, window: int, mer: int):
    """``(row, start, n windows, key)`` of each super-k-mer, and its first and last byte, for texts of one slice."""
    data, starts, ends, offsets = words.bounds(texts)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return data, none, none, none, none.astype(np.uint64), none, none
    hashes = word_hashes(data, starts, ends)
    mers = _joined(hashes, mer)
    late = np.unpackbits(hot)[(mers >> np.uint64(64 - int(math.log2(len(hot) * 8)))).astype(np.int64)]
    order = (mers >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))
    key = _least(order, window - mer + 1)
    valid = _whole(offsets, window)[:len(key)]
    alone = np.flatnonzero(valid & (key >> np.uint64(63) > 0))
    if len(alone):
        key[alone] = _joined(hashes, window)[alone] | np.uint64(1 << 63)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    # windows of a run: up to the next run's first, less what is not valid between
    upto = np.concatenate(([0], np.cumsum(valid)))
    count = np.diff(np.append(upto[first], upto[-1]))
    parts = -(-count // LONGEST)
    first, key = np.repeat(first, parts), np.repeat(key[first], parts)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(np.repeat(count, parts) - nth * LONGEST, LONGEST)
    first = first + nth * LONGEST
    row = np.searchsorted(offsets, first, "right") - 1
    return data, row, first - offsets[row], count, key, starts[first], ends[first + count + window - 2]


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """The place of each row in the order of ``columns``, most important last; equal rows share one."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _repeats(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first of its group at all, is a repeat)``: a repeat comes later than its group's first place."""
    order = np.lexsort((place, group))
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    least = place[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    head, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    head[order], later[order] = new, place[order] > least
    return head, later


def _marks(ids: pa.Array, digests: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, buckets: int = 1) -> pa.RecordBatch:
    """Repeated windows ``start`` to ``start + count - 1`` of documents, both in one number; neighbouring stretches become one.

    They are dealt to all buckets alike.
    """
    order = np.lexsort((start, row))
    row, start, count = row[order], start[order], count[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])
    heads = np.flatnonzero(new)
    row, mark = row[heads], start[heads] << 32 | np.add.reduceat(count, heads)
    return pa.RecordBatch.from_arrays([
        pa.array((np.arange(len(row)) % buckets).astype(np.int32)), pa.nulls(len(row), pa.binary()), ids.take(pa.array(row)), pa.array(digests[row]), pa.array(mark),
    ], ["bucket", "packed", "doc_id", "digest", "mark"])


SENT = "bucket int, packed binary, doc_id long, digest long, mark long"


def _pack(pieces: list[bytes], columns: dict[str, np.ndarray], ids: pa.Array, digests: np.ndarray) -> bytes:
    """Super-k-mers and the documents they come from as one compressed string."""
    used, rows = np.unique(columns["row"], return_inverse=True)
    columns["row"] = np.diff(rows, prepend=0)  # they rise nearly always
    raw = [np.array([len(columns["row"]), len(used)], "<i8"), *(columns[c].astype(t) for c, t in LAYOUT)]
    id_rows = ids.take(pa.array(used))
    raw += [id_rows.fill_null(0).to_numpy().astype("<i8"), id_rows.is_null().to_numpy(zero_copy_only=False).astype("u1"), digests[used].astype("<i8")]
    blob = b"".join([*(r.tobytes() for r in raw), *pieces])
    return len(blob).to_bytes(8, "little") + pa.Codec(CODEC, compression_level=LEVEL).compress(blob, asbytes=True)


LAYOUT = (("row", "<i4"), ("start", "<i4"), ("count", "<i2"), ("part", "u1"))


def _unpack(packed: bytes):
    blob = pa.Codec(CODEC).decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    n, m = np.frombuffer(blob, "<i8", 2).tolist()
    at, columns = 16, {}
    for name, kind, size in [*((c, t, n) for c, t in LAYOUT), ("id", "<i8", m), ("null", "u1", m), ("digest", "<i8", m)]:
        columns[name] = np.frombuffer(blob, kind, size, at)
        at += columns[name].nbytes
    columns["row"] = np.cumsum(columns["row"], dtype=np.int64)
    return columns, memoryview(blob)[at:]


def _sent(batch: pa.RecordBatch, hot: np.ndarray, buckets: int, window: int, mer: int) -> Iterator[pa.RecordBatch]:
    """Marks of what repeats inside the batch ``(id, digest, text)``, and the rest packed for each bucket."""
    ids, digests = batch.column(0), batch.column(1).to_numpy()
    document = _ranks(digests, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
    pieces, found = [], []
    for at, texts in words.chunks(batch.column(2), CUT_BYTES):
        data, row, start, count, key, a, b = _cut(texts, hot, window, mer)
        raw = data.tobytes()
        pieces += [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]
        found.append((row + at, start, count, key))
    if not pieces:
        return
    row, start, count, key = (np.concatenate(c) for c in zip(*found))
    del found
    number: dict[bytes, int] = {}
    same = np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.int64, len(pieces))
    del number
    head, later = _repeats(same, document[row] * (1 << 32) + start)
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    if later.any():
        yield _marks(ids, digests, row[later], start[later], count[later], buckets)
    head = np.flatnonzero(head)
    head = head[np.argsort(bucket[head], kind="stable")]
    for part in np.split(head, np.flatnonzero(np.diff(bucket[head])) + 1):
        texts = [pieces[i] + b"\n" for i in part.tolist()]
        columns = {"row": row[part], "start": start[part], "count": count[part], "part": key[part] // np.uint64(buckets) & np.uint64(255)}
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[part[:1]], pa.int32()), pa.array([_pack(texts, columns, ids, digests)], pa.binary()),
            pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["bucket", "packed", "doc_id", "digest", "mark"])


def super_kmers(docs: DataFrame, hot: np.ndarray, buckets: int, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """Rows ``SENT``: all super-k-mers of a batch for a bucket, packed, or marks of repeats seen already."""
    bits = np.packbits(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.chunks(batch.column(2), SENT_BYTES):
                yield from _sent(batch.slice(at, len(texts)), bits, buckets, window, mer)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SENT)


def digest():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _equal_windows(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(chosen, group)``: those of the windows at ``at`` that have an equal one, and a number equal windows share."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    many = np.zeros(len(order), bool)
    many[1:] = same
    many[:-1] |= same
    chosen, group = order[many], group[many]
    inside, step = np.arange(window), max(1, BLOCK // window)
    wrong = []
    pairs = np.flatnonzero(group[1:] == group[:-1])
    for i in range(0, len(pairs), step):
        p = pairs[i:i + step]
        unequal = (codes[at[chosen[p]][:, None] + inside] != codes[at[chosen[p + 1]][:, None] + inside]).any(axis=1)
        wrong.append(group[p[unequal]])
    wrong = np.unique(np.concatenate(wrong)) if wrong else np.zeros(0, np.int64)
    if len(wrong):  # different windows with one hash: number these by their words
        odd = np.isin(group, wrong)
        _, number = np.unique(codes[at[chosen[odd]][:, None] + inside], axis=0, return_inverse=True)
        group = group.copy()
        group[odd] = len(at) + number.ravel()
    return chosen, group


def _count_bucket(blobs: list[bytes], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Marks of the windows of a bucket that repeat earlier ones."""
    parts = min(256, -(-sum(int.from_bytes(b[:8], "little") for b in blobs) // limit))
    for part in range(parts):
        yield from _count_part(blobs, window, part, parts)


def _count_part(blobs: list[bytes], window: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    texts, found, documents, before = [], [], [], 0
    for blob in blobs:
        columns, raw = _unpack(blob)
        if parts > 1:
            mine = columns["part"] % parts == part
            _, starts, ends, _ = words.bounds(pa.array([bytes(raw)], pa.binary()))
            after = np.cumsum(columns["count"].astype(np.int64) + window - 1)
            upto = np.concatenate(([0], after[:-1]))
            texts += [bytes(raw[a:b]) + b"\n" for a, b in zip(starts[upto[mine]].tolist(), ends[after[mine] - 1].tolist())]
        else:
            mine = slice(None)
            texts.append(raw)
        found.append([columns["row"][mine] + before, columns["start"][mine].astype(np.int64), columns["count"][mine].astype(np.int64)])
        documents.append([columns[c] for c in ("digest", "id", "null")])
        before += len(columns["id"])
    row, start, count = (np.concatenate(c) for c in zip(*found))
    if not len(row):
        return
    raw = b"".join(texts)
    one = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)], "<i8").tobytes()), pa.py_buffer(raw))
    codes, _, vocabulary = words.coded(one)
    del texts, raw, one
    sizes = count + window - 1
    firsts = np.cumsum(sizes) - sizes
    kmer = np.repeat(np.arange(len(sizes)), count)  # of each window
    at = np.arange(len(kmer)) - np.repeat(np.cumsum(count) - count, count) + firsts[kmer]
    hashes = _joined(_mix(np.arange(1, len(vocabulary) + 1, dtype=np.uint64) * MIXERS[2])[codes], window)[at]
    chosen, group = _equal_windows(codes, at, hashes, window)
    if not len(chosen):
        return
    digests, ids, nulls = (np.concatenate(c) for c in zip(*documents))
    document = _ranks(digests, ids, nulls)
    begins = start[kmer] + at - firsts[kmer]
    _, later = _repeats(group, document[row[kmer[chosen]]] * (1 << 32) + begins[chosen])
    again = np.sort(chosen[later])
    if not len(again):
        return
    new = np.concatenate(([True], (again[1:] != again[:-1] + 1) | (kmer[again][1:] != kmer[again][:-1])))
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(again)))
    heads = again[heads]
    yield _marks(pa.array(ids, mask=nulls.astype(bool)), digests, row[kmer[heads]], begins[heads], counts)


def repeated_windows(sent: DataFrame, window: int = WINDOW, partitions: int | None = None, limit: int = PART_BYTES) -> DataFrame:
    """``(doc_id, digest, mark)`` of every stretch of windows whose words begin earlier as well."""
    partitions = partitions or int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            known = batch.filter(batch.column("packed").is_null())
            if known.num_rows:
                yield known.select(["doc_id", "digest", "mark"])
            rows = batch.filter(batch.column("packed").is_valid())
            for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("packed")):
                if bucket != current and blobs:
                    for marks in _count_bucket(blobs, window, limit):
                        yield marks.select(["doc_id", "digest", "mark"])
                    blobs = []
                current = bucket
                blobs.append(packed.as_py())
        if blobs:
            for marks in _count_bucket(blobs, window, limit):
                yield marks.select(["doc_id", "digest", "mark"])

    dealt = sent.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, "doc_id long, digest long, mark long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, hot_mers: int = HOT_MERS, limit: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each text's words that no repeated window covers, joined by one space."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * size // BUCKET_BYTES + 1)
    hot = frequent_mers(docs, counter_bits(size), mer, hot_mers)
    marks = repeated_windows(super_kmers(docs, hot, buckets, window, mer), window, limit=limit)
    gathered = marks.groupBy("doc_id", "digest").agg(F.collect_list("mark").alias("marks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.col("text").cast("string").alias("text"))
    m = gathered.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "marks")
    joined = rows.join(m, rows["doc_id"].eqNullSafe(m["_id"]) & (rows["digest"] == m["_digest"]), "left").select("doc_id", "text", "marks")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, listed in zip(batch.column(1), batch.column(2)):
                said = (text.as_py() or "").encode().split()
                total.append(len(said))
                left = len(said)
                if listed.is_valid:
                    mark = listed.values.to_numpy()
                    turns = np.zeros(len(said) + 1, np.int64)
                    np.add.at(turns, mark >> 32, 1)
                    np.add.at(turns, (mark >> 32) + (mark & 0xFFFFFFFF) + window - 1, -1)
                    stays = np.cumsum(turns[:-1]) == 0
                    left = int(stays.sum())
                    said = compress(said, stays.tolist())
                removed.append(total[-1] - left)
                kept.append(b" ".join(said).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per document."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
