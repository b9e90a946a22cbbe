"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A fingerprint is a wide vector: the sum, lane by lane and modulo powers of two, of the vectors
hashed from a document's paragraphs. It does not depend on their order, and a paragraph is
inserted or deleted by adding or subtracting its vector. A paragraph's vector has

* ``EXACT`` lanes modulo 2^64, hashed from the whole paragraph: they decide equality;
* ``SKETCH`` words of three lanes each, modulo 2^21: every run of four words of the paragraph adds
  one hashed bit to each lane. Runs overlap, one starts at each word that has three more after it. Against
  the number of runs, a lane's count is a sum of random signs, so that lane products estimate how many
  runs two documents share: ``2ab / (aa + bb)``.

Defined cases: a null text counts as empty; an empty text is one empty paragraph without runs. A paragraph
of one to three words is one run. Runs do not see which white space parts their words.
Equal fingerprints have likeness 1. A lane counts up to 2,097,151 runs; a longer text's lanes wrap,
which leaves sums, equality and deletion right and only blurs its likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import WORD

EXACT = 4
HASHES = 2
LANE_BITS = 21
SKETCH = HASHES * LANE_BITS
ONES = 1 | 1 << LANE_BITS | 1 << 2 * LANE_BITS
LANE = (1 << LANE_BITS) - 1
RUN_WORDS = 4
BYTE_ONES = 0x0101010101010101
BYTE_HASHES = 127  # as many ones fit a signed byte
ROWS_PER_CHUNK = 50_000


def _total(values: Column) -> Column:
    """Sum modulo 2^64. Built of halves, because ANSI addition raises on overflow."""
    low = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, 32))
    return wrap_add(low, F.shiftleft(high, 32))


def wrap_add(a: Column, b: Column) -> Column:
    """``a + b`` modulo 2^64, by halves."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def wrap_subtract(a: Column, b: Column) -> Column:
    return wrap_add(a, wrap_add(F.bitwise_not(b), F.lit(1).cast("long")))


def _hashed(parts: Column, seed: int) -> Column:
    """The seed goes first: arguments are chained, and every lane is to hash the text under its own state."""
    return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))


def _runs(paragraphs: Column, seed: int) -> Column:
    """Hashes of all runs of words, from the words of each paragraph. Words past the end are null, which a
    hash skips."""
    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - RUN_WORDS, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(seed), *[F.get(words, i + k) for k in range(RUN_WORDS)]))

    return F.flatten(F.transform(F.filter(paragraphs, lambda words: F.size(words) > 0), of))


def _counted_bits(hashes: Column) -> Column:
    """How often each bit is set: word ``i`` counts bits ``i``, ``i + 21`` and ``i + 42``. Bits are counted in
    bytes first, eight words for ``BYTE_HASHES`` hashes."""
    def in_bytes(start: Column) -> Column:
        none = F.array_repeat(F.lit(0).cast("long"), 8)
        return F.aggregate(F.slice(hashes, start, BYTE_HASHES), none, lambda counts, h: F.transform(
            counts, lambda x, i: x + F.call_function("shiftrightunsigned", h, i).bitwiseAND(F.lit(BYTE_ONES))
        ))

    def lane(counts: Column, bit: int) -> Column:
        return F.shiftrightunsigned(F.get(counts, F.lit(bit % 8)), bit // 8 * 8).bitwiseAND(F.lit(0xFF))

    def word(counts: Column, i: int) -> Column:
        first, second, third = (F.shiftleft(lane(counts, i + k * LANE_BITS), k * LANE_BITS) for k in range(3))
        return first.bitwiseOR(second).bitwiseOR(third)

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(BYTE_HASHES)), in_bytes)
    lanes = F.transform(blocks, lambda counts: F.array(*[word(counts, i) for i in range(LANE_BITS)]))
    return F.aggregate(lanes, F.array_repeat(F.lit(0).cast("long"), LANE_BITS), insert)


def insert(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return F.zip_with(a, b, wrap_add)


def delete(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, wrap_subtract)


def text_of(v: Column) -> Column:
    """A vector as hexadecimal digits; equal vectors have equal text."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _signed(v: Column) -> Column:
    """The lanes as sums of signs: ``array<double>``."""
    runs = F.element_at(v, 1)
    words = F.slice(v, EXACT + 2, SKETCH)

    def third(shift: int) -> Column:
        return F.transform(words, lambda x: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LANE)) * 2 - runs).cast("double"))

    return F.concat(third(0), third(LANE_BITS), third(2 * LANE_BITS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_likeness(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """Adds 0 to 1: the share of runs that two fingerprinted texts have in common; 1 for equal ones."""
    signs = df.withColumns({"_fp_a": _signed(F.col(a)), "_fp_b": _signed(F.col(b))})
    near = 2 * _dot(F.col("_fp_a"), F.col("_fp_b")) / F.nullif(
        _dot(F.col("_fp_a"), F.col("_fp_a")) + _dot(F.col("_fp_b"), F.col("_fp_b")), F.lit(0.0)
    )
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0))))
    return signs.withColumn(into, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(bounded)).drop("_fp_a", "_fp_b")


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with each text's vector, ``array<long>``, in column ``into``: the number of runs, the
    exact lanes, then the packed sketch lanes. The steps are projections of their own, so that each
    is evaluated once."""
    filled = F.coalesce(F.col(text), F.lit(""))
    parts = docs.withColumn("_fp_p", F.split(filled, "\n"))
    parts = parts.withColumn("_fp_w", F.transform("_fp_p", lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0))))
    hashes = parts.withColumns({f"_fp_e{k}": _hashed(F.col("_fp_p"), k) for k in range(EXACT)} | {
        f"_fp_s{k}": _runs(F.col("_fp_w"), EXACT + k) for k in range(HASHES)
    })
    exact = [_total(F.col(f"_fp_e{k}")) for k in range(EXACT)]
    sketch = [_counted_bits(F.col(f"_fp_s{k}")) for k in range(HASHES)]
    vector = F.concat(F.array(F.size("_fp_s0").cast("long"), *exact), *sketch)
    return hashes.withColumn(into, vector).drop(
        "_fp_p", "_fp_w", *[f"_fp_e{k}" for k in range(EXACT)], *[f"_fp_s{k}" for k in range(HASHES)]
    )


def _chunk(bounds: list[int], key: Column) -> Column:
    """How many bounds lie below ``key``, found in two steps; -1 for null, which sorts last."""
    if not bounds:
        found = F.lit(0)
    else:
        step = max(1, round(len(bounds) ** 0.5))
        parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
        below = lambda values: F.size(F.filter(values, lambda b: b < key))
        lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])
        outer = F.least(below(F.array(*[F.lit(p[-1]).cast("long") for p in parts])), F.lit(len(parts) - 1))
        found = outer * step + below(F.get(lists, outer))
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``(doc_id, text, next_text, vector, next_vector)`` in order of falling ``doc_id``, nulls last,
    ties by text; after the last document comes the first.

    Documents are shuffled once, into chunks of neighbouring ids. A chunk also gets a copy of the
    first document of the chunk that follows, so that its last row finds its neighbour.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows_per_chunk)
    cuts = [i / chunks for i in range(1, chunks)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * chunks)).alias("c")).first()["c"]
    bounds = sorted(set(found or []))
    chunked = docs.withColumn("chunk", _chunk(bounds, F.col("doc_id")))
    # first documents of the chunks: one row per chunk, found on ids alone
    heads = chunked.groupBy("chunk").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy("chunk")  # as many rows as there are chunks
    heads = heads.withColumn("above", F.coalesce(
        F.lead("chunk").over(order), F.first("chunk").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ))
    same = F.col("doc_id").eqNullSafe(F.col("head"))
    borders = docs.join(F.broadcast(heads.select("head", "above")), same).groupBy("above").agg(F.min("text").alias("text"))
    sentinels = borders.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("above").alias("chunk"), F.lit(1).alias("border"))
    rows = chunked.withColumn("border", F.lit(0)).unionByName(sentinels).repartition(chunks, "chunk")
    rows = fingerprints(rows, "text", "vector")
    falling = Window.partitionBy("chunk").orderBy("border", F.col("doc_id").desc_nulls_last(), "text")
    following = F.lead(F.struct("text", "vector")).over(falling)
    paired = rows.withColumn("following", following).filter(F.col("border") == 0)
    return paired.select("doc_id", "text", "vector", F.col("following.text").alias("next_text"),
                         F.col("following.vector").alias("next_vector"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document against its edited text, whose last third is the start of the next one, and
    against that next document."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    kept, new = F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)
    rows = with_next(docs).withColumns({"n_chars": n.cast("long"), "edited": F.concat(kept, new)})
    rows = fingerprints(rows, "edited", "edited_vector")
    rows = with_likeness(rows, "vector", "edited_vector", "near_edited")
    rows = with_likeness(rows, "vector", "next_vector", "near_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("vector")).alias("fingerprint"), text_of(F.col("edited_vector")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
