"""Exact similarity join of documents on word n-grams, as components.

Signatures (:func:`flowmill.llm.shingles.signatures`) are such that two linked sets share one. Documents
with equal sets are one node. Of the nodes under one signature each is compared with the first one,
inside a task, so that a frequent signature leaves a task once, and then across tasks. Pairs that
size and parity sketches do not rule out are verified on their whole texts. What a signature still
has in several components is then compared across them, in tiles of bounded size: first a spanning
forest of the possible pairs of a tile is verified, then all that remain. No pair of one component
is needed.

Defined cases: a null text counts as empty; a document without words has no shingles and is linked
with nothing, not even its copies. Rows that share a ``doc_id`` are rows of their own; a null
``doc_id`` counts as the largest, so a component is named by another id if it has one. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm import shingles
from flowmill.llm.common import saved, tidy
from flowmill.llm.components import components

FLUSH = 400_000  # signatures that a task sorts at once
PART = 400_000  # signatures that meet at once, as a rule
PARTS_TOGETHER = 16  # of them in a partition, one after another
ROWS = 1000  # documents that a task has in hand at once
LEADER_ROWS = 2_000  # documents compared with one copy of a leader's text
TILE = 1024  # documents of one signature compared with as many others at once
BROADCAST_ROWS = 1_000_000  # of some 60 bytes each


def _texts(column: pa.Array) -> list[bytes]:
    return [t.encode() if t else b"" for t in column.to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _text_hash() -> Column:
    """Tells rows with one id, or with none, apart."""
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: ``(doc_id, text_hash, n, k1, k2, sketch, fine, signs)``. Of equal sets in one task only the
    first signs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in _slices(batches):
            rows, signs, sketches = [], [], []
            for s in shingles.shingle_sets(_texts(b.column(1)), k):
                key = shingles.set_key(s)
                rows.append((len(s), *key, shingles.fine_sketch(s)))
                sketches.append(shingles.parity_sketch(s))
                signs.append(s[:0].view(np.int64) if key in seen else shingles.signatures(s, percent))
                seen.add(key)
            n, k1, k2, fine = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                _lists(np.concatenate(sketches or [np.zeros(0, np.int64)]), np.full(len(n), shingles.SKETCH_BITS // 64)),
                pa.array(fine, pa.binary()),
                _lists(np.concatenate(signs or [np.zeros(0, np.int64)]), np.array([len(x) for x in signs], np.int64)),
            ], ["doc_id", "text_hash", "n", "k1", "k2", "sketch", "fine", "signs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash())
    return rows.mapInArrow(tidy(work), "doc_id long, text_hash long, n long, k1 long, k2 long, sketch array<long>, fine binary, signs array<long>")


def _star(signs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(signature, first id)`` once each, and ``(signature, first id, other id)`` for all others."""
    order = np.lexsort((ids, signs))
    signs, ids = signs[order], ids[order]
    new = np.concatenate(([True], signs[1:] != signs[:-1])) if len(signs) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(signs)), 0))
    other = ~new & (ids != ids[first]) if len(signs) else new
    return signs[new], ids[new], signs[other], ids[first][other], ids[other]


def stars(rows: DataFrame) -> DataFrame:
    """``(leader, member, signs)`` from rows ``(id, signs)``: for every signature, a path of such pairs joins
    all ids that have it."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.size("signs")).alias("n")).first()["n"] or 0  # as many parts as that needs
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-total // PART))
    partitions = max(least, -(-parts // PARTS_TOGETHER))
    names = ["part", "signs", "ids", "p_signs", "p_leaders", "p_members"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(signs, ids):
            own, first, *pairs = _star(np.concatenate(signs), np.concatenate(ids))
            # signatures meet in one place; pairs found here need not, so a frequent signature's are spread by member
            where = [(x.view(np.uint64) >> np.uint64(8)) % np.uint64(parts) for x in (own, pairs[2])]
            orders = [np.argsort(w, kind="stable") for w in where]
            cuts = [np.searchsorted(w[o], np.arange(parts + 1, dtype=np.uint64)) for w, o in zip(where, orders)]
            columns = [own[orders[0]], first[orders[0]], *[p[orders[1]] for p in pairs]]
            out = [list(range(parts))]
            for i, c in enumerate(columns):
                cut = cuts[min(1, i // 2)] * 8
                raw = c.tobytes()
                out.append([raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(o, pa.binary()) for o in out[1:]]], names)

        signs, ids, held = [], [], 0
        for b in batches:
            lists = b.column(1)
            values = lists.flatten().to_numpy()
            signs.append(values)
            ids.append(np.repeat(b.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())))
            held += len(values)
            if held >= FLUSH:
                yield flush(signs, ids)
                signs, ids, held = [], [], 0
        if held:
            yield flush(signs, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, [[] for _ in names[1:]]
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                if p != part:
                    yield from together(held)
                    part, held = p, [[] for _ in names[1:]]
                for into, column in zip(held, b.columns[1:]):
                    into.append(np.frombuffer(column[i].as_py(), np.int64))
        yield from together(held)

    def together(parts_of: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts_of[0]:
            return
        signs, ids, *local = [np.concatenate(p) for p in parts_of]
        _, _, *across = _star(signs, ids)
        signs, leaders, members = (np.concatenate(p) for p in zip(local, across))
        order = np.lexsort((signs, members, leaders))
        signs, leaders, members = signs[order], leaders[order], members[order]
        if not len(signs):
            return
        new = np.concatenate(([True], (signs[1:] != signs[:-1]) | (leaders[1:] != leaders[:-1]) | (members[1:] != members[:-1])))
        signs, leaders, members = signs[new], leaders[new], members[new]
        starts = np.flatnonzero(np.concatenate(([True], (leaders[1:] != leaders[:-1]) | (members[1:] != members[:-1]))))
        counts = np.diff(np.append(starts, len(signs)))
        for a in range(0, len(starts), 20_000):
            z = min(len(starts), a + 20_000)
            own = signs[starts[a]:starts[z] if z < len(starts) else len(signs)]
            yield pa.RecordBatch.from_arrays([pa.array(leaders[starts[a:z]]), pa.array(members[starts[a:z]]), _lists(own, counts[a:z])],
                                             ["leader", "member", "signs"])

    sent = rows.filter(F.size("signs") > 0).select("id", "signs").mapInArrow(
        tidy(send), "part int, " + ", ".join(f"{n} binary" for n in names[1:])
    )
    return sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(tidy(meet), "leader long, member long, signs array<long>")


def _possible(a: str, b: str, percent: int) -> Column:
    """False only for pairs whose sizes or sketches rule a link out."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = F.aggregate(F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda s, x: s + x)
    fits = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return fits & (bits * (100 + percent) <= (na + nb) * (100 - percent))


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones of the pairs ``(a, b, da, db, ka, kb)``: nodes, a document (id, text hash) of each and the second
    half of its key. The shingles of whole texts are compared. Each ``a`` is sent once for every ``LEADER_ROWS`` of its partners, so a
    much compared document keeps many tasks busy."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_ROWS).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    others = salted.select("a", "salt", F.lit(1).alias("other"), F.col("b").alias("node"), F.col("kb").alias("k2"), F.col("db").alias("_doc"))
    leaders = salted.select("a", "salt", F.lit(0).alias("other"), F.col("a").alias("node"), F.col("ka").alias("k2"), F.col("da").alias("_doc"))
    wanted = saved(others.unionByName(leaders.distinct()), "compared")
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.select("a", "salt", "other", "node", "k2", F.col("_doc.doc_id").alias("_id"), F.col("_doc.text_hash").alias("_hash"))
    if few:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", "text", _text_hash()).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other", "node").select(
        "a", "salt", "other", "node", "k2", F.coalesce("text", F.lit("")).alias("text")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, done = None, None, None
        for b in _slices(batches):
            found: list[tuple[int, int]] = []
            sets = shingles.shingle_sets(_texts(b.column(5)), k)
            for a, salt, other, node, k2, s in zip(*(c.to_pylist() for c in b.columns[:5]), sets):
                if (a, salt) != at:
                    at, lead, done = (a, salt), None, None
                # rows that share a doc_id with another text, or repeat one, are left out
                if node == done and other or shingles.set_key(s) != (node, k2):
                    continue
                if not other:
                    lead = s
                    continue
                done = node
                both = len(np.intersect1d(lead, s, assume_unique=True)) if lead is not None else 0
                if both and 100 * both >= percent * (len(lead) + len(s) - both):
                    found.append((a, node))
            if found:
                x = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return ordered.mapInArrow(tidy(compare), "a long, b long")


def _tile_pairs(tile: list, percent: int, forest: bool) -> list[tuple[int, int]]:
    """Possible pairs across components, all or a spanning forest of them."""
    ids, labels, n, sketch, fine = tile
    labels, found = labels.copy(), []
    for i in range(len(ids) - 1):
        near = (labels[i + 1:] != labels[i]) & (np.minimum(n[i + 1:], n[i]) * 100 >= np.maximum(n[i + 1:], n[i]) * percent)
        at = np.flatnonzero(near) + i + 1
        if len(at):
            bits = np.bitwise_count((sketch[at] ^ sketch[i]).view(np.uint64)).sum(1, dtype=np.int64)
            at = at[bits * (100 + percent) <= (n[at] + n[i]) * (100 - percent)]
        while len(at):
            j, at = int(at[0]), at[1:]
            if fine[i] is not None and fine[j] is not None:
                if shingles.fine_bits(fine[i], fine[j]) * (100 + percent) > int(n[i] + n[j]) * (100 - percent):
                    continue
            found.append((int(ids[i]), int(ids[j])))
            if forest:
                labels[labels == labels[j]] = labels[i]
                at = at[labels[at] != labels[i]]
    return found


def _tiles(members: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs ``(x, y)`` of different components under one signature that may be linked. Sketches join the
    rows at the end, so that they are shuffled once."""
    sizes = members.groupBy("sign").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = members.join(sizes, "sign").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    meets = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "sign", F.least("tile", "with").alias("t1"), F.greatest("tile", "with").alias("t2"), "id", "label"
    ).join(nodes.select("id", "n", "sketch", "fine"), "id").select("sign", "t1", "t2", "id", "label", "n", "sketch", "fine")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for b in _and_end(batches):
            if b is not None:
                columns = [b.column(i).to_numpy() for i in range(6)]
                columns.append(b.column(6).flatten().to_numpy().reshape(-1, shingles.SKETCH_BITS // 64))
                columns.append(np.array([*b.column(7).to_pylist(), None], object)[:-1])
                held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if held is None or not len(held[0]):
                continue
            key = np.stack(held[:3], 1)
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            stops = np.append(starts[1:], len(key))
            whole = len(starts) if b is None else len(starts) - 1  # the last group may go on
            found: set[tuple[int, int]] = set()
            for a, z in zip(starts[:whole].tolist(), stops[:whole].tolist()):
                found.update(_tile_pairs([c[a:z] for c in held[3:]], percent, forest))
            held = [c[starts[whole]:] for c in held] if whole < len(starts) else None
            if found:
                x, y = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    ordered = meets.repartition("sign", "t1", "t2").sortWithinPartitions("sign", "t1", "t2", "id")
    return ordered.mapInArrow(tidy(compare), "x long, y long")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@contextmanager
def _batches_of(spark, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for tables whose rows are long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, k1, component, component_id)``, a row per document; ``k1`` names its set,
    ``component`` is the smallest ``k1`` reachable and ``component_id`` the smallest ``doc_id``; a document
    without shingles has no component but its own id."""
    with _batches_of(docs.sparkSession, ROWS):
        rows = saved(profiles(docs, k, percent), "profiles")
        stars_of = saved(stars(rows.select(F.col("k1").alias("id"), "signs")), "stars")
    nodes = saved(
        rows.filter("n > 0").groupBy(F.col("k1").alias("id")).agg(
            F.min("k2").alias("k2"), F.max("k2").alias("other"), F.min("n").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("doc"),
            F.first("sketch").alias("sketch"), F.first("fine").alias("fine"),
        ), "nodes",
    )
    if not nodes.filter("k2 <> other").isEmpty():
        raise ValueError("two sets share half of their key; give shingles.set_key another seed")

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        ends = [nodes.select(F.col("id").alias(c), F.struct("n", "sketch", "doc", "k2").alias(f"s{c}")) for c in ("a", "b")]
        both = pairs.join(ends[0], "a").join(ends[1], "b").filter(_possible("sa", "sb", percent))
        return both.select("a", "b", F.col("sa.doc").alias("da"), F.col("sb.doc").alias("db"), F.col("sa.k2").alias("ka"), F.col("sb.k2").alias("kb"))

    pairs = saved(stars_of.select("leader", "member").distinct(), "pairs")
    links = saved(verified(docs, candidates(pairs.toDF("x", "y")), k, percent), "links")
    label = components(links)

    def labelled(df: DataFrame, node: str, into: str) -> DataFrame:
        named = label.select(F.col("node").alias(node), F.col("label").alias("_label"))
        return df.join(named, node, "left").withColumn(into, F.coalesce("_label", node)).drop("_label")

    # signatures that have several components, with all their nodes
    cross = labelled(labelled(pairs, "leader", "l1"), "member", "l2").filter("l1 <> l2").select("leader", "member")
    open_signs = stars_of.join(cross, ["leader", "member"], "left_semi").select(F.explode("signs").alias("sign")).distinct()
    listed = stars_of.select("leader", "member", F.explode("signs").alias("sign")).join(open_signs, "sign", "left_semi")
    members = listed.select("sign", F.explode(F.array("leader", "member")).alias("id")).distinct()
    members = saved(labelled(members, "id", "label").select("sign", "id", "label"), "members")
    for forest in (True, False):
        if members.isEmpty():
            break
        possible = saved(candidates(_tiles(members, nodes, percent, forest)), "possible")
        if possible.isEmpty():
            break
        more = saved(verified(docs, possible, k, percent), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        label = components(links)
        if forest:
            members = labelled(members.drop("label"), "id", "label")
            still = members.groupBy("sign").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2").select("sign")
            members = saved(members.join(still, "sign", "left_semi").select("sign", "id", "label"), "members")
    label = label.select(F.col("node").alias("k1"), "label")
    found = rows.select("doc_id", "n", "k1").join(label, "k1", "left").withColumn(
        "component", F.when(F.col("n") > 0, F.coalesce("label", "k1")))
    # components of several nodes; others are named in their own group of equal sets
    smallest = found.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return found.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "k1", "component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _with_key(docs: DataFrame, k: int) -> DataFrame:
    """All columns of ``docs``, and the key and size of each text's shingle set."""
    names = [f"_c{i}" for i in range(len(docs.columns))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), shingles.set_key(s)[0]) for s in shingles.shingle_sets(_texts(b.column(b.num_columns - 1)), k)]
            keys = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *keys], [*names, "_n", "_k1"])

    plain = docs.toDF(*names)
    schema = plain.selectExpr("*", "0L AS _n", "0L AS _k1").schema
    for field in schema:
        field.nullable = True
    return plain.withColumn("_text", F.col(names[docs.columns.index("text")])).mapInArrow(work, schema)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that remain when each component keeps one: the one with the smallest ``doc_id``
    (null last). Documents without words are never linked, so all of them remain."""
    found = saved(join(docs, k, percent), "components")
    best = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1")).alias("m"))
    kept = saved(best.select("m.doc_id", "m.k1"), "kept")
    # ids that go, because the one row that has them goes, and ids that need a closer look
    counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("n_shingles").alias("least")).join(
        kept.select("doc_id", F.lit(True).alias("kept")).distinct(), "doc_id", "left")
    out = saved(counted.filter("doc_id is not null and (rows > 1 or kept is null and least > 0)").select("doc_id", "rows"), "dropped")
    ids, several = out.select(F.col("doc_id").alias("_id")), out.filter("rows > 1").select(F.col("doc_id").alias("_id"))
    small = out.count() <= BROADCAST_ROWS
    plain = docs.filter(docs["doc_id"].isNotNull()).join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_id"), "left_anti")
    if several.isEmpty() and found.filter("doc_id is null").isEmpty():
        return plain
    # rows that share an id are found again by their shingles
    rest = docs.join(F.broadcast(several) if small else several, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(
        docs.filter(docs["doc_id"].isNull()))
    keyed = _with_key(rest, k)
    names = keyed.columns[:-2]
    at, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    wanted = kept.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_w"))
    alive = keyed.join(wanted, F.col(at).eqNullSafe(F.col("_d")) & (F.col("_k1") == F.col("_w")), "left_semi")
    once = alive.filter("_n > 0").groupBy(at, "_k1").agg(F.min_by(F.struct(*names), F.xxhash64(text)).alias("r"))
    rows = once.select(*[F.col(f"r.{c}").alias(c) for c in names]).unionByName(keyed.filter("_n = 0").select(*names))
    return plain.unionByName(rows.toDF(*docs.columns))
