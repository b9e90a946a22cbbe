"""Nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted in the driver on at most ``FIT_ROWS`` vectors, the smallest ones by a seeded hash
of their ids; every vector is indexed. A query walks the tree best bin first: a priority queue holds the
open nodes by inner product with their centres, and leaves are visited in the order they come out. How
many leaves are visited is calibrated: for at most ``CALIBRATION`` queries the true neighbours are found
by brute force, and the visits are widened until their recall reaches ``RECALL``. A query whose
leaves hold too few vectors goes on until they hold enough.

Leaves are put together into bins of about ``BIN_ROWS`` vectors; a larger leaf is split over several
bins. Queries are dealt into groups too, so a task scores one bin against one group.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows
with a null id, nor vectors whose dimension is not the most frequent one (of equally frequent ones: the
largest). A repeated id is one query, with its smallest vector, and as many candidates as it has rows. With
fewer candidates than wanted, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.common import saved

FIT_ROWS = 20_000
BRANCHES = 16
LEAF_ROWS = 96  # sampled vectors; above that a node is split
ROUNDS = 8
CALIBRATION = 200
RECALL = 0.97
BIN_ROWS = 8192
GROUP_QUERIES = 16_384
BLOCK_QUERIES, BLOCK_VECTORS = 128, 8192  # scored against one another at once
PAIRS = 200_000
SEED = 5


class Tree:
    """Nodes in arrays: the children of a node, its centre, and its leaf number or -1."""

    def __init__(self, vectors: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS):
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        rng = np.random.default_rng(SEED)
        self._grow(vectors, vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1]), branches, leaf_rows, rng)
        self.matrix = np.array(self.centres)

    def _grow(self, x: np.ndarray, centre: np.ndarray, branches: int, leaf_rows: int, rng) -> int:
        node = len(self.leaf)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        parts = _kmeans(x, branches, rng) if len(x) > leaf_rows else []
        if len(parts) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
        else:
            self.children[node] = [self._grow(x[rows], c, branches, leaf_rows, rng) for c, rows in parts]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at every node, the child with the nearest centre."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            c = self.matrix[kids]
            best = np.argmin((c ** 2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        near = self.matrix @ query
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))


def _kmeans(x: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(ROUNDS):
        of = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
        centres = np.array([x[of == i].mean(0) for i in range(len(centres)) if (of == i).any()])
    of = np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)
    return [(centres[i], np.flatnonzero(of == i)) for i in range(len(centres)) if (of == i).any()]


def _matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 1))


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The inner product of each row with the same row, summed in the order of the components, so that equal vectors
    get equal scores."""
    out = np.zeros(len(queries))
    for d in range(vectors.shape[1]):
        out += queries[:, d] * vectors[:, d]
    return out


def _first(k: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of each row's ``k`` best, by falling score, then rising id."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    starts = np.concatenate(([True], row[1:] != row[:-1]))
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(starts, np.arange(len(row)), 0)) if len(row) else row
    return order[nth < k]


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, open_: np.ndarray | None = None):
    """``(query, vector, score)`` of the ``k`` best candidates of each query, its own id excluded, where ``open_`` allows.

    A matrix product rules out most; what may be among the best, given its rounding, is scored exactly.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
    allowed = ids[None, :] != q_ids[:, None]
    if open_ is not None:
        allowed &= open_
    if np.isfinite(s).all():
        s[~allowed] = -np.inf
        if s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            margin = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            allowed &= s >= (least - margin)[:, None]
    row, column = np.nonzero(allowed)
    # ties of very common vectors may be many, so they are scored in parts
    with np.errstate(over="ignore", invalid="ignore"):
        found = [exact_scores(q[row[i:i + PAIRS]], x[column[i:i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    score = np.concatenate(found) if found else np.zeros(0)
    best = _first(k, row, score, ids[column])
    return row[best], column[best], score[best]


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, vector)``: rows that take part, vectors as little-endian doubles."""
    sizes = embeddings.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    width = common["d"] if common else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.array([np.nan if c is None else c for c in v], "<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == width))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, "vec_id long, vector binary")


def _top(df: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _calibrate(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, sample: int) -> int:
    """The number of leaves whose visit finds ``recall`` of the true neighbours of sampled queries."""
    # the result is at most ``sample`` rows
    some = queries.orderBy(F.xxhash64(F.lit(SEED + 1), "vec_id"), "vec_id").limit(sample).toPandas()
    if not len(some):
        return 1
    ids, vectors = some["vec_id"].to_numpy(), np.array([np.frombuffer(v, "<f8") for v in some["vector"]])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for b in batches:
            x, other, leaf = _matrix(b.column("vector")), b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            for at in range(0, len(x), BLOCK_VECTORS):
                part = slice(at, at + BLOCK_VECTORS)
                row, column, score = nearest(vectors, ids, x[part], other[part], k)
                held = [np.concatenate(c) for c in zip(held, (row, other[part][column], score, leaf[part][column]))]
                best = _first(k, held[0], held[2], held[1])
                held = [c[best] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), *map(pa.array, held[1:])], ["query_id", "vec_id", "score", "leaf"])

    found = indexed.select("vec_id", "vector", "leaf").mapInArrow(brute, "query_id long, vec_id long, score double, leaf long")
    true = _top(found, k).select("query_id", "leaf").toPandas()  # at most sample * k rows
    if not len(true):
        return 1
    place = {q: {leaf: n for n, leaf in enumerate(tree.visit(v), 1)} for q, v in zip(ids.tolist(), vectors)}
    needed = np.sort([place[q][leaf] for q, leaf in zip(true["query_id"], true["leaf"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _bins(sizes: list[int], bin_rows: int) -> tuple[list[int], list[int]]:
    """The first bin of each leaf and the number of bins it is split over; neighbours share a bin."""
    first, splits, at, filled = [], [], 0, 0
    for n in sizes:
        if filled and filled + n > bin_rows:
            at, filled = at + 1, 0
        first.append(at)
        splits.append(max(1, -(-n // bin_rows)))
        if splits[-1] > 1:
            at, filled = at + splits[-1], 0
        else:
            filled += n
    return first, splits


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, fit_rows: int = FIT_ROWS,
           calibration: int = CALIBRATION, bin_rows: int = BIN_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query, its own id excluded."""
    spark = embeddings.sparkSession
    vectors = saved(usable(embeddings), "vectors")
    asked = saved(usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    sample = vectors.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(fit_rows).select("vector").toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    tree = Tree(np.array([np.frombuffer(v, "<f8") for v in sample["vector"]]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.assign(_matrix(b.column("vector"))))], ["vec_id", "vector", "leaf"])

    indexed = saved(vectors.mapInArrow(index, "vec_id long, vector binary, leaf long").withColumn("row", F.monotonically_increasing_id()), "leaves")
    sizes = {r["leaf"]: r["n"] for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
    visits = _calibrate(indexed, asked, tree, k, recall, calibration)
    first, splits = _bins([sizes.get(leaf, 0) for leaf in range(tree.n_leaves)], bin_rows)
    groups = max(1, -(-asked.count() // group_queries))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q_ids, q_vectors, bins, leaves = [], [], [], []
            raw = b.column("vector").to_pylist()
            for i, (q, v) in enumerate(zip(b.column("vec_id").to_pylist(), _matrix(b.column("vector")))):
                held, wanted = 0, {}
                for n, leaf in enumerate(tree.visit(v)):
                    if n >= visits and held > k:
                        break
                    held += sizes.get(leaf, 0)
                    for s in range(splits[leaf] if leaf in sizes else 0):
                        wanted.setdefault(first[leaf] + s, []).append(leaf)
                for place, own in wanted.items():
                    q_ids.append(q), q_vectors.append(raw[i]), bins.append(place), leaves.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(q_vectors, pa.binary()), pa.array(bins, pa.int64()),
                                              pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "query", "bin", "leaves"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        x, ids = _matrix(left.column("vector")), left.column("vec_id").to_numpy()
        leaves, leaf = np.unique(left.column("leaf").to_numpy(), return_inverse=True)
        q_ids, q = right.column("query_id").to_numpy(), _matrix(right.column("query"))
        lists = right.column("leaves").combine_chunks()
        # which of the bin's leaves each query visits
        values = lists.values.to_numpy()
        place = np.searchsorted(leaves, values)
        here = (place < len(leaves)) & (leaves[np.minimum(place, len(leaves) - 1)] == values) if len(leaves) else place < 0
        visited = np.zeros((len(q_ids), len(leaves)), bool)
        visited[np.repeat(np.arange(len(q_ids)), np.diff(lists.offsets.to_numpy()))[here], place[here]] = True
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q_ids) if len(x) else 0, BLOCK_QUERIES):
            part = slice(a, a + BLOCK_QUERIES)
            row, column, found = nearest(q[part], q_ids[part], x, ids, k, visited[part][:, leaf])
            out.append((q_ids[part][row], ids[column], found))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    leaf = F.col("leaf").cast("int")
    placed = indexed.select("vec_id", "vector", "leaf", (F.get(longs(first), leaf) + F.pmod("row", F.get(longs(splits), leaf))).alias("bin"))
    walked = asked.mapInArrow(walk, "query_id long, query binary, bin long, leaves array<long>")
    walked = saved(walked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")), "walks")
    # a bin goes to the groups that visit it, and to no other
    met = walked.groupBy(F.col("bin").alias("_bin"), F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(met, F.col("bin") == F.col("_bin")).select("vec_id", "vector", "leaf", "bin", F.col("_group").alias("group"))
    found = placed.groupBy("bin", "group").cogroup(walked.groupBy("bin", "group")).applyInArrow(score, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
