"""The similarity join, the search, the fingerprints, the mixture, the classifier and the licences."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmill.llm import ann, catalog, components, fingerprint, jaccard, licenses, mixing, quality, shingles


# ---- shingles and the join

def brute_shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute_components(rows, k, percent):
    sets = [brute_shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(find(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in names.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def joined(df, k, percent):
    return sorted((tuple(r) for r in jaccard.join(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 160), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([60, 80, 90, 95]))
def test_linked_sets_share_a_signature(n, gone, new, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64))))
    both = len(np.intersect1d(a, b))
    union = len(a) + len(b) - both
    bits = int(np.bitwise_count((shingles.parity_sketch(a) ^ shingles.parity_sketch(b)).view(np.uint64)).sum())
    assert bits <= union - both
    large = [np.unique(np.concatenate((x, np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) for x in (a, b)]
    assert shingles.fine_bits(*map(shingles.fine_sketch, large)) <= union - both
    if both and union > both and 100 * both >= percent * union:
        assert len(np.intersect1d(shingles.signatures(a, percent), shingles.signatures(b, percent)))


def test_long_texts_give_the_same_shingles(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 997) for i in range(3000)) + b" " + b"x" * 900
    whole = list(shingles.shingle_sets([text, b"", b"A a"], 3))
    monkeypatch.setattr(shingles, "CHUNK", 256)
    parts = list(shingles.shingle_sets([text, b"", b"A a"], 3))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert [len(s) for s in whole] == [len(s) for s in parts] == [len(brute_shingles(t.decode(), 3)) for t in (text, b"", b"A a")]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[int(rng.integers(len(words)))] = f"n{rng.integers(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k,percent,tile", [(3, 90, 1024), (5, 80, 4), (3, 90, 3)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, tile):
    rng = np.random.default_rng(k)
    rows = [(i, " ".join(f"w{rng.integers(40)}" for _ in range(int(rng.integers(0, 30))))) for i in range(60)]
    for g in range(6):  # groups of near copies, some of them chains just at the threshold
        base = [f"g{g}w{rng.integers(200)}" for _ in range(60 + 20 * g)]
        rows += [(1000 + 100 * g + i, edited(base, rng, int(rng.integers(0, 5)))) for i in range(12)]
        common = " ".join(base[:40])
        rows += [(5000 + 100 * g + i, common + " " + " ".join(f"z{rng.integers(10**6)}" for _ in range(25))) for i in range(8)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, rows[70][1]), (9006, rows[70][1]),
             (None, rows[75][1]), (None, None), (9007, " x y z"), (9008, "É x y"), (9009, "é x y")]
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "LEADER_ROWS", 3)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, component int, signs string").repartition(3)
    assert joined(df, k, percent) == brute_components(rows, k, percent)
    kept = jaccard.keep_one(df, k, percent)
    assert kept.columns == df.columns
    want = brute_components(rows, k, percent)
    alone = [r for r in want if r[1] == 0]
    assert kept.count() == len({r[2] for r in want if r[1]}) + len(alone)


def test_join_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in catalog.QUERIES["op4_jaccard_components"](spark, sf_dir).collect()), key=str)
    assert got == brute_components(rows, 3, 90)


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q w e r t y"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "n o p q r s"),
            (3, ""), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "q w e r t y"), (None, "n o p q r s"), (3, ""), (3, ""), (4, None)], key=str)
    assert jaccard.keep_one(df.limit(0)).collect() == [] and joined(df.limit(0), 3, 90) == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(links.limit(0)).collect() == []


# ---- nearest neighbours

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v
          and len(v) == 4 and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(x, y)), i) for i, y in ok if i != q)[:k]
            out[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("bin_rows", [8, 8192])
def test_search_of_odd_vectors(spark, bin_rows):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1 + i % 3)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.5, 0.25]) for i in range(40)]  # equal vectors
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [1.0, 2.0]),
             (None, [1.0] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (320, [])]
    df = vectors(spark, rows)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), recall=1.0, bin_rows=bin_rows, group_queries=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute_nearest(rows)
    few = vectors(spark, rows[:6])
    assert sorted(r["vec_id"] for r in ann.search(few, few.filter("vec_id % 20 = 0")).collect()) == [1, 2, 3, 4, 5]
    assert ann.search(df.limit(0), df.limit(0)).collect() == [] and ann.search(df, df.limit(0)).collect() == []


def test_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    got = catalog.QUERIES["op6_kmeans_tree"](spark, sf_dir).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hits += len(set(own["vec_id"]) & set(ids[np.lexsort((ids, -s))[:20]]))
        assert own.sort_values("rank")["score"].is_monotonic_decreasing and len(own) == 20
    assert hits / len(got) >= 0.9 and set(got["query_id"]) == set(ids[ids % 20 == 0])


# ---- fingerprints

def test_next_document_and_edit(spark):
    rows = [(5, "five\nlines of text"), (9, None), (7, "seven words are in this text here"), (7, "another seven"), (None, "no id"), (3, "x" * 10), (1, "é" * 7)]
    df = spark.createDataFrame([(*r, 0, "v") for r in rows], "doc_id long, text string, chunk int, vector string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[:len(t) - m] + n[:m]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.edit_report(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = fingerprint.edit_report(df.filter("doc_id = 9")).collect()
    assert (one[0]["n_chars"], one[0]["near_edited"], one[0]["near_next"]) == (0, 1.0, 1.0)
    assert fingerprint.edit_report(df.limit(0)).collect() == []


def test_sums_of_paragraphs(spark):
    a, b, c = "first paragraph of some words\nsecond one", "third paragraph", "second one\nfirst paragraph of some words"
    df = fingerprint.fingerprints(spark.createDataFrame([(a, b, c, a + "\n" + b)], "a string, b string, c string, ab string"), "a", "va")
    for name in ("b", "c", "ab"):
        df = fingerprint.fingerprints(df, name, f"v{name}")
    from pyspark.sql import functions as F

    row = df.select("va", "vb", "vc", "vab", fingerprint.insert(F.col("va"), F.col("vb")).alias("sum"),
                    fingerprint.delete(F.col("vab"), F.col("vb")).alias("rest")).first()
    assert row["va"] == row["vc"] != row["vab"] and row["sum"] == row["vab"] and row["rest"] == row["va"]


def test_likeness_follows_the_edit(spark, sf_dir):
    rows = catalog.QUERIES["op10_fingerprints"](spark, sf_dir).toPandas()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().merge(rows, on="doc_id")
    assert texts.groupby("text")["fingerprint"].nunique().max() == 1 and texts.groupby("fingerprint")["text"].nunique().max() == 1
    assert rows["near_edited"].between(0, 1).all() and rows["near_next"].between(0, 1).all()
    long = rows[rows["n_chars"] > 400]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.99 and abs(long["near_edited"].median() - 2 / 3) < 0.1


def brute_runs(text):
    words = [p.split() for p in (text or "").split("\n")]
    return Counter(tuple(w[i:i + 4]) for w in words for i in range(max(1, len(w) - 3)) if w)


def test_runs_overlap(spark):
    rng = np.random.default_rng(6)
    words = [f"w{rng.integers(10**6)}" for _ in range(1000)]
    line = " ".join(words)
    pairs = [(line, "front " + line), (line, " ".join(words[:500] + words[501:])), (line, " ".join(words[::-1])), ("a b c", "a\tb  c"),
             ("a b c d e\n\nf", "f\na b c d e"), (line, line + "\n" + " ".join(f"x{i}" for i in range(1003))), (None, "a"), ("é " * 300, "é " * 150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = fingerprint.with_likeness(fingerprint.fingerprints(fingerprint.fingerprints(df, "a", "va"), "b", "vb"), "va", "vb", "near")
    for r in df.collect():
        a, b = brute_runs(r["a"]), brute_runs(r["b"])
        assert (r["va"][0], r["vb"][0]) == (a.total(), b.total())
        dot = lambda x, y: sum(n * y[k] for k, n in x.items())
        assert abs(r["near"] - 2 * dot(a, b) / (dot(a, a) + dot(b, b))) < 0.3, (r["a"] or "")[:20]
    near = [r["near"] for r in df.collect()]
    assert near[0] > 0.95 and near[1] > 0.95 and near[2] < 0.3 and near[3] == near[4] == 1.0


def colliding_texts():
    """Two texts of 16 printable bytes with one XXH64 under Spark's seed of 42."""
    p1, p2, p4, p5, full = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & full
    step = lambda k: turn(k * p2 & full, 31) * p1 & full
    state = lambda k: (turn((42 + p5 + 16) ^ step(k), 27) * p1 + p4) & full
    number = lambda b: int.from_bytes(b, "little")
    first, second = b"aaaaaaaa", b"bbbbbbbb"
    want = state(number(first)) ^ step(number(second))
    for i in range(10**6):
        other = b"%08d" % i
        last = turn((state(number(other)) ^ want) * pow(p1, -1, 1 << 64) & full, 33) * pow(p2, -1, 1 << 64) & full
        last = last.to_bytes(8, "little")
        if all(33 <= c <= 126 for c in last):
            return (first + second).decode(), (other + last).decode()


def test_lanes_do_not_collide_together(spark):
    texts = colliding_texts()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.selectExpr("xxhash64(text)").distinct().count() == 1
    a, b = (r["fingerprint"] for r in fingerprint.fingerprints(df).collect())
    assert all(x != y for x, y in zip(a[1:1 + fingerprint.EXACT], b[1:1 + fingerprint.EXACT])) and a[5:] != b[5:]


def test_bits_are_counted_over_many_hashes(spark):
    rng = np.random.default_rng(8)
    for n in (0, 1, 127, 128, 1000):
        hashes = [int(x) for x in rng.integers(-2**63, 2**63, n)] if n != 1000 else [-1] * n
        df = spark.createDataFrame([(hashes,)], "h array<long>")
        got = df.select(fingerprint._counted_bits(df["h"]).alias("c")).first()["c"]
        assert got == [sum(sum(h >> i + 21 * k & 1 for h in hashes) << 21 * k for k in range(3)) for i in range(21)]


# ---- mixture

def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > repeats * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(repeats * sizes[s]) for s in over}
        open_, left = open_ - over, left - sum(repeats * sizes[s] for s in over)
    return target


def test_knapsack_hits_the_budget():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = sorted({int(x) for x in rng.integers(0, 400, 8)})
        counts = [int(x) for x in rng.integers(1, 9, len(sizes))]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = int(rng.integers(0, total + 10))
        reach = {0}
        for s, c in zip(sizes, counts):
            reach = {r + s * n for r in reach for n in range(c + 1)}
        taken = mixing.fit_counts(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert abs(sum(s * t for s, t in zip(sizes, taken)) - budget) == min(abs(r - budget) for r in reach)
        near = mixing.fit_counts(sizes, counts, budget, window=800)  # most of it taken in proportion
        assert abs(sum(s * t for s, t in zip(sizes, near)) - min(budget, total)) <= 400
    assert mixing.fit_counts([7], [3], 10) == [1] and mixing.fit_counts([7], [3], 11) == [2] and mixing.fit_counts([0], [4], 5) == [0]


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["b", "a", None, "ü", "", "tiny"][int(rng.integers(0, 5))]) for i in range(900)]
    rows += [(2000, "one word", "tiny"), (2001, None, "empty"), (2002, "", "empty"), (2003, "x " * 5000, "b")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, _copies int")
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = {d: len((t or "").split()) for d, t, _ in rows}
    sources = {s: sum(size[d] for d, _, x in rows if x == s) for s in {r[2] for r in rows}}
    targets, taken = brute_targets(sources), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sources[r["source"]] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert abs(taken[s] - targets[s]) <= 1
    mixed = mixing.mix(df)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == df.columns and copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.mix_report(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def test_cut_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rows = [(i % 150, "a b c", "s" if i % 3 else "t") for i in range(300)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s", "t"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9  # two rows of one id share a decision


def test_null_and_repeated_ids_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(None, f"w{i} b c", "s") for i in range(300)] + [(None, "a b c", "t")] * 150 + [(7, "x y z", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_report(df).collect()
    mixed = Counter(r["source"] for r in mixing.mix(df).collect())
    assert len(got) == len(rows)
    for s in ("s", "t", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1.5 and mixed[s] == sum(r["copies"] for r in own)
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1


# ---- classifier

def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = catalog.QUERIES["op7_quality_pu"](spark, big).toPandas().merge(spark.read.parquet(f"{big}/labels.parquet").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and ((held["score"] >= 0.3) == held["predicted"]).all()
    assert held[held["quality"] == 1]["predicted"].mean() > 0.98


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", (labels["quality"] + (quality.fold(labels["doc_id"]) == 0).cast("int")) % 2)
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some text", "x"), (3, "fine text here.", "x"), (3, "fine text here.", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 1), (3, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = quality.report(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert quality.report(docs.limit(0), labels).collect() == [] and len(quality.report(docs, labels.limit(0)).collect()) == 5
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_risk_is_not_driven_below_zero():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (60, 30)), np.concatenate((rng.normal(1, 1, (60, 30)), rng.normal(-1, 1, (140, 30))))
    w, b = quality.fit_pu(p, u, 0.3)
    soft = lambda z: np.logaddexp(0, z).mean()
    assert soft(u @ w + b) - 0.3 * soft(p @ w + b) > -0.05
    assert ((rng.normal(1, 1, (500, 30)) @ w + b > 0).mean() > 0.95) and ((rng.normal(-1, 1, (500, 30)) @ w + b < 0).mean() > 0.95)


# ---- licences

def test_licences_in_other_dress(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    body = [t for n, t in licenses.TEXTS if n == "MIT"][0]
    bsd = [t for n, t in licenses.TEXTS if n == "BSD-3-Clause"][0]
    docs = [
        (1, "Copyright (c) 2020 Some One\n\n" + body), (2, "The MIT Licence (MIT)\nCopyright 2021, A\n" + body.upper().replace(",", " ,")),
        (3, body.replace("sublicense", "sub-licence").replace("\n", "   ")), (4, "© 2019 B. All rights reserved.\n" + bsd + "\n\n"),
        (5, body + " and more"), (6, "Released under the MIT Licence\ntext\nreleased UNDER the mit license."), (7, None), (8, ""), (9, "..."),
        (1, "Copyright (c) 2020 Some One\n\n" + body), (None, mit), (10, "Licensed under CC BY-NC 4.0."),
        (11, [t for n, t in licenses.TEXTS if n == "Zlib"][0].replace("acknowledgment", "acknowledgement")),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")
    known, notices = (spark.createDataFrame(list(r), "license string, text string") for r in (licenses.TEXTS, licenses.NOTICES))
    got = [(r["doc_id"], r["license"], r["n_notices"], r["notice"]) for r in licenses.scan(df, known, notices).collect()]
    want = [(1, "MIT", 0, None), (2, "MIT", 0, None), (3, "MIT", 0, None), (4, "BSD-3-Clause", 0, None), (5, None, 0, None), (6, None, 2, "MIT"),
            (7, None, 0, None), (8, None, 0, None), (9, None, 0, None), (1, "MIT", 0, None), (None, "MIT", 0, None),
            (10, None, 1, "CC-BY-NC-4.0"), (11, "Zlib", 0, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0), known, notices).collect() == []


def test_all_licences_of_a_text(spark):
    gpl, mit = "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License."
    docs = [(1, f"{mit}\nwords\n{gpl}\n{mit}"), (2, "# Copyright (c) 2020 X. Licensed under the MIT License."), (3, "Copyright (c) 2020 X"), (4, None),
            (5, "(c) 2020 Y. Licensed under CC BY-NC 4.0.\n" + gpl), (6, "words. Licensed under the MIT License.")]
    known, notices = (spark.createDataFrame(list(r), "license string, text string") for r in (licenses.TEXTS, licenses.NOTICES))
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), known, notices).collect()
    assert {r["doc_id"]: r["notices"] for r in got} == {1: ["GPL-3.0", "MIT"], 2: ["MIT"], 3: [], 4: [], 5: ["CC-BY-NC-4.0", "GPL-3.0"], 6: []}
    assert {r["doc_id"]: (r["n_notices"], r["notice"]) for r in got}[1] == (3, "GPL-3.0")


def test_licence_lines_are_split_and_searched_once_a_row(spark):
    """Each notice reads the same copyright lines; they are made once, not once for each notice."""
    known, notices = (spark.createDataFrame(list(r), "license string, text string") for r in (licenses.TEXTS, licenses.NOTICES))
    docs = spark.createDataFrame([(1, "(c) 2020 Y. Licensed under CC BY 4.0.\nwhilst https")], "doc_id long, text string")
    found = licenses.scan(docs, known, notices)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("split(") == 1
    assert [(r["n_notices"], r["notices"]) for r in found.collect()] == [(0, ["CC-BY-4.0"])]


def test_words_built_alike_do_not_collide(spark):
    """Thue-Morse words: sums of powers of any odd base agree on them modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, other), (3, one), (4, f"{one} x y"), (5, f"{other} x y")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(df, k=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rows_without_ids_are_compared_with_their_own_texts_only(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS_OF_ROWS) for _ in range(60)) for _ in range(40)]
    rows = [(None, t) for t in base] + [(None, f"{t} more") for t in base] + [(7, t + " more still") for t in base[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.join(df, k=3, percent=90).select("doc_id", "component", "component_id").collect()
    assert len(found) == 90 and len({r["component"] for r in found}) == 40
    assert sum(r["component_id"] == 7 for r in found) == 30


WORDS_OF_ROWS = [f"w{i}" for i in range(500)]
