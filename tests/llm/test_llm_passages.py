"""Repeated passages, periodic runs and whitening against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from flowmill.llm import catalog, periods, superkmers, whitening, words

SCHEMA = "doc_id long, text string, words int, mark string, start long"  # with names the operators use themselves


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("name", ["op11_super_kmers", "op13_periodic_runs"])
def test_equals_sql(spark, sf_dir, name):
    assert name in oracle_sql() and compare(spark, connect(sf_dir), sf_dir, name) is None


# ---- words ----------------------------------------------------------------------

ODD = ["", " ", "one", " a\tb\nc\x0bd\x0ce\rf ", "a\x1cb c\x85d e", "é ñandú", "x" * 300, "b" * 70 + " " + "c" * 70, "\x00 \x00"]


def test_words_of_odd_texts(monkeypatch):
    want = [[w.decode() for w in t.encode().split()] for t in ODD]
    codes, offsets, vocabulary = words.coded(pa.array(ODD))
    said = vocabulary.to_pylist()
    assert [[said[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == want
    for texts in (pa.array(ODD), pa.array(["skipped", *ODD]).slice(1)):
        data, starts, ends, offsets = words.bounds(texts)
        got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        assert [got[a:b] for a, b in zip(offsets, offsets[1:])] == want
    assert [(at, len(t)) for at, t in words.chunks(pa.array(["ab", None, "abcd", "a", "b"]), 3)] == [(0, 2), (2, 1), (3, 2)]
    monkeypatch.setattr(superkmers, "BLOCK", 64)  # words longer than a block, too
    data, starts, ends, _ = words.bounds(pa.array(ODD + ODD))
    seen = {}
    for a, b, h in zip(starts, ends, superkmers.word_hashes(data, starts, ends).tolist()):
        assert seen.setdefault(bytes(data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)


# ---- repeated passages ------------------------------------------------------------

def without_repeats(rows, window):
    """By the definition; rows of one id and text are one document."""
    digest = superkmers_digests(rows)
    order = sorted({(i is None, i or 0, d, t or "") for (i, t), d in zip(rows, digest)})
    seen, found = set(), {}
    for null, i, d, text in order:
        said = text.encode().split()
        covered = [False] * len(said)
        for s in range(len(said) - window + 1):
            stretch = tuple(said[s:s + window])
            if stretch in seen:
                covered[s:s + window] = [True] * window
            seen.add(stretch)
        found[null, i, d] = (len(said), sum(covered), b" ".join(w for w, c in zip(said, covered) if not c).decode())
    return sorted((str(i), *found[i is None, i or 0, d]) for (i, _), d in zip(rows, digest))


def superkmers_digests(rows):
    from pyspark.sql import SparkSession

    df = SparkSession.active().createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, text string")
    return [r["d"] for r in df.select("k", superkmers.digest().alias("d")).orderBy("k").collect()]


def passages(seed, vocabulary, n=200):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [say(150) for _ in range(5)]
    rows = []
    for i in range(n):
        a = rng.randrange(300)
        text = f"{say(rng.randrange(30))} {rng.choice(base)[a:a + rng.randrange(600)]} {say(rng.randrange(30))} {rng.choice(base)[a:]}"
        rows.append((rng.choice([None, i, i, i, i // 10]), rng.choice([None, "", " a ", text]) if i % 9 == 0 else text))
    return rows + rows[:15]  # repeated rows


MANY, FEW = [f"w{i}" for i in range(400)], ["a", "bb", "é\t", "d\n"]


@pytest.mark.parametrize(("vocabulary", "window", "mer", "hot", "limit"), [
    (MANY, 20, 3, 20_000, 1 << 30), (MANY, 20, 4, 5, 1 << 30), (FEW, 20, 3, 20, 4000), (MANY, 6, 6, 3, 2000), (FEW, 5, 1, 50, 1 << 30),
])
def test_passages_equal_brute_force(spark, vocabulary, window, mer, hot, limit):
    rows = passages(window + mer, vocabulary)
    got = superkmers.remove_repeats(table(spark, rows), window, mer, hot_mers=hot, limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == without_repeats(rows, window)


def test_passages_do_not_depend_on_partitions(spark):
    rows = passages(3, MANY)
    one, many = (superkmers.report(table(spark, rows, parts)).collect() for parts in (1, 40))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_a_long_monotonous_text(spark):
    rows = [(2, "la " * 60_000), (1, "la " * 30), (3, " ".join(f"n{i}" for i in range(50_000)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in superkmers.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: (30, 29), 2: (60_000, 60_000), 3: (50_000, 0)}


def test_different_windows_with_one_hash():
    """Should hashes agree by chance, words decide."""
    codes = np.array([1, 2, 3, 1, 2, 3, 4, 5, 6, 1, 2, 3])
    at, hashes = np.array([0, 3, 6, 9]), np.zeros(4, np.uint64)
    chosen, group = superkmers._equal_windows(codes, at, hashes, 3)
    by_place = dict(zip(chosen.tolist(), group.tolist()))
    assert by_place[0] == by_place[1] == by_place[3] != by_place[2]


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert superkmers.report(none).collect() == [] and periods.report(none).collect() == []
    assert superkmers.report(table(spark, [(1, None), (2, "")])).select("n_words", "n_removed").distinct().collect() == [(0, 0)]


# ---- periodic runs ----------------------------------------------------------------

def plain_runs(said, min_words, min_periods):
    out, n = set(), len(said)
    for p in range(1, n // min_periods + 1):
        t = 0
        while t + p < n:
            first = t
            while t + p < n and said[t] == said[t + p]:
                t += 1
            length = t - first + p
            if length >= max(min_words, min_periods * p) and not any(
                all(said[x] == said[x + q] for x in range(first, first + length - q)) for q in range(1, p)):
                out.add((first, length, p))
            t += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, kinds, size):
    out = []
    while len(out) < size:
        unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
        out += (unit * 6)[:rng.randrange(1, 6 * len(unit) + 1)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        docs = [repetitive(rng, rng.randrange(1, 4), rng.randrange(0, 50)) for _ in range(rng.randrange(1, 5))]
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        least, times = rng.choice([1, 6, 24]), rng.choice([3, 4])
        want = [(a + int(o), length, p) for d, o in zip(docs, offsets) for a, length, p in plain_runs(d, least, times)]
        got = periods.runs(np.array(sum(docs, []), np.int64), offsets, least, times)
        assert [tuple(r) for r in got.tolist()] == want
    with pytest.raises(ValueError, match="three periods"):
        periods.runs(np.zeros(5, np.int64), np.array([0, 5]), 1, 2)


def collapsed(doc_id, text, rewrite=True):
    """The row of the report, by the definition."""
    said = (text or "").encode().split()
    n, h = len(said), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        said = said[:a] + [said[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(said, 24, 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha(lines), sha(b" ".join(w for i, w in enumerate(said) if i not in gone)))


def test_report_of_runs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([None, i, i // 3]), " ".join(f"w{w}" for w in repetitive(rng, rng.choice([2, 3, 200]), rng.randrange(0, 150)))) for i in range(150)]
    rows += [(500 + i, t) for i, t in enumerate([None, "", "  ", "a " * 23, "a " * 24, " la\tla\n" * 40, "x y " * 12])] + rows[:10]
    for limit in (words.CHUNK_BYTES, 100):
        monkeypatch.setattr(words, "CHUNK_BYTES", limit)
        got = periods.report(table(spark, rows), rewrite=True).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(collapsed(*r)) for r in rows)


def test_runs_of_a_very_long_text(spark):
    unit = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, " ".join([unit] * 20)), (2, "w " * 300_000), (3, " ".join(f"n{i}" for i in range(200_000)))]
    got = {r["doc_id"]: (r["start"], r["length"], r["period"]) for r in periods.report(table(spark, rows)).collect()}
    assert got == {1: (0, 100_000, 5000), 2: (0, 300_000, 1), 3: (None, None, None)}


# ---- whitening --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, size int, dim string"


def vectors(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(parts)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i % 600, v) for i, v in enumerate(x.tolist())]  # repeated ids
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [1.0] * 11 + [float("nan")]), (904, [float("inf")] * 12), (905, [1.0] * 5), (None, x[0].tolist())]
    got = whitening.report(vectors(spark, rows + odd)).collect()
    x = np.concatenate((x, x[:1]))
    whole = np.floor(1024 * x.astype(float)).astype(np.int64) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    cov = np.cov(whole.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    want = (whole - sums / n) @ axes / np.sqrt(values)
    deviation = ((whole * n - sums) ** 2).sum(axis=1)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    for k in range(8):
        mine = sorted((r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        sign = np.sign(sum(a * b for (_, a), b in zip(mine, [w for _, w in sorted(zip(deviation.tolist(), want[:, k]))])))
        theirs = sorted((d, sign * w) for d, w in zip(deviation.tolist(), want[:, k]))
        assert [d for d, _ in mine] == [d for d, _ in theirs]
        assert np.allclose([w for _, w in mine], [w for _, w in theirs], atol=1e-8)
        assert next(r["explained"] for r in got if r["component"] == k + 1) == pytest.approx(values[k] / np.trace(cov), rel=1e-10)


def test_covariances_are_exact(spark):
    """Large numbers, too: nothing is rounded before the matrix is put together."""
    rng = random.Random(6)
    for scale in (1, 10 ** 4, 10 ** 12, 10 ** 30):
        rows = [[rng.randrange(-100, 100) * scale / 7 for _ in range(3)] for _ in range(40)]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
        limit = 1 << 62
        whole = [[max(-limit, min(limit, int(np.floor(1024 * c)))) + 100_000 for c in v] for v in rows]
        parts = whitening._rows(df, "vec_id", "embedding")
        n, sums = whitening._sums(parts)
        assert (n, sums) == (40, [sum(c) for c in zip(*whole)])
        got = whitening.covariance(n, sums, whitening._squares(parts, n, sums))
        for a in range(3):
            for b in range(3):
                exact = sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in whole)
                assert got[a, b] == exact / n ** 3
        found = whitening.report(df).filter("component = 1").collect()
        for r in found:
            exact = sum((n * x - s) ** 2 for x, s in zip(whole[r["vec_id"]], sums))
            assert r["deviation"] == (exact if exact < 1 << 63 else None)


def test_vectors_without_variance(spark):
    same = whitening.report(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}
    flat = whitening.report(vectors(spark, [(i, [float(i), 5.0]) for i in range(5)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and flat[0]["identity_error"] < 1e-9
    assert whitening.report(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.report(spark.createDataFrame([], VECTORS)).collect() == []


def test_queries_of_the_round(spark, sf_dir):
    rows = catalog.QUERIES["op12_whitening"](spark, sf_dir)
    assert rows.count() == 8 * 500 and rows.agg(F.max("identity_error")).first()[0] < 1e-4
