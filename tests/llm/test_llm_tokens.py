"""Packing and token counts against brute force."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowmill.llm import catalog, packing, separators, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "word", "don't STOP it's", "a\x01b \x01 c", "é é Å ẖ H̱", "x y z\u0085w", "a\x1cb\x0bc\x0cd\re",
       "<|endoftext|> in<|startoftext|>side <|ENDOFTEXT|>", "日本語 テキスト", "1234 5.6,7", "word " * 3000, "x" * 5000, "İstanbul ΣΑΣ"]


def reference(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_word_wise_ids_are_the_tokenizers():
    got = dict(tokens.encoded(pa.array(ODD), PATH))
    assert [got[i].tolist() for i in range(len(ODD))] == [reference(t) for t in ODD]


def test_long_texts_in_segments(monkeypatch):
    text = "some words, and more.\n" * 400
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 64)
    got = dict(tokens.encoded(pa.array([text, "short", text]), PATH))
    assert got[0].tolist() == got[2].tolist() == reference(text) and got[1].tolist() == reference("short")
    assert "".join(tokens._segments(text, 50)) == text


def test_piece_lengths():
    for n in range(1, 9000, 7):
        pieces = packing.piece_lengths(n)
        assert sum(pieces) == n and all(p & (p - 1) == 0 and p <= 2048 for p in pieces) and pieces == sorted(pieces, reverse=True)


def check_packed(rows, texts):
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(texts)
    for doc, pieces in found.items():
        ids = np.array([*reference(texts[doc]), 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(i, t, i, 0) for i, t in enumerate(ODD)], "doc_id long, text string, start int, sequence_id int")
    rows = packing.pack(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed(rows, dict(enumerate(ODD)))
    assert len(packing.pack(df.union(df), PATH).collect()) == 2 * len(rows)
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_packing_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packed(catalog.QUERIES["op1_pack_pow2"](spark, sf_dir).collect(), texts)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "x")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df, PATH), str(tmp_path / "packed"))
    lengths = spark.read.parquet(str(tmp_path / "packed")).select("bucket", "length").distinct().collect()
    assert all(r["length"] == 1 << r["bucket"] for r in lengths)


def brute_scan(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = [rng.choice([5, 7], 500, p=[0.05, 0.95]), rng.choice([5, 7], 37, p=[0.5, 0.5]), np.full(90, 7), np.full(20, 5),
             np.array([], int), np.array([5]), np.array([7])]
    rows = []
    for i, ids in enumerate(files):
        path = tmp_path / f"{i}.bin"
        path.write_bytes(ids.astype("<u2").tobytes())
        rows.append((str(path), 2 * len(ids)))
    df = spark.createDataFrame(rows, "path string, n_bytes long")
    for block, upper in ((8, 3), (1, 2), (1 << 20, 1024)):
        got = separators.scan_token_files(df, 5, 2, block, upper).collect()
        for i, ids in enumerate(files):
            mine = sorted((r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got if r["path"] == rows[i][0])
            assert mine == [(n, *want) for n, want in enumerate(brute_scan(ids.tolist(), 5))]


def test_counts(spark, sf_dir):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoder = separators._encoder(ranks, pattern)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["op3_separator_counts"](spark, sf_dir).collect()}
    assert got == {d["doc_id"]: len(encoder.encode_ordinary(d["text"])) for d in docs}
    odd = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, "a b", "p"), (3, "a b", "p"), (None, "<|endoftext|>", "p")],
                                "doc_id long, text string, path string")
    counts = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in separators.count_tokens(odd, ranks, pattern).collect())
    assert counts == [(0, len(encoder.encode_ordinary("<|endoftext|>"))), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert separators.count_tokens(odd.limit(0), ranks, pattern).collect() == []
