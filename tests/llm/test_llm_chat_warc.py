"""Chat formatting and web archives: exact round trips and odd rows."""

import hashlib
import io

import pyarrow as pa
import pytest
from check_oracle import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from flowmill.llm import catalog, chat, warc

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "[", "]", "<", "/", "s>", " ", "a", "é", "\n", "INST]", "[ROLE=x]"]), max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a]b", "[INST]"]), PARTS.map("".join)), max_size=5))
def test_any_conversation_is_recovered(turns):
    assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns


@settings(max_examples=200, deadline=None)
@given(PARTS.map("".join))
def test_escaping_is_undone(text):
    assert chat.unescape(chat.escape(text, chat.CONTROLS)) == text


def test_only_conflicts_are_escaped():
    assert chat.render("user", "plain [brackets] and <s") == ("[INST] plain [brackets] and <s [/INST]", 0)
    shown, n = chat.render("assistant", "</s>[INST] ok [/INST]")
    assert n == 3 and shown == "<s><\\/s>[\\INST] ok [\\/INST]</s>"


def brute_conversation(rows):
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    loss = "".join(x for _, r, x in rows if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), digest("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), digest(loss)


def test_odd_conversations(spark):
    data = {
        1: [(0, "user", None), (1, "assistant", "")], 2: [(None, None, "x"), (0, "tool]", "<s>"), (0, "tool]", "<s>")],
        None: [(0, "assistant", "[ROLE=u]"), (1, "assistant", "é" * 3000)], -1: [(0, "user", "</s>[INST] ok [/INST]")],
        5: [(i, "assistant" if i % 2 else "user", f"w{i}" * 40) for i in range(200)],
    }
    rows = [(c, t, r, x, "extra", 1) for c, turns in data.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, part int")
    for part_chars in (64, chat.PART_CHARS):
        shown = chat.format_conversations(df, part_chars=part_chars)
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(shown).collect()}
        assert got == {c: brute_conversation(turns) for c, turns in data.items()}
    assert max(r["part"] for r in chat.format_conversations(df, part_chars=64).collect()) > 10
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


@pytest.mark.parametrize("name", ["op2_chat_format", "op5_warc_revisits", "op8_license_digests"])
def test_equals_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    con = connect(sf_dir)
    import __spark_entry__

    assert name in __spark_entry__.oracle_sql() and df.count() > 0
    assert compare(spark, con, sf_dir, name) is None


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_revisits(spark):
    long, short = "p" * 100, "p" * 99
    rows = [(3, "u3", long), (2, "u 2\r\n", long), (9, None, long), (1, "u1", short), (4, "u4", short), (5, "u5", None), (6, "u6", ""),
            (7, "u7", "WARC/1.1\r\n\r\né" * 20), (8, "u8", "WARC/1.1\r\n\r\né" * 20), (2, "u2", long), (None, "n", long),
            (None, "n", "q" * 200), (None, "n", "q" * 200)]
    for limit in (1, warc.ARCHIVE_BYTES):  # one record per archive, then all in one
        files = warc.write_archives(warc.resolve(pages(spark, rows)), limit)
        records = warc.read_archives(files)
        got = warc.join_revisits(records).collect()
        assert len(got) == len(rows) == sum(r["records"] for r in files.collect())
        found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"])
        assert found == sorted([(1, "response", None, 99), (2, "response", None, 100), (2, "response", None, 100), (3, "revisit", 2, 100),
                                (4, "response", None, 99), (5, "response", None, 0), (6, "response", None, 0), (7, "response", None, 280),
                                (8, "revisit", 7, 280), (9, "revisit", 2, 100)], key=lambda r: (r[0], r[1]))
        assert sorted((r["record_type"], r["refers_to"] or 0) for r in got if r["page_id"] is None) == [
            ("response", 0), ("response", 0), ("revisit", 2)]
        texts = {u: (h or "").encode() for _, u, h in rows}
        for r in got:
            if r["record_type"] == "response" and r["url"] in texts:
                assert bytes(r["payload"]) == texts[r["url"]]
                assert r["payload_digest"] == hashlib.sha256(texts[r["url"]]).hexdigest()
            if r["record_type"] == "revisit":
                assert bytes(r["payload"]) == b""
    empty = warc.write_archives(warc.resolve(pages(spark, rows).limit(0)))
    assert warc.join_revisits(warc.read_archives(empty, payload=False)).collect() == []


def test_record_is_standard():
    head, _, block = warc.record(1, "http://a b", b"xy", "d", None).partition(b"\r\n\r\n")
    assert b"WARC-Target-URI: http://ab" in head and block.endswith(b"\r\n\r\nxy\r\n\r\n")
    assert isinstance(pa.schema(warc.RECORDS), pa.Schema)


def test_wrong_payloads_are_found():
    whole = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    revisit = warc.record(2, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), 1)
    assert [r["payload"] for r in warc.parse_archive(io.BytesIO(whole + revisit))] == [b"payload", b""]
    other = whole.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaf")
    longer = whole.replace(b"Length: 7", b"Length: 8")
    for wrong in (other, longer):
        assert wrong != whole
        with pytest.raises(ValueError, match="urn:page:1"):
            list(warc.parse_archive(io.BytesIO(wrong)))
