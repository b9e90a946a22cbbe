"""Conversations as training text, checked by a grammar round trip.

Grammar of a formatted conversation (no separators between turns)::

    conversation := turn*
    turn         := "[INST] " body " [/INST]"                 role user
                  | "<s>" body "</s>"                         role assistant
                  | "[ROLE=" name "]" body "[/ROLE]"          any other role, percent-encoded
    body         := text without control strings

A control string inside a text gets a backslash after its first character, and one more where
backslashes already stand there, so that taking one away gives the text back. Each rendered turn is
parsed again; as long as the recovered turn differs from its source, one more of the control
strings found in it is escaped.

Turns are rendered where they lie. They are then shuffled by conversation, sorted, and streamed
into parts of bounded length, so a conversation of any length needs no more memory than a part;
its digest is sequential by definition, so one task reads it.

Defined cases: a null text or role counts as empty; turns of a conversation are ordered by
``turn`` (nulls first), then role, then text; repeated rows are repeated turns; a null ``conv_id``
is one conversation. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE=", "[/ROLE]")
TOKEN = re.compile(r"\[INST\]|\[/INST\]|<s>|</s>|\[ROLE=[A-Za-z0-9%._~-]*\]|\[/ROLE\]")
ESCAPED = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
FOUND = {c: re.compile(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})") for c in CONTROLS}
PART_CHARS = 1 << 20
TRAINED = "assistant"


def escape(text: str, controls: tuple[str, ...]) -> str:
    for c in controls:
        text = FOUND[c].sub(lambda m: m[0] + "\\", text)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub("", text)


def frame(role: str) -> tuple[str, str]:
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return "<s>", "</s>"
    return f"[ROLE={quote(role, safe='')}]", "[/ROLE]"


def parse(text: str) -> list[tuple[str, str]] | None:
    """``(role, text)`` of each turn, or None for text that the grammar does not give."""
    turns, at, tokens = [], 0, TOKEN.finditer(text)
    for token in tokens:
        close = next(tokens, None)
        if token.start() != at or close is None:
            return None
        body, opened = text[token.end():close.start()], token[0]
        if opened == "[INST]" and close[0] == "[/INST]":
            if len(body) < 2 or body[0] != " " or body[-1] != " ":
                return None
            role, body = "user", body[1:-1]
        elif opened == "<s>" and close[0] == "</s>":
            role = "assistant"
        elif opened.startswith("[ROLE=") and close[0] == "[/ROLE]":
            role = unquote(opened[6:-1])
        else:
            return None
        turns.append((role, unescape(body)))
        at = close.end()
    return turns if at == len(text) else None


def render(role: str, text: str) -> tuple[str, int]:
    """The rendered turn and how many kinds of control strings had to be escaped in it."""
    controls: tuple[str, ...] = ()
    before, after = frame(role)
    while True:
        shown = before + escape(text, controls) + after
        if parse(shown) == [(role, text)]:
            return shown, len(controls)
        controls += (next(c for c in CONTROLS if c not in controls and FOUND[c].search(text)),)


def rendered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, shown)``, each turn rendered on its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [render(r, t)[0] for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.string())], [*b.schema.names, "shown"])

    empty = F.lit("")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"),
                        F.coalesce("text", empty).alias("text"))
    return rows.mapInArrow(work, f"conv_id {dict(turns.dtypes)['conv_id']}, turn long, role string, text string, shown string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, trained: str = TRAINED, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, formatted, loss)``: each conversation's text, long ones in several parts cut
    between turns; ``loss`` has the spans (code points, end excluded) of the ``trained`` role's texts.
    Parts of a conversation are neighbours, in order, in one partition."""
    kind = dict(turns.dtypes)["conv_id"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", batch_type), ("part", pa.int64()), ("formatted", pa.string()),
                            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        out, held = [], 0
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            part, pieces, spans, size = 0, [], [], 0
            for _, role, shown in rows:
                if size and size + len(shown) > part_chars:
                    out.append((conv_id, part, "".join(pieces), spans))
                    held, part, pieces, spans, size = held + size, part + 1, [], [], 0
                    if held > part_chars:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)
                        out, held = [], 0
                if role == trained:
                    before, after = frame(role)
                    spans.append({"start": size + len(before), "end": size + len(shown) - len(after)})
                pieces.append(shown)
                size += len(shown)
            out.append((conv_id, part, "".join(pieces), spans))
            held += size
            if held > part_chars or len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    ordered = rendered_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "shown").mapInArrow(
        assemble, f"conv_id {kind}, part long, formatted string, loss array<struct<start:long,end:long>>"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, recovered from the rows of :func:`format_conversations`."""
    kind = dict(formatted.dtypes)["conv_id"]
    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("conv_id", batch_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
            n, chars, loss_chars, all_turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for _, _, text, spans in rows:
                turns = parse(text)
                if turns is None:
                    raise ValueError(f"conversation {conv_id!r} does not follow the grammar")
                n, chars = n + len(turns), chars + len(text)
                all_turns.update("".join(f"{role}\n{body}\n" for role, body in turns).encode())
                for span in spans:
                    body = unescape(text[span["start"]:span["end"]])
                    loss_chars += len(body)
                    loss.update(body.encode())
            out.append((conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema=schema)

    return formatted.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long")
