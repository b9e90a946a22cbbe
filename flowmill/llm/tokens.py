"""Token ids inside Arrow batches."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowmill.llm import words

MARK = "\x01"  # separates words that are encoded together
CHUNK_BYTES = 4 << 20
KEPT_WORDS = 400_000  # words of which a worker remembers the ids, twice: the latest and those before
JOINED = 2000
SPACE = re.compile(r"[ \t\n\v\f\r]")

# fixed values: the steps of a tokenizer for which words may be taken apart beforehand
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: Letters that composition leaves alone and that have lower-case forms of their own.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: Such letters, then marks that begin neither an abbreviation nor a special token.
PARTS = f"^(?P<letters>{LETTERS})(?P<marks>[.,;:!?]*)$"
ONLY_LETTERS = re.compile(LETTERS)

_loaded: dict = {}


class WordEncoder:
    """The tokenizer of a file, and the ids of the words it has met lately."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        steps = [None if part is None else json.loads(part.__getstate__()) for part in (self.full.normalizer, self.full.pre_tokenizer)]
        self.plain = None
        if steps == [NORMALIZER, PRE_TOKENIZER]:
            # lower-case letters pass those steps unchanged, so the model alone gives their ids
            self.plain = Tokenizer(self.full.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has.

        Words are taken apart into letters and marks, in columns, and each distinct part is looked up once.
        """
        if self.plain is None:
            return self._gathered([words])
        found = pc.extract_regex(words, PARTS)
        fits = found.is_valid()
        letters, marks = (pc.struct_field(found, name) for name in ("letters", "marks"))
        return self._gathered([pc.if_else(fits, pc.utf8_lower(letters), words), pc.if_else(fits, marks, "")])

    def _gathered(self, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are split over columns."""
        raw, codes, known = [], [], 0
        for column in columns:
            distinct = column.dictionary_encode()
            raw += self._known(distinct.dictionary.to_pylist())
            codes.append(distinct.indices.to_numpy() + known)
            known = len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat = np.frombuffer(b"".join(raw), "<u4")
        order = np.column_stack(codes).ravel() if len(codes) > 1 else codes[0]
        return _picked(flat, sizes, order), sum(sizes[c] for c in codes)

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as little-endian unsigned 32-bit numbers."""
        if len(self.young) > KEPT_WORDS:
            self.old, self.young = self.young, {}
        new = self._unknown(parts)
        if self.plain is None:
            self._learn(self.full, new)
        else:
            plain = [w for w in new if ONLY_LETTERS.fullmatch(w)]
            self._learn(self.plain, plain)
            rest = set(new).difference(plain)
            self._learn(self.full, [w for w in new if w in rest])
        return list(map(self.young.__getitem__, parts))

    def _unknown(self, words: Iterable[str]) -> list[str]:
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        return new

    def _learn(self, encoder, words: list[str]) -> None:
        known = self.young
        mark = encoder.encode(MARK, add_special_tokens=False).ids
        together = [w for w in words if MARK not in w] if len(mark) == 1 else []
        for i in range(0, len(together), JOINED):
            part = together[i:i + JOINED]
            ids = np.array(encoder.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == mark[0])
            if len(ends) == len(part) - 1:
                raw, starts = ids.tobytes(), np.concatenate(([0], ends + 1)) * 4
                stops = np.concatenate((ends, [len(ids)])) * 4
                for w, a, b in zip(part, starts.tolist(), stops.tolist()):
                    known[w] = raw[a:b]
        for w in words:
            if w not in known:
                known[w] = np.array(encoder.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


def tokenizer(path: str) -> WordEncoder:
    """The encoder of a file; a worker loads it once."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def _segments(text: str, chars: int = CHUNK_BYTES // 2) -> Iterator[str]:
    """``text`` in runs that end at ASCII white space, so no word is cut."""
    at = 0
    while len(text) - at > chars:
        space = SPACE.search(text, at + chars)
        if space is None:
            break
        yield text[at:space.end()]
        at = space.end()
    yield text[at:]


def _picked(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``codes`` name, one after another; ``sizes`` are those of all stretches."""
    if not len(codes):
        return flat[:0]
    firsts, counts = np.cumsum(sizes) - sizes, sizes[codes]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1]) + np.repeat(firsts[codes] - ends + counts, counts)]


def encode_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)`` of texts without nulls, for a tokenizer that drops white space, so that the
    ids of a text are those of its words: every distinct word is encoded once."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    flat, sizes = tokenizer(path).ids_of(coded.dictionary)
    codes = coded.indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(sizes[codes])))
    words_of = lists.offsets.to_numpy()
    return _picked(flat, sizes, codes), ends[words_of - words_of[0]]


def encoded_chunks(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(position, ids, offsets)`` of neighbouring texts, null as empty; a long text is encoded in segments, alone."""
    for at, part in words.chunks(texts, CHUNK_BYTES):
        if len(part) == 1 and pc.binary_length(part[0]).as_py() > CHUNK_BYTES:
            ids = np.concatenate([encode_words(pa.array([s]), path)[0] for s in _segments(part[0].as_py())])
            yield at, ids, np.array([0, len(ids)])
        else:
            yield at, *encode_words(part, path)


def encoded(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """``(position, ids)`` of each text, null as empty."""
    for at, ids, offsets in encoded_chunks(texts, path):
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield at + i, ids[a:b]
