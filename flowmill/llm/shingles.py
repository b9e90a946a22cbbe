"""Word shingles as sorted arrays of 64-bit hashes, and signatures of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 20
SKETCH_BITS = 1024
BAND = 1.35  # largest over smallest set size in a band
SMALL = 64  # up to that size a set signs contents with one element deleted

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seed(n: int) -> np.ndarray:
    return mix(np.array([n * 0x9E3779B97F4A7C15 & (1 << 64) - 1], _U))


_LOWER = np.arange(256, dtype=_U)
_LOWER[65:91] = _LOWER[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, start)`` of every word: the sum of a number for each letter at its place in the word.

    Those numbers follow no rule, so words that are built alike do not collide, however long.
    """
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    place = np.arange(len(data), dtype=_U)
    first = np.zeros(len(data), _U)
    first[starts] = starts
    place -= np.maximum.accumulate(first)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix((place << _U(8) | _LOWER[data]) + _U(0x9E3779B97F4A7C15)))))
    return mix(sums[ends] - sums[starts]), starts


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A long text in stretches that end at white space."""
    at = 0
    while len(raw) - at > CHUNK:
        window = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, CHUNK, at)])
        if len(window):
            end = at + int(window[-1]) + 1
        else:
            rest = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, offset=at)])
            end = at + int(rest[0]) + 1 if len(rest) else len(raw)
        yield raw[at:end]
        at = end
    if at < len(raw):
        yield raw[at:]


def _chain(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    out = np.full(max(0, n), _seed(k)[0])
    for j in range(k):
        out = mix(out ^ words[j:n + j])
    return out


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer than ``k`` words has one shingle, all
    its words, and one without words none."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK - (end - at) - 1):
            size += len(texts[end])
            end += 1
        if end == at + 1 and size > CHUNK:
            words = np.concatenate([_words(s)[0] for s in _stretches(texts[at])] or [np.zeros(0, _U)])
            cuts = np.array([0, len(words)])
        else:
            words, starts = _words(b"\n".join(texts[at:end]))
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
            cuts = np.searchsorted(starts, offsets)
        runs = _chain(words, k)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield np.unique(runs[a:b - k + 1] if b - a >= k else _chain(words[a:b], b - a) if b > a else runs[:0])
        at = end


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    return tuple(int(mix(shingles ^ _seed(s)).sum(dtype=_U).astype(np.int64)) for s in (101, 102))


def parity_sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bit ``i`` tells whether an odd number of shingles fall on ``i``. Two sets differ in at least as many
    elements as their sketches do in bits."""
    odd = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_sketch(shingles: np.ndarray) -> bytes | None:
    """A sketch of four bits per shingle for a set too large for the common one."""
    if len(shingles) <= SKETCH_BITS // 2:
        return None
    return parity_sketch(shingles, 1 << (4 * len(shingles) - 1).bit_length()).tobytes()


def fine_bits(a: bytes, b: bytes) -> int:
    """Differing bits of two fine sketches, the longer one folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count((folded ^ y).view(_U)).sum())


def largest_partner(n: int, percent: int) -> int:
    return n * 100 // percent


def most_differing(total: int, percent: int) -> int:
    """Elements in which two linked sets of ``total`` elements together can differ: from
    ``100 * common >= percent * union``."""
    return (100 - percent) * total // (100 + percent)


@lru_cache
def _schemes(percent: int, upto: int) -> tuple[tuple[int, ...], ...]:
    """``(smallest, largest, largest partner, allotment, segments, spare)`` of the size bands up to a size.

    The cost of an allotment of 2 is a signature for every element, that of 1 is one for every segment, but
    of segments half as large, whose contents more sets share by chance. Small sets can afford 2.
    """
    bands, low = [], 1
    while low <= upto:
        high = max(low, int(low * BAND))
        partner = largest_partner(high, percent)
        differ = most_differing(high + partner, percent)
        if high <= SMALL:
            bands.append((low, high, partner, 2 if differ else 0, differ // 2 + 2, 1))
        else:
            spare = 0
            for _ in range(30):  # as many more segments as may be empty, with a margin of six deviations
                empty = (differ + 1 + spare) * np.exp(-low / (differ + 1 + spare))
                spare = int(np.ceil(empty + 6 * np.sqrt(empty))) if empty > 1e-9 else 0
            bands.append((low, high, partner, 1, differ + 1 + spare, spare))
        low = high + 1
    return tuple(bands)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of which two linked, different sets share at least one.

    A set belongs to the size band of its size; the smaller set's band rules for a pair, so a set
    also signs for lower bands that have partners of its size. The universe is cut into segments by
    a hash; let linked sets of a band differ in at most ``d`` elements. By the band's allotment

    * 1: there are ``d + 1 + spare`` segments, so linked sets agree on more than ``spare`` of them, and
      the content of each segment is signed. An empty content, which many sets would share, is signed
      only by sets with more than ``spare`` empty segments: others agree on one that is not empty.
    * 2: there are ``d // 2 + 1 + spare`` segments, so linked sets differ in at most one element on more
      than ``spare`` of them, and each content and all contents with one element deleted are signed. Again
      the empty content is signed only by sets with more than ``spare`` segments of one element or none.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    bands = _schemes(percent, max(64, 1 << n.bit_length()))
    own = next(i for i, b in enumerate(bands) if b[0] <= n <= b[1])
    content = mix(shingles ^ _seed(103))
    out = []
    for i in range(own, -1, -1):
        _, _, partner, allotment, m, spare = bands[i]
        if partner < n:
            break
        if not allotment:
            continue  # only equal sets are linked
        segment = ((mix(shingles ^ _seed(1000 + i)) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        bounds = np.searchsorted(segment[order], np.arange(m + 1))
        ordered, sizes = content[order], np.diff(bounds)
        running = np.concatenate((np.zeros(1, _U), np.cumsum(ordered)))
        sums = running[bounds[1:]] - running[bounds[:-1]]
        place = mix(_seed(i) + np.arange(1, m + 1, dtype=_U))
        bare = sizes < allotment
        out.append(mix(sums[sizes > 0] ^ place[sizes > 0]))
        if allotment == 2:
            of = segment[order]
            several = sizes[of] > 1
            out.append(mix((sums[of] - ordered)[several] ^ place[of][several]))
        if bare.sum() > spare:
            out.append(mix(place[bare]))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
