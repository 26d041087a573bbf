"""64-bit hashes of the words and word shingles of a text, by array operations on its bytes.

Two sets of n shingles are mistaken for each other in part with a chance of n**2 / 2**64; where ids must be right, bytes are compared
as well (``vocab.SpanEncoder``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def _random(n: int, seed: int) -> np.ndarray:
    """``n`` 64-bit values by splitmix64."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_LANES = 1 << 12
_KEYS: dict[str, np.ndarray] = {}


def _lane_keys(n: int) -> np.ndarray:
    """A key for each place of eight bytes in a word."""
    if len(_KEYS.get("lanes", ())) < n:
        _KEYS["lanes"] = _random(max(_LANES, 1 << (n - 1).bit_length()), 7)
    return _KEYS["lanes"]


BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII letters and digits, and all bytes above ASCII, make up words; the rest parts them.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: bytes, blank: np.ndarray = BLANK) -> np.ndarray:
    """A hash of each word of ``data``: the longest runs of bytes that aren't ``blank``."""
    return words_of([data], blank)[0]


def words_of(texts: list[bytes], blank: np.ndarray = BLANK) -> list[np.ndarray]:
    """The word hashes of each text, in one pass over all; a space must be a blank."""
    b = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = bounds(b, blank)
    hashes = spans(b, starts, ends)
    stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    return [hashes[start:stop] for start, stop in zip([0, *stops], stops)]


def bounds(b: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the bytes ``b``."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~blank[b]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


_LENGTH, _PAD = np.uint64(0xD6E8FEB86659FD93), np.zeros(8, np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Lanes(NamedTuple):
    """Spans of bytes, eight at a time: the ``words``, the ``place`` of each in its span, how many words (``count``) and bytes (``size``) a span has."""

    words: np.ndarray
    place: np.ndarray
    count: np.ndarray
    size: np.ndarray

    def hashes(self) -> np.ndarray:
        """Eight bytes at a time go through a mixer with a key of their place; the sum goes through it again with the length. Spans of up to eight bytes
        never share a hash but by a chance of 2**-64; no structure of longer ones cancels, as it does in polynomials modulo 2**64."""
        if not len(self.count):
            return np.zeros(0, np.uint64)
        out = mix(self.words ^ _lane_keys(int(self.count.max()))[self.place])
        if len(self.words) != len(self.count):
            out = np.add.reduceat(out, np.cumsum(self.count) - self.count)
        return mix(out + self.size.astype(np.uint64) * _LENGTH)


def lanes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Lanes:
    size = ends - starts
    count = np.maximum((size + 7) >> 3, 1)
    last = np.cumsum(count)
    if not len(size) or last[-1] == len(size):
        place, at, left = np.zeros(len(size), np.int64), starts, size
    else:
        place = np.arange(last[-1]) - np.repeat(last - count, count)
        at, left = np.repeat(starts, count) + 8 * place, np.repeat(size, count) - 8 * place
    padded = np.concatenate([b, _PAD])
    eights = np.lib.stride_tricks.as_strided(padded, (len(b) + 1, 8), (1, 1))
    return Lanes(eights[at].view(np.uint64).ravel() & _MASKS[np.minimum(left, 8)], place, count, size)


def spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of the bytes ``b``."""
    return lanes(b, starts, ends).hashes()


PLACES = _random(64, 2) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * PLACES[j]
    return mix(out + np.uint64(k))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, an empty one none."""
    return np.unique(shingles(hashes, min(k, len(hashes)))) if len(hashes) else hashes
