"""Public tokenizer files by path, loaded once in each worker, and memoised encoders."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from . import wordhash

#: Entries that a memo holds before it is emptied; bounds a worker's memory.
MEMO = 1_000_000


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(file: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class Memo(dict):
    """dict that asks ``make`` for what it lacks and is emptied when it holds MEMO entries."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Spans(NamedTuple):
    """The words of texts that stand one after the other in the bytes ``b`` and end at ``ends``: their ends and entries, but for texts that must be taken ``whole``."""

    b: np.ndarray
    ends: np.ndarray
    start: np.ndarray
    end: np.ndarray
    entry: np.ndarray
    whole: np.ndarray


class SpanEncoder:
    """Ids of whole texts, from the ids of their words, for vocabularies whose ids never reach over a blank.

    A word is what starts at a text's start or at a space or line feed, with that blank. All words of a slice of texts
    are hashed by array operations; each distinct word is encoded once, and ids are gathered from a table, whose
    words are compared byte by byte with those of the texts: a text with a word that only has another's hash is encoded whole. So are texts with
    runs of blanks, with words over LONG bytes, or with what ``odd`` finds.
    """

    #: Words that the table holds before it is emptied (about 30 bytes each).
    WORDS = 600_000
    LONG = 256

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self._empty()

    def whole(self, text: str) -> bytes:
        """Ids of a text, little-endian."""
        raise NotImplementedError

    def learn(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        raise NotImplementedError

    def odd(self, b: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Places of bytes whose texts must be encoded whole, in a list of arrays; ``starts``: of the texts."""
        return [np.flatnonzero(blank[1:] & blank[:-1])]

    def _empty(self) -> None:
        self.keys, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.text = _Lists(self.dtype), _Lists(np.dtype(np.uint64))

    def spans_of(self, texts: list[bytes]) -> Spans:
        """The words of ``texts`` (UTF-8) with their entries in the table."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = b"".join(texts)
        b = np.frombuffer(data, np.uint8)
        blank = (b == 32) | (b == 10)
        new = blank.copy()
        new[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(b)][: len(start)]
        odd = np.concatenate([start[end - start > self.LONG], *self.odd(b, blank, (ends - sizes)[sizes > 0])])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(ends, odd, "right")] = True
        own = ~whole[np.searchsorted(ends, start, "right")]
        start, end = start[own], end[own]
        lanes = wordhash.lanes(b, start, end)
        entry = self._entries(data, start, end, lanes)
        wrong = start[~self._same(entry, lanes)]  # another word has the hash
        whole[np.searchsorted(ends, wrong, "right")] = True
        return Spans(b, ends, start, end, entry, whole)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each of ``texts`` (UTF-8), as little-endian bytes of ``dtype``."""
        own = self.spans_of(texts)
        ids, until = self.ids.gather(own.entry)
        stops = np.r_[0, until][np.searchsorted(own.start, own.ends)].tolist()
        out, before = [], 0
        for k, stop in enumerate(stops):
            out.append(self.whole(texts[k].decode()) if own.whole[k] else ids[before:stop].tobytes())
            before = stop
        return out

    def _entries(self, data: bytes, start: np.ndarray, end: np.ndarray, lanes: wordhash.Lanes) -> np.ndarray:
        """The table's entry of each word, by its hash; words that the table lacks are learned."""
        keys, first, place = np.unique(lanes.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        lacking = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(lacking):
            if len(self.keys) + len(lacking) > self.WORDS:
                self._empty()
                lacking = np.arange(len(keys))
            new = first[lacking]
            where = np.searchsorted(self.keys, keys[lacking])
            self.keys = np.insert(self.keys, where, keys[lacking])
            self.size = np.insert(self.size, where, lanes.size[new])
            ids = self.learn([data[x:y].decode() for x, y in zip(start[new].tolist(), end[new].tolist())])
            self.ids.insert(where, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
            n = lanes.count[new]
            self.text.insert(where, lanes.words[_each(np.cumsum(lanes.count)[new] - n, n)], n)
            at = np.searchsorted(self.keys, keys)
        return at[place]

    def _same(self, entry: np.ndarray, lanes: wordhash.Lanes) -> np.ndarray:
        """Whether each entry is the word itself, byte by byte."""
        same = self.size[entry] == lanes.size
        at = np.where(same, self.text.at[entry], 0)
        differs = self.text.flat[np.repeat(at, lanes.count) + lanes.place if len(lanes.words) != len(at) else at] != lanes.words
        if differs.any():
            same[np.searchsorted(np.cumsum(lanes.count), np.flatnonzero(differs), "right")] = False
        return same


def _each(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ..., ``n`` of each."""
    until = np.cumsum(n)
    return np.repeat(at - until + n, n) + np.arange(until[-1] if len(n) else 0)


class _Lists:
    """Lists of numbers in one growing buffer."""

    def __init__(self, dtype: np.dtype):
        self.flat, self.used = np.zeros(1 << 16, dtype), 0
        self.at = self.n = np.zeros(0, np.int64)

    def insert(self, where: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        """Lists of ``n`` numbers, one after the other in ``flat``, before the places ``where``."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at = np.insert(self.at, where, self.used + np.cumsum(n) - n)
        self.n = np.insert(self.n, where, n)
        self.used += len(flat)

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the entries, one after the other, and where each ends."""
        n = self.n[entry]
        return self.flat[_each(self.at[entry], n)], np.cumsum(n)


def pairs(b: np.ndarray, lead: int, after: tuple[int, ...]) -> np.ndarray:
    """Places of the byte ``lead`` with one of ``after`` behind it."""
    at = np.flatnonzero(b[:-1] == lead)
    return at[np.isin(b[at + 1], after)]


class ByteLevelEncoder(SpanEncoder):
    """Token ids as the tokenizers library gives them.

    The file's pre-tokenizer starts a new part at each single space or line feed. Texts with other white space or with
    a special token's string go to the library whole.
    """

    BATCH = 2000
    WORDS = 2_000_000
    _PLAIN = np.array([b in (9, 11, 12, 13, 28, 29, 30, 31) for b in range(256)])
    #: Bytes that start white space, or marks that libraries disagree about, with what may come after them.
    _LEADS = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), (0xEF, (0xBB,)))

    def __init__(self, file: str):
        self.tok = tokenizer(file)
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        super().__init__(np.dtype("<u2" if self.code == "H" else "<u4"))
        specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.leads = (*self._LEADS, *((s.encode()[0], (s.encode()[1],)) for s in specials))
        self.line = int(np.frombuffer(self.whole("\n"), self.dtype)[0])

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def odd(self, b: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        return [*super().odd(b, blank, starts), np.flatnonzero(self._PLAIN[b]), *(pairs(b, *lead) for lead in self.leads)]

    def learn(self, words: list[str]) -> list[np.ndarray]:
        ids: list[np.ndarray] = [None] * len(words)
        spaced = [k for k, w in enumerate(words) if w[0] == " " and len(w) > 1]
        for at in range(0, len(spaced), self.BATCH):  # many words are lines of one text
            some = spaced[at : at + self.BATCH]
            found = np.array(self.tok.encode_batch_fast(["\n".join([words[k] for k in some]) + "\n"], add_special_tokens=False)[0].ids, self.dtype)
            for k, own in zip(some, np.split(found, np.flatnonzero(found == self.line) + 1), strict=False):
                ids[k] = own[:-1]
        rest = [k for k, own in enumerate(ids) if own is None]
        for k, e in zip(rest, self.tok.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            ids[k] = np.array(e.ids, self.dtype)
        return ids


@lru_cache(maxsize=2)
def byte_level(file: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(file)
