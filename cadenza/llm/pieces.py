"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The automaton reads a text once; at each position its output links give all pieces that end there, longest first, and
each relaxes the best score of that position (ties: the longer piece). A character that no one-character piece covers
costs the least score minus 10 and becomes its UTF-8 byte pieces. The result is the segmentation with the
greatest sum of piece scores, as SentencePiece's unigram engine defines it. The installed model file was trained as
BPE: its pieces and scores are used, its merge order isn't (see the README).

No piece has a space mark after another character, and no piece has a line feed, so a text parts into words there
without changing the result; each distinct word goes through the automaton once and its ids are kept in a table of bounded size.

Encoding puts a space mark before a non-empty text and for each space; decoding turns marks into spaces and drops the
first. A text is given back exactly unless it has the mark U+2581 itself, which comes back as a space.

Nulls, empties, repeats: a null or empty text has no ids; rows repeat as they are; null ids are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vocab

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(file: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file, by id."""
    out = []
    for field, value in _fields(open(file, "rb").read()):
        if field == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return out


class Model(vocab.SpanEncoder):
    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.pieces = pieces
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.least = min((s for _, s, kind in pieces if kind == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        for p, s, i in usable:
            self.automaton.add_word(p, (len(p), s, i))
        if usable:
            self.automaton.make_automaton()
        self.parts_words = not any(MARK in p.lstrip(MARK) or "\n" in p for p, _, _ in usable)
        super().__init__(np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4"))
        self.surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in pieces]

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text``, whose spaces are marks."""
        n = len(text)
        best, back = [0.0] + [None] * n, [(0, 0)] * (n + 1)
        done = 0
        single = False

        def close(upto: int) -> None:
            """Positions up to ``upto`` that have all their pieces: the unknown character, where it is needed."""
            nonlocal done, single
            while done < upto:
                done += 1
                if not single:
                    score = best[done - 1] + self.least
                    if best[done] is None or score > best[done]:
                        best[done], back[done] = score, (1, -1)
                single = False

        if n and len(self.automaton):
            for end, (size, score, piece) in self.automaton.iter(text):
                if end > done:
                    close(end)
                before = best[end + 1 - size] + score
                if best[end + 1] is None or before > best[end + 1]:
                    best[end + 1], back[end + 1] = before, (size, piece)
                single = single or size == 1
        close(n)
        out, at = [], n
        while at:
            size, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[at - 1].encode()
                out += [self.bytes[b] for b in reversed(raw)] if all(b in self.bytes for b in raw) else [self.unknown]
            at -= size
        return out[::-1]

    def whole(self, text: str) -> bytes:
        return np.array(self.viterbi(MARK + text.replace(" ", MARK)) if text else [], self.dtype).tobytes()

    def learn(self, words: list[str]) -> list[np.ndarray]:
        """A word starts with its space, with a line feed, or, at the start of a text, with neither: the text's own mark comes before it."""
        return [np.array(self.viterbi(w if w[0] == "\n" else MARK + w.removeprefix(" ")), self.dtype) for w in words]

    def odd(self, b: np.ndarray, blank: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """A blank at the start would stand beside the text's own mark; the mark itself may be in a text."""
        return [*super().odd(b, blank, starts), starts[blank[starts]], vocab.pairs(b, 0xE2, (0x96,)), *([] if self.parts_words else [starts])]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text.encode()])[0], self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model(file: str) -> Model:
    return Model(read_pieces(file))


def _emit_ids(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(file)
        for batch in common.slices(batches, most=1 << 19):
            ids, sizes, digests, exact = [], [], [], []
            texts = common.column(batch, "text")
            for text, found in zip(texts, own.encode_all(texts)):
                found = np.frombuffer(found, own.dtype)
                back = own.decode(found).encode()
                ids.append(found)
                sizes.append(len(found))
                digests.append(hashlib.sha256(back).hexdigest())
                exact.append(back == text)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            made = [pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(exact)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *made], ["doc_id", "ids", "n_pieces", "decoded_sha256", "exact"])

    return run


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_pieces, decoded_sha256 (of the text decoded from the ids), exact (whether it is the text)."""
    return common.id_bytes(docs, id_col=id_col, text_col=text_col).mapInArrow(_emit_ids(file), "doc_id long, ids array<int>, n_pieces long, decoded_sha256 string, exact boolean")


def _emit_texts(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(file)
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                texts = [own.decode(np.array(i or [], np.int64)) for i in common.column(part, "ids")]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_emit_texts(file), "doc_id long, text string")
