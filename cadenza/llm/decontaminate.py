"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and parted at everything but letters and digits (all non-ASCII bytes count as letters). For each
document and benchmark item that share a run of SEED words, tiles are laid: again and again the longest run of
words that both have and that no tile covers yet is marked in both, down to SEED words. The share of the item's
words under tiles is its coverage, in whatever order the document has the passages. A document is contaminated by an
item if coverage is at least THRESHOLD.

Runs are found by running Karp-Rabin: a rolling hash of SEED words at each place of the text is looked up among the
benchmark's, first in a bit table, then exactly. The distinct seeds of a text say first which items they can cover enough of; only for
these, one after the other and some HITS at a time, places that follow each other on a diagonal are joined to runs. Runs are
taken longest first (ties: earlier in the item, then in the text), and what earlier tiles cut off goes back as
shorter runs.

The benchmark's index goes to the tasks in blocks of at most BLOCK_CHARS characters, one at a time: a larger benchmark takes
more passes over the texts, not more memory. No text is shuffled.

Nulls, empties, repeats: documents and items without words match nothing; items shorter than SEED words are sought
whole; repeated rows, ids and items give repeated rows; a null item_id or doc_id is kept; an empty table on either
side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

SEED, THRESHOLD = 5, 0.8
#: Characters of benchmark text in one block of the index (about 40 bytes of index a word).
BLOCK_CHARS = 4_000_000
#: Places of seeds that are joined to runs at a time.
HITS = 1 << 20
_BITS = 22


def hashes_of(texts: list[str | None]) -> list[np.ndarray]:
    return wordhash.words_of([(t or "").lower().encode() for t in texts], wordhash.NOT_WORD)


def hashes(text: str | None) -> np.ndarray:
    return hashes_of([text])[0]


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int = SEED):
        self.items = [(i, hashes(t)) for i, t in items]
        self.items = [(i, h) for i, h in self.items if len(h)]
        self.seed = seed
        self.tables = {}
        for k in sorted({min(seed, len(h)) for _, h in self.items}):
            own = [(x, wordhash.shingles(h, k)) for x, (_, h) in enumerate(self.items) if min(seed, len(h)) == k]
            seeds = np.concatenate([s for _, s in own])
            item = np.concatenate([np.full(len(s), x) for x, s in own])
            place = np.concatenate([np.arange(len(s)) for _, s in own])
            order = np.argsort(seeds, kind="stable")
            flags = np.zeros(1 << _BITS, bool)
            flags[(seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            self.tables[k] = seeds[order], item[order], place[order], flags

    def runs(self, text: np.ndarray, threshold: float = 0.0) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Each item that the seeds of ``text`` can cover ``threshold`` of: (length, place in item, place in text) of the longest common runs."""
        for k, (seeds, item, place, flags) in self.tables.items():
            own = wordhash.shingles(text, k)
            at = np.flatnonzero(flags[(own & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
            distinct, which, times = np.unique(own[at], return_inverse=True, return_counts=True)
            order, begin = at[np.argsort(which, kind="stable")], np.cumsum(times) - times
            low = np.searchsorted(seeds, distinct, "left")
            n = np.searchsorted(seeds, distinct, "right") - low
            total = int(n.sum())
            hit = np.repeat(low, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            by_item = np.lexsort((place[hit], item[hit]))
            seed, hit = np.repeat(np.arange(len(low)), n)[by_item], hit[by_item]
            x, q = item[hit], place[hit]
            new = np.flatnonzero(np.r_[True, np.diff(x) != 0][:total])
            step = np.full(total, k)
            step[:-1] = np.where(np.diff(x) == 0, np.minimum(k, np.diff(q)), k)
            covered = np.add.reduceat(step, new) if total else step
            for start, end, most in zip(new.tolist(), [*new[1:].tolist(), total], covered.tolist()):
                if most >= threshold * len(self.items[x[start]][1]):
                    yield int(x[start]), self._joined(q[start:end], seed[start:end], order, begin, times, k)

    @staticmethod
    def _joined(q: np.ndarray, seed: np.ndarray, order: np.ndarray, begin: np.ndarray, times: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Runs of the hits of one item at places ``q``: each with all places of its seed in the text."""
        stretches, n = [], times[seed]
        part = (np.cumsum(n) - n) // HITS
        for own in np.split(np.arange(len(q)), np.flatnonzero(np.diff(part)) + 1):
            c = n[own]
            p = order[np.repeat(begin[seed[own]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            stretches.append(_stretches(p - np.repeat(q[own], c), np.repeat(q[own], c), np.ones(len(p), np.int64)))
        diagonal, start, size = (np.concatenate(x) for x in zip(*stretches))
        if len(stretches) > 1:
            diagonal, start, size = _stretches(diagonal, start, size)
        return list(zip((size + k - 1).tolist(), start.tolist(), (start + diagonal).tolist()))


def _stretches(diagonal: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, start, size) of the stretches with those joined that follow each other on a diagonal."""
    order = np.lexsort((start, diagonal))
    diagonal, start, size = diagonal[order], start[order], size[order]
    new = np.flatnonzero(np.r_[True, (np.diff(diagonal) != 0) | (start[1:] != start[:-1] + size[:-1])])
    return diagonal[new], start[new], np.add.reduceat(size, new)


def tiles(runs: list[tuple[int, int, int]], n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in text) out of common runs."""
    in_item, out, left = np.zeros(n_item, bool), [], n_item
    in_text = np.zeros(max((p + n for n, _, p in runs), default=0), bool)
    heap = [(-n, q, p) for n, q, p in runs]
    heapq.heapify(heap)
    while heap and left >= least:
        n, q, p = heapq.heappop(heap)
        n = -n
        taken = in_item[q : q + n] | in_text[p : p + n]
        if not taken.any():
            out.append((n, q, p))
            in_item[q : q + n] = in_text[p : p + n] = True
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= least:
                heapq.heappush(heap, (start - end, q + start, p + start))
    return out


OUT = "doc_id long, item_id long, n_item long, n_covered long, n_tiles long, coverage double, contaminated boolean"


def indexes(benchmark: DataFrame, seed: int = SEED, block_chars: int = BLOCK_CHARS, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[tuple[Index, bool]]:
    """The benchmark's index, block by block, and whether a block is the last."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("length(text) > 0")
    total = items.select(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks)))
    for b in range(n_blocks):
        yield Index([(r[0], r[1]) for r in items.where(block == b).orderBy("item_id", "text").toLocalIterator()], seed), b + 1 == n_blocks


def covering(index: Index, text: np.ndarray, threshold: float) -> Iterator[tuple[int | None, int, int, int]]:
    """(item_id, words, covered words, tiles) of the items that ``text`` (its words' hashes) covers enough of."""
    for x, runs in index.runs(text, threshold):
        item_id, words = index.items[x]
        n = len(words)
        laid = tiles(runs, n, min(index.seed, n))
        covered = sum(t[0] for t in laid)
        if covered >= threshold * n:
            yield item_id, n, covered, len(laid)


def _emit(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = [(d, i, n, c, k, c / n, True) for d, words in zip(common.column(batch, "doc_id"), hashes_of(common.column(batch, "text"))) for i, n, c, k in covering(index, words, threshold)]
            types = (pa.int64(),) * 5 + (pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], ["doc_id", "item_id", "n_item", "n_covered", "n_tiles", "coverage", "contaminated"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item with a coverage of at least ``threshold``."""
    docs, found = common.id_text(docs, id_col=id_col, text_col=text_col), []
    for index, is_last in indexes(benchmark, seed, block_chars, item_col, item_text_col):
        part = docs.mapInArrow(_emit(index, threshold), OUT)
        found.append(part if is_last and not found else common.materialize(part, "leaks"))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], OUT)


def _clean(index: Index, threshold: float):
    return lambda texts: [next(covering(index, words, threshold), None) is None for words in hashes_of(texts)]


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; a pass for each block of the benchmark."""
    for index, is_last in indexes(benchmark, seed, block_chars, item_col, item_text_col):
        docs = common.keep_rows(docs, text_col, _clean(index, threshold))
        docs = docs if is_last else common.materialize(docs, "clean")
    return docs
