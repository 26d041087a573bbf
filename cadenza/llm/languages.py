"""Language ID by a bit-sliced Bloom filter of n-grams.

Each slot of the filter holds a bit for each language, in as many 64-bit words as there are languages for: the languages' filters side
by side. The slots of an n-gram, joined by AND, are the mask of all languages that have it. A text's n-grams are counted by language (popcounts
of the bit slices), the counts are corrected for what the filter's fill gives by chance, and the greatest decides.

An n-gram is three letters in lower case, with one blank for each run of what is no letter. A language has an
n-gram if that is at least SHARE of all its n-grams. So a language has at most 1 / SHARE n-grams, however large the corpus, and
the filter has BITS slots for each n-gram that any language has, so its fill stays the same for any number of languages. Counts are over all rows
that may be learned from, summed in tasks first and then in Spark.

Nulls, empties, repeats: a text that is null or has no letter is ``und`` with score 0, and so is all if there is nothing
to learn from; a null id counts as the empty text for the split; rows repeat as they are; an empty table gives an
empty result; other columns are ignored. Ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

SHARE = 1e-5
#: Slots for each n-gram (at least; their number is a power of two), and places of an n-gram among them.
BITS, PLACES = 16, 3
NONE = "und"
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 1_000_000
#: N-grams of a text that are looked up at a time.
STEP = 1 << 16
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """63-bit codes of the n-grams of ``text``; none if it has no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]


def slots(codes: np.ndarray, n: int) -> list[np.ndarray]:
    return [(wordhash.mix(codes.astype(np.uint64) ^ np.uint64(seed)) & np.uint64(n - 1)).astype(np.int64) for seed in _SEEDS[:PLACES]]


def _emit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def squeeze(parts: list) -> list:
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return [(codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, n = squeeze(parts)[0]
            yield pa.record_batch({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": n})
        held.clear()

    for batch in common.slices(batches):
        fresh: dict[str, list] = {}
        for lang, text in zip(common.column(batch, "lang"), common.column(batch, "text")):
            fresh.setdefault(lang, []).append(ngrams(text))
        for lang, found in fresh.items():
            codes, n = np.unique(np.concatenate(found), return_counts=True)
            parts = held.setdefault(lang, [])
            parts.append((codes, n))
            if len(parts) >= 8:
                held[lang] = squeeze(parts)
        if sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
            yield from flush()
    yield from flush()


class Filter:
    """Languages by bit, and the slots' masks: a row a slot, a column for 64 languages."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        self.chance = self.popcounts(masks) / max(1, len(masks)) if langs else np.zeros(0)
        self.chance **= PLACES

    def popcounts(self, held: np.ndarray) -> np.ndarray:
        """For each language, the rows that have its bit."""
        bits = np.arange(64, dtype=np.uint64)
        each = [(held[:, w : w + 1] >> bits[: len(self.langs) - 64 * w] & np.uint64(1)).sum(axis=0) for w in range(held.shape[1])]
        return np.concatenate(each).astype(float)

    def holding(self, codes: np.ndarray) -> np.ndarray:
        """Masks of the languages that have each n-gram."""
        out = None
        for s in slots(codes, len(self.masks)):
            out = self.masks[s] if out is None else out & self.masks[s]
        return out

    def predict(self, text: str) -> tuple[str, float]:
        codes = ngrams(text)
        if not len(codes) or not self.langs:
            return NONE, 0.0
        counts = sum(self.popcounts(self.holding(codes[at : at + STEP])) for at in range(0, len(codes), STEP))
        fair = np.maximum(0.0, (counts - len(codes) * self.chance) / np.maximum(1e-9, 1 - self.chance))
        best = int(np.argmax(fair))
        return self.langs[best], float(fair[best] / fair.sum()) if fair.sum() > 0 else 0.0


def learn(rows: DataFrame, share: float = SHARE) -> Filter:
    """The filter of ``rows`` (lang, text); null languages are left out. The driver gets at most 1 / ``share`` n-grams a language."""
    counts = common.materialize(rows.where("lang is not null").mapInArrow(_emit_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    langs = [r["lang"] for r in totals]
    if not langs:
        return Filter([], np.zeros((1, 1), np.uint64))
    places = [(r["lang"], r["total"], k >> 6, 1 << (k & 63) if (k & 63) < 63 else -(1 << 63)) for k, r in enumerate(totals)]
    places = rows.sparkSession.createDataFrame(places, "lang string, total long, word int, bit long")
    held = counts.join(F.broadcast(places), "lang").where(F.col("n") >= share * F.col("total"))
    found = held.groupBy("code", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    codes, word, mask = found["code"].to_numpy(), found["word"].to_numpy(), found["mask"].to_numpy().view(np.uint64)
    n = 1 << max(6, (BITS * len(np.unique(codes)) - 1).bit_length())
    out = np.zeros((n, -(-len(langs) // 64)), np.uint64)
    for s in slots(codes, n):
        np.bitwise_or.at(out, (s, word), mask)
    return Filter(langs, out)


def _emit_predictions(own: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [own.predict(t) for t in common.column(batch, "text")]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that aren't held out (crc32 of the id as text, modulo 4, is 2)."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rows = common.id_text(docs, F.col(lang_col).alias("lang"), id_col=id_col, text_col=text_col).withColumn("held_out", held)
    own = learn(rows.where("not held_out").select("lang", "text"))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_emit_predictions(own), "doc_id long, held_out boolean, lang_pred string, score double")
