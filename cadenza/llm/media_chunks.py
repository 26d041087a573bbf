"""Media columns: content-defined chunks, a chunk store without repeats, verified reconstruction.

A payload is cut where a rolling gear hash of its last 32 bytes has ``MASK_BITS`` zero bits on
top, so equal passages give equal chunks wherever they stand. A medium is stored as an ordered
chunk list (recipe: digest and length of each chunk) plus the bytes of chunks.

Where the bytes go:

1. ``repeated_digests``: one pass yields chunk digests only; a grouped count finds those that occur more than once.
2. A Bloom filter of these (size bounded by a parameter, built by ``bit_or`` in Spark) goes to the tasks.
3. ``write_store``: chunks outside the filter occur once for certain and stay in the row of their medium,
   so most bytes are written once, where they were read, and never shuffled. The others go to the shared
   chunk table, one row for each digest. A false positive only moves a chunk that occurs once to that table.
4. ``read_media``: media with inline chunks only are rebuilt where they lie. The others fetch shared chunks by a
   join on digest, once for each distinct medium; rows of documents then join the distinct medium. So a
   medium that a third of all rows share is rebuilt once.

Nulls, empties, repeats: a null text is an empty payload (64 zero bytes); a null doc_id is kept; repeated rows
give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 8192, 11
ALIGN = 64
DIGEST = 32
ENTRY = DIGEST + 4


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 pseudo-random 32-bit values, by splitmix64 from ``seed``."""
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        out.append((z ^ (z >> 31)) >> 32)
    return np.array(out, np.uint32)


GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte, sum of GEAR[byte k places before] << k for k < 32, modulo 2**32; five doubling steps."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for m in (1, 2, 4, 8, 16):
        if len(h) > m:
            low = h[:-m] << np.uint32(m)
            h[m:] += low
    return h


def cut(payload: bytes, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of ``payload``; chunks have ``least`` to ``most`` bytes, but for the last."""
    n = len(payload)
    if n <= least:
        return [n] if n else []
    ends = np.flatnonzero(gear_hashes(payload) < np.uint32(1 << (32 - bits))) + 1
    out, start = [], 0
    while n - start > least:
        at = int(np.searchsorted(ends, start + least))
        end = min(int(ends[at]) if at < len(ends) else n, start + most, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def payload_of(text: bytes) -> bytes:
    """``text`` with zero bytes up to a positive multiple of 64."""
    n = max(ALIGN, -(-len(text) // ALIGN) * ALIGN)
    return text.ljust(n, b"\0")


def _chunks(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    start = 0
    for end in cut(payload):
        part = payload[start:end]
        yield hashlib.sha256(part).digest(), part
        start = end


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _emit_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        found = [d for t in common.column(batch, "text") for d, _ in _chunks(payload_of(t))]
        yield pa.record_batch({"digest": pa.array(found, pa.binary()), "key": pa.array(map(_key, found), pa.int64())})


def repeated_digests(docs: DataFrame) -> DataFrame:
    """digest, key of chunks that occur more than once."""
    return docs.mapInArrow(_emit_digests, "digest binary, key long").groupBy("digest", "key").count().where("count > 1").drop("count")


def _emit_media(words: np.ndarray):
    """A row for each document: recipe, and the bytes of its chunks that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(common.column(batch, "doc_id"), common.column(batch, "text")):
                payload = payload_of(text)
                recipe, inline, shared = [], [], []
                for d, part in _chunks(payload):
                    recipe.append(d + struct.pack("<I", len(part)))
                    again = bloom.may_have(words, _key(d))
                    (shared.append(d) if again else inline.append(part))
                rows.append((doc_id, len(text), hashlib.sha256(payload).digest(), b"".join(recipe), b"".join(inline), list(dict.fromkeys(shared))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())))], ["doc_id", "n_bytes", "media_id", "recipe", "inline", "shared"])

    return run


def _emit_shared(words: np.ndarray):
    """The bytes of chunks that may occur again, once for each digest and slice of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = {d: part for t in common.column(batch, "text") for d, part in _chunks(payload_of(t)) if bloom.may_have(words, _key(d))}
            yield pa.record_batch({"digest": pa.array(found, pa.binary()), "bytes": pa.array(found.values(), pa.binary())})

    return run


def write_store(docs: DataFrame, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, chunks) in the shared folder. ``docs``: doc_id, text (binary). ``store``: chunks (digest, bytes) that are there already; only new ones are written."""
    repeated = common.materialize(repeated_digests(docs), "repeated-digests")
    words = bloom.build(repeated, F.col("key"), repeated.count())
    media = common.materialize(docs.mapInArrow(_emit_media(words), "doc_id long, n_bytes long, media_id binary, recipe binary, inline binary, shared array<binary>"), "media")
    found = docs.mapInArrow(_emit_shared(words), "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    if store is not None:
        found = found.join(store.select("digest"), "digest", "left_anti")
    chunks = common.materialize(found, "chunks")
    return media, chunks if store is None else store.select("digest", "bytes").unionByName(chunks)


def rebuild(recipe: bytes, inline: bytes, shared: dict[bytes, bytes]) -> bytes:
    """The payload; each chunk's digest is verified."""
    out, at = [], 0
    for k in range(0, len(recipe), ENTRY):
        d, n = recipe[k : k + DIGEST], struct.unpack_from("<I", recipe, k + DIGEST)[0]
        part = shared.get(d)
        if part is None:
            part = inline[at : at + n]
            at += n
        if len(part) != n or hashlib.sha256(part).digest() != d:
            raise ValueError(f"chunk {d.hex()} is damaged or missing")
        out.append(part)
    return b"".join(out)


def feature_of(payload: bytes, n_chunks: int) -> str:
    """Mean, deviation and entropy of the 8-bit samples, and the number of chunks."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / max(1, counts.sum())
    mean = float(p @ np.arange(256))
    deviation = float(p @ (np.arange(256) - mean) ** 2) ** 0.5
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    return f"mean={mean:.3f};dev={deviation:.3f};entropy={entropy:.3f};chunks={n_chunks}"


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def _emit_features(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "inline"):
            parts = common.column(batch, "parts") if "parts" in batch.schema.names else [None] * batch.num_rows
            rows = []
            for media_id, recipe, inline, own in zip(common.column(batch, "media_id"), common.column(batch, "recipe"), common.column(batch, "inline"), parts):
                payload = rebuild(recipe, inline, {x["digest"]: x["bytes"] for x in own or ()})
                digest, n = hashlib.sha256(payload), len(recipe) // ENTRY
                if digest.digest() != media_id:
                    raise ValueError(f"medium {media_id.hex()} is damaged")
                rows.append((len(payload), digest.hexdigest(), zlib.crc32(payload[-ALIGN:]), len(recipe) + len(payload), hashlib.sha256(recipe + payload).hexdigest(), feature_of(payload, n), n))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(kept + made, [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"])

    return run


def read_media(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each row of ``media``: features of the payload as read back from the store.

    media_bytes and media_sha256 are of the medium as it is exported: its recipe followed by the bytes of its chunks in order. The store itself
    holds the bytes of shared chunks once.
    """
    alone = media.where("size(shared) = 0").select("doc_id", "n_bytes", "media_id", "recipe", "inline")
    alone = alone.mapInArrow(_emit_features(("doc_id", "n_bytes")), f"doc_id long, n_bytes long, {FEATURES}")
    mixed = media.where("size(shared) > 0")
    distinct = mixed.groupBy("media_id").agg(F.first(F.struct("recipe", "inline", "shared")).alias("m")).select("media_id", "m.*")
    parts = (
        distinct.select("media_id", F.explode("shared").alias("digest"))
        .join(chunks, "digest")
        .groupBy("media_id")
        .agg(F.collect_list(F.struct("digest", "bytes")).alias("parts"))
    )
    whole = distinct.select("media_id", "recipe", "inline").join(parts, "media_id", "left")  # without its chunks a medium is damaged, not gone
    whole = whole.mapInArrow(_emit_features(("media_id",)), f"media_id binary, {FEATURES}")
    return alone.unionByName(mixed.select("doc_id", "n_bytes", "media_id").join(whole, "media_id", "left").drop("media_id"))


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text of ``docs`` as a medium, read it back, and return doc_id, n_bytes and the features."""
    media, chunks = write_store(common.id_bytes(docs, id_col=id_col, text_col=text_col))
    return read_media(media, chunks)
