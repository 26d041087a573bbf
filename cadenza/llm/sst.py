"""Token-id output: sorted-string-table shards.

A shard holds documents in ascending order of id. Its file is

    blocks | index | Bloom filter | footer

* block: entries of up to BLOCK bytes, then compressed (zstd), then 4 bytes crc32. An entry is
  varint(shared key bytes), varint(other key bytes), varint(value bytes), other key bytes, value.
  The first entry of a block shares nothing.
* key: 8 bytes, big-endian, sign bit flipped, so bytes sort as ids do; a null id is the empty key and sorts first.
* value: token ids, little-endian, 2 or 4 bytes each (``width`` in the footer).
* index: for each block its last key, offset, length (sparse: one entry a block). Bloom filter: 10 bits a key, 7 places.
* footer: fixed size, at the end: offsets and lengths of index and filter, entries, ids, width, magic.

A lookup reads the footer, the filter and the index, and then one block (more only if equal ids go on).

Writing: texts are range-partitioned by id (ties by a hash of the text, so that no id is one task), sorted within the
partition, encoded in the same task that writes the shard, and written under a name of its own that is then
renamed; a repeated task writes the same file. Ids before each shard are summed over the shards' manifest,
which has one row a shard.

Shards are made of at most SHARD_BYTES of text on average. A reader holds one block at a time.

Nulls, empties, repeats: a null or empty text has the end id only; null ids come first; repeated ids are
kept, ordered by text; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vocab

BLOCK = 64 << 10
BITS_PER_KEY, PLACES = 10, 7
MAGIC = b"CDZSST01"
FOOTER = struct.Struct("<QQQQQQI8s")
#: Text bytes that a shard holds on average, at most, when the number of shards isn't given.
SHARD_BYTES = 128 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(PLACES)]


class Writer:
    """Writes one shard to a binary stream; keys come in ascending order."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.held, self.last, self.index, self.keys = [], 0, b"", [], array("Q")
        self.n_entries = self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.held += len(entry)
        self.last = key
        self.keys.append(xxhash.xxh64_intdigest(key))
        self.n_entries += 1
        self.n_ids += len(value) // self.width
        if self.held >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.block, self.held = [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index))
        bloom_at, bits = self.at, max(64, BITS_PER_KEY * self.n_entries)
        h = np.array(self.keys, np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        flags = np.zeros(-(-bits // 8) * 8, bool)
        for k in range(PLACES):
            flags[((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64)] = True
        self._put(struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.n_entries, self.n_ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file, self.zip = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        size = file.tell()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        self.index_at, self.index_n, self.bloom_at, self.bloom_n, self.n_entries, self.n_ids, self.width, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: no magic")
        self._index = self._bloom = None

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(n))

    @property
    def index(self) -> list[tuple[bytes, int, int]]:
        if self._index is None:
            data, at, self._index = self._get(self.index_at, self.index_n), 0, []
            while at < len(data):
                n = data[at]
                self._index.append((data[at + 1 : at + 1 + n], *struct.unpack_from("<QQ", data, at + 1 + n)))
                at += 17 + n
        return self._index

    def may_have(self, key: bytes) -> bool:
        if self._bloom is None:
            data = self._get(self.bloom_at, self.bloom_n)
            self._bloom = struct.unpack_from("<Q", data)[0], data[8:]
        bits, data = self._bloom
        return all(data[p >> 3] >> (p & 7) & 1 for p in _places(key, bits))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[k]
        data = self._get(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.zip.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry of ``doc_id``: none if the filter or the blocks don't have it."""
        key, out = key_of(doc_id), []
        if not self.n_entries or not self.may_have(key):
            return out
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        while low < len(self.index):
            for k, value in self.block(low):
                if k == key:
                    out.append(np.frombuffer(value, f"<u{self.width}"))
                elif k > key:
                    return out
            low += 1
        return out


def _files(uri: str):
    """(file system, path in it) of a path with its scheme, as ``qualified`` gives it; a plain path is a local one, for readers on one machine."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark reads it by, so that executors open the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def open_shard(uri: str) -> Reader:
    files, path = _files(uri)
    return Reader(files.open_input_file(path))


def _write_shard(folder: str, file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId(), None
        encoder, files, path = vocab.byte_level(file), None, f"{folder}/{shard:08d}.sst"
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in common.slices(batches, most=1 << 20):
            if writer is None:
                files, root = _files(folder)
                files.create_dir(root, recursive=True)
                done, temp = f"{root}/{shard:08d}.sst", f"{root}/.{shard:08d}.{uuid.uuid4().hex}"
                out = files.open_output_stream(temp)
                writer = Writer(out, encoder.dtype.itemsize)
            for doc_id, ids in zip(common.column(batch, "doc_id"), encoder.encode_all(common.column(batch, "text"))):
                writer.add(key_of(doc_id), ids + end)
        if writer:
            writer.close()
            out.close()
            files.move(temp, done)
            yield pa.record_batch({"shard": [shard], "path": [path], "n_docs": [writer.n_entries], "n_ids": [writer.n_ids]})

    return run


MANIFEST = "shard long, path string, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, file: str, end_id: int, n_shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards to ``folder``; the manifest, one row a shard, with the ids before each (``start``)."""
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    if n_shards is None:
        n_bytes = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARD_BYTES), 1)
    tie = F.xxhash64("text")
    dealt = docs.withColumn("tie", tie).repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first(), "tie")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = sorted(map(tuple, dealt.mapInArrow(_write_shard(folder, file, end_id), MANIFEST).collect()))
    starts = np.cumsum([0] + [r[3] for r in rows])[:-1].tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)], f"{MANIFEST}, start long")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, path, start in zip(common.column(batch, "shard"), common.column(batch, "path"), common.column(batch, "start")):
            reader = open_shard(path)
            for k in range(len(reader.index)):
                rows = []
                for key, value in reader.block(k):
                    ids = np.frombuffer(value, f"<u{reader.width}")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every document, from the files; a task for each shard."""
    n = manifest.count()
    return manifest.repartition(max(1, n)).mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of the given documents, by filter, index and block of each shard."""

    def run(batches):
        for batch in batches:
            for path in common.column(batch, "path"):
                reader = open_shard(path)
                found = [(d, ids.tolist()) for d in doc_ids for ids in reader.get(d)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.list_(pa.int64())))], ["doc_id", "ids"])

    return manifest.select("path").mapInArrow(run, "doc_id long, ids array<long>")


def write_and_read(docs: DataFrame, file: str, end_id: int = 2, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read every document back."""
    folder = common.fresh_path(docs.sparkSession, "sst")
    return read_shards(write_shards(common.id_text(docs, id_col=id_col, text_col=text_col), folder, file, end_id, n_shards))
