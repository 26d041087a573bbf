"""Shared plumbing: the shared folder, materialised tables, Arrow slices of text."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_ENDING: set[str] = set()
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)

#: Rows and bytes of text that a Python kernel holds as Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir``.

    Where it is unset (tests in one process) an own temporary folder is made; a cluster
    without it is an error, as a machine-local folder would be unreadable to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        import atexit

        _OWN[app] = tempfile.mkdtemp(prefix="cadenza-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system, the path in it)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder of this application's in the shared folder; all of them go when the application ends, well or not."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _ENDING:
        files, path = _files(spark, own)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ENDING.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths that ``materialize`` writes inside, in this thread: no other query's."""
    token = _WRITTEN.set([])
    try:
        yield _WRITTEN.get()
    finally:
        _WRITTEN.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, where = _files(spark, path)
        files.delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``rows`` rows, as counted now; else as it is (sort-merge, AQE splits skew).

    ``df`` should be materialised, as it is counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def packed(df: DataFrame, n: int, dtype: str, part: int = 1 << 14) -> np.ndarray:
    """An array of ``n`` values from rows (at, value); 0 where there is no row. Tasks pack ``part`` places each, so the driver gets bytes alone; the caller bounds ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                out = np.zeros(part, dtype)
                out[at.values.to_numpy()] = value.values.to_numpy().astype(dtype)
                yield pa.record_batch({"k": pa.array([k], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    parts = df.groupBy(F.floor(F.col("at") / part).cast("long").alias("k")).agg(F.collect_list(F.struct((F.col("at") % part).alias("at"), "value")).alias("x"))
    parts = parts.select("k", F.transform("x", lambda x: x["at"]).alias("at"), F.transform("x", lambda x: x["value"]).alias("value"))
    out = np.zeros(-(-n // part) * part, dtype)
    for row in parts.mapInArrow(run, "k long, data binary").collect():
        out[row["k"] * part : (row["k"] + 1) * part] = np.frombuffer(row["data"], dtype)
    return out[:n]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most SLICE_ROWS rows and about ``most`` bytes of ``column``."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        n, at = batch.num_rows, 0
        sizes = pc.binary_length(texts).fill_null(0).to_pylist() if n else []
        while at < n:
            end, held = at, 0
            while end < n and end - at < SLICE_ROWS and (end == at or held + sizes[end] <= most):
                held += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def keep_rows(docs: DataFrame, text_col: str, test) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts (null: empty) pass ``test`` (a list to a list); a slice of rows is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            yield part.filter(pa.array(test([t or "" for t in column(part, text_col)]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def map_texts(docs: DataFrame, text_col: str, change, to: str | None = None, kind: str = "string") -> DataFrame:
    """``docs`` with ``change`` of its texts (a list to a list) in their place (null stays null), or in a further column ``to`` of type ``kind`` (null: of the empty text)."""
    schema = T.StructType(list(docs.schema.fields))
    if to:
        schema = schema.add(to, kind)
    made = pa.float64() if kind == "double" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            texts = column(part, text_col)
            new = change([t or "" for t in texts])
            if to:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, made)], [*part.schema.names, to])
            else:
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, text_col, pa.array([None if t is None else n for t, n in zip(texts, new)], pa.string()))

    return docs.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and ``more``; other columns of ``docs`` are left behind, whatever their names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def id_bytes(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As id_text, with the text as its UTF-8 bytes."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)
