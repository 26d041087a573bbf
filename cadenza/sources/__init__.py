"""Readers and writers of episode datasets: frame and episode tables, info.json, receipts, inventories."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFO = "fps double, total_episodes long, total_frames long, total_tasks long, data_path string, video_path string, features map<string, struct<dtype: string, shape: array<long>>>"


def episodes(spark: SparkSession, root: str) -> DataFrame:
    """The episode table under meta/episodes; an error if an episode is there twice."""
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    if not found.groupBy("episode_index").count().where("count > 1").isEmpty():
        raise ValueError("an episode is there more than once")
    return found


def frames(spark: SparkSession, root: str, episode: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The frame table under data; the filter and the columns reach the Parquet scan."""
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    found = found if episode is None else found.where(F.col("episode_index") == episode)
    return found if columns is None else found.select(*columns)


def info(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INFO).option("multiLine", True).json(f"{root}/meta/info.json")


def kept_features(features: dict[str, dict]) -> list[str]:
    """Columns that a trimmed table keeps: declared ones that aren't pictures."""
    return [k for k, f in features.items() if f.get("dtype") not in ("image", "video", "depth") and not k.startswith("observation.depth")]


def remapped(table: DataFrame, clock: DataFrame, vectors: list[str]) -> DataFrame:
    """``table`` (ep, f, columns) on ``clock`` (ep, t, left_src, right_src): what each column follows is decided by its name.

    Vectors interpolate, the first half by the left clock and the second by the right; left_* and right_* columns take the row at the
    floor of their side's clock; ids are made anew; the top camera's time is dropped; any other column is an error.
    """
    sides = {"left": "left_src", "right": "right_src"}
    routes: dict[str, list[str]] = {"left": [], "right": []}
    for c in table.columns:
        name = c.rsplit(".", 1)[-1]
        if c in (*vectors, "ep", "f", "index", "timestamp", "frame_index", "episode_index") or name == "top":
            continue
        side = next((s for s in sides if name.startswith(s)), None)
        if side is None:
            raise ValueError(f"no rule for column {c}")
        routes[side].append(c)
    out = clock
    for side, src in sides.items():
        for edge, of in (("lo", F.floor), ("hi", F.ceil)):
            keep = [F.col(f"`{v}`").alias(f"_{side}_{edge}_{v}") for v in vectors] + ([F.col(f"`{c}`") for c in routes[side]] if edge == "lo" else [])
            out = out.join(table.select("ep", F.col("f").alias(f"_{side}_{edge}"), *keep).withColumnRenamed("ep", "_ep"), (F.col("ep") == F.col("_ep")) & (of(F.col(src)).cast("long") == F.col(f"_{side}_{edge}"))).drop("_ep", f"_{side}_{edge}")

    def half(v: str, side: str):
        a, b = F.col(f"`_{side}_lo_{v}`"), F.col(f"`_{side}_hi_{v}`")
        n = F.floor(F.size(a) / 2).cast("int")
        w = F.col(sides[side]) - F.floor(sides[side])
        cut = (lambda x: F.slice(x, F.lit(1), n)) if side == "left" else (lambda x: F.slice(x, n + 1, n))
        return F.zip_with(cut(a), cut(b), lambda x, y: x.cast("double") + w * (y.cast("double") - x.cast("double")))

    return out.select("ep", F.col("t").alias("f"), *[F.concat(half(v, "left"), half(v, "right")).alias(v) for v in vectors], *[F.col(f"`{c}`") for s in routes for c in routes[s]], F.col("left_src").alias("left_source_frame"), F.col("right_src").alias("right_source_frame"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of every file under ``root``, without .git."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(~F.col("path").contains("/.git/")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a manifest (path, sha256) has and that are gone or different."""
    return manifest.join(now, ["path", "sha256"], "left_anti")


def write_json(path: str, value: object) -> None:
    """Write JSON (no NaN) beside its place and rename it, so readers see the old file or the new one."""
    text = json.dumps(value, indent=2, allow_nan=False)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".json-")
    try:
        with os.fdopen(fd, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(temp, os.stat(path).st_mode & 0o777)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def publish(df: DataFrame, path: str, *partition: str) -> None:
    """Write ``df`` to a staging folder and rename it to ``path``, through Hadoop's file system; what is at ``path`` stays till then."""
    spark = df.sparkSession
    stage = f"{path}.stage-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition).parquet(stage) if partition else df.write.parquet(stage)
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path}.old-{uuid.uuid4().hex[:8]}"
    new, here, before = (jvm.org.apache.hadoop.fs.Path(p) for p in (stage, path, old))
    had = files.exists(here)
    if had and not files.rename(here, before):
        files.delete(new, True)
        raise OSError(f"what is at {path} could not be moved away")
    if not files.rename(new, here):
        if had:
            files.rename(before, here)
        raise OSError(f"{path} could not be published")
    if had:
        files.delete(before, True)


def cached(spark: SparkSession, root: str, make, **key: object) -> DataFrame:
    """The table that ``make()`` gives, kept under ``root`` by the SHA-256 of ``key`` (code version, input fingerprints, parameters): made once, read after that.

    A key that JSON can't write is an error. The table is written beside its place and renamed, so a run that dies leaves no half of it.
    """
    digest = hashlib.sha256(json.dumps(key, sort_keys=True, allow_nan=False).encode()).hexdigest()
    path = f"{root}/{digest}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        publish(make(), path)
    return spark.read.parquet(path)


def outside(output: str, *sources: str) -> None:
    """An error if ``output`` lies within a source."""
    out = os.path.abspath(output)
    for s in map(os.path.abspath, sources):
        if out == s or out.startswith(s + os.sep):
            raise ValueError(f"{output} is inside {s}")


EPISODE = "episode_index long, tasks array<string>, length long, `data/chunk_index` long, `data/file_index` long, dataset_from_index long, dataset_to_index long"
