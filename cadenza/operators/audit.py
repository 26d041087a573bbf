"""Audits: each returns the rows that violate a rule, so a good table, and an empty one, give none. A null where a value must be is a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def frame_gaps(rows: DataFrame) -> DataFrame:
    """Frames whose number isn't their rank from 0."""
    rank = (F.row_number().over(Window.partitionBy("ep").orderBy("f")) - 1).cast("long")
    return rows.withColumn("expected", rank).where(~F.col("f").eqNullSafe(F.col("expected")))


def timestamp_errors(rows: DataFrame, fps: float, tolerance: float = 1e-4) -> DataFrame:
    """Frames whose time isn't f / fps."""
    return rows.where(~F.coalesce(F.abs(F.col("timestamp") - F.col("f") / fps) <= tolerance, F.lit(False)))


def interval_errors(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """Intervals (ep, start, end) that are empty, out of range, or start before the one before ends."""
    w = Window.partitionBy("ep").orderBy("start", "end")
    marked = intervals.withColumn("_before", F.lag("end").over(w)).join(lengths.select("ep", "n"), "ep", "left")
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | F.col("n").isNull() | (F.col("end") > F.col("n")) | (F.coalesce("_before", F.lit(0)) > F.col("start"))
    return marked.where(bad).drop("_before")


def total_errors(rows: DataFrame, expected: int) -> DataFrame:
    return rows.agg(F.count("*").alias("found")).withColumn("expected", F.lit(expected).cast("long")).where("found <> expected")


def inventory(df: DataFrame, content: str, *keys: str) -> DataFrame:
    """keys, bytes and SHA-256 of a content column."""
    raw = F.col(content).cast("binary")
    return df.select(*keys, F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw, 256).alias("sha256"))
