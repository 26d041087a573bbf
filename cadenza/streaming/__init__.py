"""Streaming ingest: an extension. Recordings are finished files; this keeps up with files and events as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def _instant(events: DataFrame, ts: str) -> Column:
    """The column as a timestamp; one without a zone is read as UTC, whatever the session's zone is."""
    at = F.col(ts)
    if events.schema[ts].dataType.typeName() != "timestamp_ntz":
        return at.cast("timestamp")
    return F.make_timestamp_ltz(F.year(at), F.month(at), F.day(at), F.hour(at), F.minute(at), F.extract(F.lit("SECOND"), at), F.lit("UTC"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key, batch or stream: start, end, n. NTZ times are read as UTC, as a watermark needs timestamps."""
    at = events.withColumn("_ts", _instant(events, ts))
    if events.isStreaming:
        at = at.withWatermark("_ts", late)
    out = at.groupBy(F.col(key), F.session_window("_ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, value: str = "value", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window of ``width``, batch or stream."""
    at = events.withColumn("_ts", _instant(events, ts))
    if events.isStreaming:
        at = at.withWatermark("_ts", late)
    out = at.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def closed_runs(events: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of a true ``flag`` of each key of a stream (key: long, order: long, flag: boolean): key, start, end, n, given when a false one ends them.

    State is one open run a key, whatever the stream's length. Within a micro-batch rows are ordered by ``order``; between batches they are taken to come in order. A null flag
    is false. The last run of a key stays open.
    """

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        start, end, n = state.get if state.exists else (None, None, 0)
        out = []
        for at, on in zip(rows[order].tolist(), rows[flag].fillna(False).astype(bool).tolist()):
            if on:
                start, end, n = (at if n == 0 else start), at, n + 1
            elif n:
                out.append((keys[0], start, end, n))
                start, end, n = None, None, 0
        state.update((start, end, n))
        yield pd.DataFrame(out, columns=[key, "start", "end", "n"])

    rows = events.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(flag).alias(flag))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, start long, end long, n long", "start long, end long, n long", "append", "NoTimeout")


def pending(episodes: DataFrame, receipts: DataFrame, key: str = "ep", digest: str = "sha256") -> DataFrame:
    """Episodes without a receipt of the same content: what an interrupted run still has to do."""
    return episodes.join(receipts.select(key, digest), [key, digest], "left_anti")


def ingest(spark: SparkSession, source: str, schema, process, receipts: str, checkpoint: str):
    """Runs ``process`` on each micro-batch of new files and appends its receipts (ep, sha256) when it is done.

    Episodes with a receipt are left out, so a batch that repeats after its receipts were written does nothing. One that failed before is processed again:
    ``process`` must be one that may run twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(receipts)
            df = pending(df, done)
        except Exception as e:  # the first batch has no receipts
            if "PATH_NOT_FOUND" not in str(e):
                raise
        process(df).select("ep", "sha256").write.mode("append").parquet(receipts)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
