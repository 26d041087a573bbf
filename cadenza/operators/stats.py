"""Statistics of channels: exact, mergeable, by episode or over all.

Nulls, ties, empties: null channel values and null vectors don't count; repeated rows count as often as they stand there; a group without values has null
statistics and count 0; an empty table gives an empty result. Exact quantiles keep the distinct values of a group (a channel) in one task; ``merged_stats``
needs none and takes any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.1, 0.5, 0.9, 0.99)


def channels(rows: DataFrame, vec: str = "vec", *keys: str) -> DataFrame:
    """A row for each channel value: keys, pos, x (double)."""
    return rows.select(*keys, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def vector_stats(rows: DataFrame, vec: str = "vec", *keys: str, quantiles: bool = True) -> DataFrame:
    """min, max, mean, std (population), count and linearly interpolated quantiles of each channel."""
    aggs = [F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count")]
    if quantiles:
        aggs += [F.percentile("x", q).alias(f"q{round(100 * q):02d}") for q in QUANTILES]
    return channels(rows, vec, *keys).groupBy(*keys, "pos").agg(*aggs)


def merged_stats(parts: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the union from those of its parts: means by count, variances with the spread of means; quantiles can't be merged."""
    n = F.sum("count")
    mean = F.sum(F.col("count") * F.col("mean")) / n
    square = F.sum(F.col("count") * (F.col("std") ** 2 + F.col("mean") ** 2)) / n
    return parts.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(square - mean**2, F.lit(0.0))).alias("std"), n.alias("count"))


def bad_runs(rows: DataFrame, bad: Column) -> DataFrame:
    """Per episode the longest run and the share of bad frames."""
    from .series import islands

    runs = islands(rows, bad).where("flag").groupBy("ep").agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    share = rows.groupBy("ep").agg(F.avg(bad.cast("double")).alias("share"), F.count("*").alias("n"))
    return share.join(runs, "ep", "left").select("ep", "n", "share", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def displacement(rows: DataFrame, x: Column, q: float = 0.9) -> DataFrame:
    """Per episode a quantile, the maximum, its frame (first of equals) and the last value of ``x``."""
    at = rows.withColumn("_x", x)
    out = at.groupBy("ep").agg(F.percentile("_x", q).alias("p"), F.min(F.struct((-F.col("_x")).alias("x"), "f")).alias("m"), F.max(F.struct("f", F.col("_x").alias("x"))).alias("l"))
    return out.select("ep", "p", (-F.col("m.x")).alias("most"), F.col("m.f").alias("at"), F.col("l.x").alias("last"))


def circular_mean(degrees: Column) -> Column:
    """Mean direction in [0, 360)."""
    r = F.radians(degrees)
    return (F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))) + 360) % 360
