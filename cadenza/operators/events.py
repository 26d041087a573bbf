"""Joins of events, intervals and frames. Range joins carry the episode as an equality key, so they shuffle by it and never cross episodes.

Nulls, ties, empties: rows without a key or bound match nothing; empty and backward intervals hold no frame; marks at the same frame as an event count as
before it; repeated rows give repeated pairs; an empty table on either side gives an empty result, or nulls where a mark is sought.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_frames(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """Frames within half-open intervals (ep, start, end): a row for each pair. Intervals are dealt out to their frames, which meet by equality: no pair is made that isn't kept."""
    spans = intervals.where("start < end")
    return frames.join(spans.withColumn("f", F.explode(F.sequence(F.col("start"), F.col("end") - 1))), ["ep", "f"])


def asof_before(events: DataFrame, marks: DataFrame) -> DataFrame:
    """``events`` (ep, f) with ``mark``: the latest mark (ep, m) at or before f; one sort of both together by episode, no pairs."""
    w = Window.partitionBy("ep").orderBy("f", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = events.withColumns({"_kind": F.lit(1), "_m": F.lit(None).cast("long")}).unionByName(marks.select("ep", F.col("m").alias("f"), F.lit(0).alias("_kind"), F.col("m").alias("_m")), allowMissingColumns=True)
    return both.withColumn("mark", F.last("_m", True).over(w)).where("_kind = 1").drop("_kind", "_m")


def asof_after(events: DataFrame, marks: DataFrame) -> DataFrame:
    """``events`` (ep, f) with ``mark``: the earliest mark (ep, m) after f."""
    w = Window.partitionBy("ep").orderBy(F.col("f").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = events.withColumns({"_kind": F.lit(1), "_m": F.lit(None).cast("long")}).unionByName(marks.select("ep", F.col("m").alias("f"), F.lit(0).alias("_kind"), F.col("m").alias("_m")), allowMissingColumns=True)
    return both.withColumn("mark", F.last("_m", True).over(w)).where("_kind = 1").drop("_kind", "_m")


def overlapping(intervals: DataFrame, key: str = "ep", bin_frames: int = 64) -> DataFrame:
    """Pairs a < b of closed intervals (key, id, grasp, release) that overlap. Intervals meet in the bins of ``bin_frames`` frames that they touch, and a pair counts in the first bin of both."""
    low, high = (F.floor(F.col(c) / bin_frames).cast("long") for c in ("grasp", "release"))
    dealt = intervals.where("grasp <= release").select(key, "id", "grasp", "release", low.alias("_low"), F.explode(F.sequence(low, high)).alias("_bin"))
    a = dealt.select(key, "_bin", F.col("id").alias("a"), F.col("grasp").alias("a_grasp"), F.col("release").alias("a_release"), F.col("_low").alias("_a"))
    b = dealt.select(key, "_bin", F.col("id").alias("b"), F.col("grasp").alias("b_grasp"), F.col("release").alias("b_release"), F.col("_low").alias("_b"))
    both = a.join(b, [key, "_bin"]).where((F.col("a") < F.col("b")) & (F.col("_bin") == F.greatest("_a", "_b")) & (F.col("a_release") >= F.col("b_grasp")) & (F.col("b_release") >= F.col("a_grasp")))
    return both.drop("_bin", "_a", "_b")


def pair_support(tracks: DataFrame, most: float, least_share: float = 0.4) -> DataFrame:
    """Pairs of tracks (ep, track, f, x) whose gap stays near its median: p95 of the deviation below ``most``, seen together often enough; and each pair's frames."""
    n = Window.partitionBy("ep", "a", "b")
    a = tracks.select("ep", "f", F.col("track").alias("a"), F.col("x").alias("xa"))
    b = tracks.select("ep", "f", F.col("track").alias("b"), F.col("x").alias("xb"))
    total = tracks.groupBy("ep").agg(F.count_distinct("f").alias("total"))
    gap = a.join(b, ["ep", "f"]).where("a < b").withColumn("gap", F.col("xb") - F.col("xa"))
    gap = gap.withColumn("off", F.abs(F.col("gap") - F.percentile("gap", 0.5).over(n)))
    out = gap.groupBy("ep", "a", "b").agg(F.count("*").alias("frames"), F.percentile("off", 0.95).alias("p95")).join(total, "ep")
    return out.where((F.col("frames") >= least_share * F.col("total")) & (F.col("p95") < most)).select("ep", "a", "b", "frames", "p95")


def object_state(t: Column, grasp: Column, pickup: Column, release: Column, settle: int = 0) -> Column:
    """State of an object at frame t."""
    return (
        F.when(t < grasp, "AT_ORIGIN")
        .when(t < pickup, "GRASPING")
        .when(t < release, "HELD")
        .when(t == release, "RELEASING")
        .otherwise("PLACED")
    )


def state_spans(marks: DataFrame, lengths: DataFrame) -> DataFrame:
    """The states of each object (ep, id, grasp, pickup, release) over its whole episode (ep, n), as half-open intervals; a state without a frame has no row."""
    zero, n, r = F.lit(0).cast("long"), F.col("n"), F.col("release")
    cuts = (("AT_ORIGIN", zero, F.col("grasp")), ("GRASPING", F.col("grasp"), F.col("pickup")), ("HELD", F.col("pickup"), r), ("RELEASING", r, r + 1), ("PLACED", r + 1, n))
    spans = F.array(*[F.struct(F.lit(s).alias("state"), F.greatest(a, zero).alias("start"), F.least(b, n).alias("end")) for s, a, b in cuts])
    return marks.join(lengths.select("ep", "n"), "ep").select("ep", "id", F.inline(spans)).where("start < end")


def carried(t: Column, pickup: Column, release: Column) -> Column:
    return (t >= pickup) & (t < release)


def precedence_gate(left: Column, right: Column, wait, opened, closing, withdrawn) -> Column:
    """Left may pass ``wait`` once right has opened; right may close once left has withdrawn."""
    return ((left <= wait) | (right >= opened)) & ((right < closing) | (left >= withdrawn))


def pickups_in_order(left: Column, right: Column, milestones: list[tuple[str, int]]) -> Column:
    """Whether each milestone (side, frame) is still ahead of its side's clock, or the one before it has been passed by its own."""
    clock, ok = {"left": left, "right": right}, F.lit(True)
    for (before, passed), (side, frame) in zip(milestones, milestones[1:]):
        ok = ok & ((clock[side] < frame) | (clock[before] > passed))
    return ok


def admitted(left: Column, right: Column, gates: list[tuple[str, int, str, int]]) -> Column:
    """Whether each gate (side, stop, owner, pickup) holds: the side waits at its stop until the owner is past its pickup."""
    clock, ok = {"left": left, "right": right}, F.lit(True)
    for side, stop, owner, pickup in gates:
        ok = ok & ((clock[side] <= stop) | (clock[owner] > pickup))
    return ok


def one_sided(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only, with the side: empty if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def positional(a: DataFrame, b: DataFrame, order: str, *keys: str) -> DataFrame:
    """Both lists side by side by rank within ``keys``; rows whose values differ."""
    w = Window.partitionBy(*keys).orderBy(order)
    left = a.select(*keys, F.row_number().over(w).alias("rank"), F.col(order).alias("a"))
    right = b.select(*keys, F.row_number().over(w).alias("rank"), F.col(order).alias("b"))
    return left.join(right, [*keys, "rank"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def boundaries(events: DataFrame, stops: DataFrame, last: DataFrame) -> DataFrame:
    """``events`` (ep, id, grasp, pickup, release) with approach and retract: the last stop before the grasp but after the event before, and the
    first stop after the release but before the next event; else those limits. ``stops``: ep, start, end; ``last``: ep, n.
    """
    w = Window.partitionBy("ep").orderBy("pickup")
    own = events.join(last.select("ep", "n"), "ep").withColumns({"_floor": F.coalesce(F.lag("release").over(w) + 1, F.lit(0).cast("long")), "_ceil": F.coalesce(F.lead("grasp").over(w), F.col("n") - 1)})
    own = asof_before(own.withColumn("f", F.col("grasp") - 1), stops.select("ep", F.col("end").alias("m"))).withColumnRenamed("mark", "_b")
    own = asof_after(own.withColumn("f", F.col("release")), stops.select("ep", F.col("start").alias("m"))).withColumnRenamed("mark", "_a")
    before, after = F.when(F.col("_b") >= F.col("_floor"), F.col("_b")), F.when(F.col("_a") <= F.col("_ceil"), F.col("_a"))
    return own.select("ep", "id", "grasp", "pickup", "release", F.coalesce(before, "_floor").alias("approach"), F.coalesce(after, "_ceil").alias("retract"))
