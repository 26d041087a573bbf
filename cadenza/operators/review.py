"""Guards, lookups and ledgers: what admits an edge, a cohort, an input or an override, and why something is refused.

Each operator gives rows. Audits give the rows that break a rule, with the reasons, so a good table and an empty one give none.
Nulls never pass a guard. Repeated rows are judged one by one. Ties are broken by the columns that a docstring names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X


def reasons(**failed: Column) -> Column:
    """Names of the conditions that hold, in order; a condition that is null holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in failed.items()]))


def replayed_edges(edges: DataFrame, preserved: DataFrame) -> DataFrame:
    """Edges (ep, l, r, nl, nr) that repeat a recorded step: both sides at one frame, both one further, from a preserved frame (ep, f)."""
    same = edges.where((F.col("l") == F.col("r")) & (F.col("nl") == F.col("nr")) & (F.col("nl") == F.col("l") + 1))
    return same.join(preserved.select("ep", F.col("f").alias("l")), ["ep", "l"], "left_semi")


def cohort_errors(ids: DataFrame, total: int) -> DataFrame:
    """Entries (cohort, place, id) that aren't source numbers below ``total`` in strictly rising order."""
    before = F.lag("id").over(Window.partitionBy("cohort").orderBy("place"))
    marked = ids.withColumn("_before", before)
    why = reasons(out_of_range=~F.col("id").between(0, total - 1), not_rising=F.col("_before").isNotNull() & (F.col("id") <= F.col("_before")))
    return marked.withColumn("why", why).where(F.size("why") > 0).select("cohort", "place", "id", "why")


def parameter_errors(sets: DataFrame) -> DataFrame:
    """Parameter sets (id, smoothing, low, high, share, cross) of the segment search that break its rules."""
    low, high = F.col("low"), F.col("high")
    why = reasons(
        smoothing=F.col("smoothing") < 1,
        search=~((low > 0) & (low < high) & (high < 1)),
        share=~((F.col("share") >= 0) & (F.col("share") < 0.5)),
        cross=~((F.col("cross") >= 0) & (F.col("cross") < 1)),
    )
    return sets.withColumn("why", why).where(F.size("why") > 0).select("id", "why")


def seen_at_origin(looks: DataFrame, candidates: DataFrame, window: int, least: int = 3, most: float = 1.25) -> DataFrame:
    """Candidates (ep, id, grasp, ox, oy, size) with how often they were seen (looks: ep, f, x, y) in the ``window`` frames before the grasp, and whether the
    median place was within ``most`` sizes of the origin, ``least`` looks given."""
    seen = looks.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    before = candidates.join(seen, "ep").where((F.col("f") < F.col("grasp")) & (F.col("f") >= F.col("grasp") - window))
    middle = before.groupBy("ep", "id").agg(F.count("*").alias("looks"), F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"))
    out = candidates.join(middle, ["ep", "id"], "left").withColumn("looks", F.coalesce("looks", F.lit(0)))
    off = F.sqrt((F.col("mx") - F.col("ox")) ** 2 + (F.col("my") - F.col("oy")) ** 2)
    return out.select("ep", "id", "looks", F.coalesce((F.col("looks") >= least) & (off <= most * F.col("size")), F.lit(False)).alias("at_origin"))


def dealt_sources(outputs: DataFrame, sources: DataFrame, n: Column) -> DataFrame:
    """Outputs (g) with the source whose ``rank`` is g modulo ``n`` and the sample g div ``n``."""
    dealt = outputs.withColumns({"rank": F.pmod(F.col("g"), n), "sample": F.floor(F.col("g") / n).cast("long")})
    return dealt.join(sources, "rank")


def first_after(events: DataFrame, rows: DataFrame, holds: Column) -> DataFrame:
    """Events (ep, id, at) with the first frame after ``at`` at which ``holds``; null if there is none. Both are sorted together, no pairs are made."""
    marks = rows.where(holds).select("ep", F.col("f").alias("_at"), F.lit(0).alias("_kind"), F.col("f").alias("_f"))
    both = events.withColumns({"_at": F.col("at"), "_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    later = Window.partitionBy("ep").orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("first", F.last("_f", True).over(later)).where("_kind = 1").select(*events.columns, "first")


def unpartnered(needed: DataFrame, clear: DataFrame) -> DataFrame:
    """Left frames (ep, l) for which no partner (clear: ep, l, r) is clear."""
    return needed.join(clear.select("ep", "l"), ["ep", "l"], "left_anti")


def hand_distances(objects: DataFrame, hands: DataFrame) -> DataFrame:
    """Distance of each object (ep, f, id, x, y) to each hand (ep, f, side, x, y) of its frame."""
    hands = hands.select("ep", "f", "side", F.col("x").alias("hx"), F.col("y").alias("hy"))
    gap = F.sqrt((F.col("x") - F.col("hx")) ** 2 + (F.col("y") - F.col("hy")) ** 2)
    return objects.join(hands, ["ep", "f"]).select("ep", "f", "id", "side", gap.alias("distance"))


def bins_by_side(candidates: DataFrame, bins: DataFrame) -> DataFrame:
    """The bin that each candidate (ep, id, side) would fill: of the episode's two largest bins (ep, bin, area, x) the left one for the left arm, the right one for the right arm."""
    place = F.row_number().over(Window.partitionBy("ep").orderBy(F.col("area").desc(), "bin"))
    two = bins.withColumn("_place", place).where("_place <= 2")
    rank = F.row_number().over(Window.partitionBy("ep").orderBy("x", "bin"))
    sided = two.withColumn("side", F.when(rank == 1, "left").otherwise("right")).select("ep", "side", "bin")
    return candidates.join(sided, ["ep", "side"], "left").select("ep", "id", "side", "bin")


def receipt_errors(receipts: DataFrame, plans: DataFrame, maps: DataFrame) -> DataFrame:
    """Outputs whose receipt (output, source, frames, digest), plan (output, source, frames) and map (output, frames, digest) don't agree or aren't all there."""
    plan = plans.select("output", F.col("source").alias("_source"), F.col("frames").alias("_planned"))
    made = maps.select("output", F.col("frames").alias("_made"), F.col("digest").alias("_digest"))
    both = receipts.join(plan, "output", "full").join(made, "output", "full")
    why = reasons(
        receipt=F.col("frames").isNull(), plan=F.col("_planned").isNull(), map=F.col("_made").isNull(),
        source=F.col("source") != F.col("_source"), frames=(F.col("frames") != F.col("_planned")) | (F.col("frames") != F.col("_made")), digest=F.col("digest") != F.col("_digest"),
    )
    return both.withColumn("why", why).where(F.size("why") > 0).select("output", "why")


def admitted_inputs(analyses: DataFrame, gates: DataFrame, files: DataFrame) -> DataFrame:
    """Analyses (ep, stage, success, digest) with ``why`` they aren't admitted: not complete, no success, a gate (ep, passed) failed or none there, or a digest that isn't the file's (ep, digest)."""
    gate = gates.groupBy("ep").agg(F.min("passed").alias("_passed"))
    file = files.select("ep", F.col("digest").alias("_digest"))
    joined = analyses.join(gate, "ep", "left").join(file, "ep", "left")
    why = reasons(stage=F.col("stage") != "complete", success=~F.col("success"), gates=~F.col("_passed"), digest=F.col("digest") != F.col("_digest"))
    return joined.select("ep", why.alias("why"))


def overridden(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (ep, digest, value) after reviewed notes (ep, digest, old, new): a note takes effect if digest and old value are those it was made for; ``ledger`` says what became of it."""
    notes = notes.select("ep", F.col("digest").alias("_digest"), "old", "new")
    joined = rows.join(notes, "ep", "left")
    valid = (F.col("digest") == F.col("_digest")) & F.col("value").eqNullSafe(F.col("old"))
    ledger = F.when(F.col("_digest").isNull(), "none").when(valid, "applied").when(F.col("digest") != F.col("_digest"), "stale").otherwise("changed")
    return joined.select("ep", F.when(ledger == "applied", F.col("new")).otherwise(F.col("value")).alias("value"), F.col("value").alias("before"), ledger.alias("ledger"))


def pages_by_worst(rows: DataFrame, score: str, size: int = 4, *ties: str) -> DataFrame:
    """Rows with ``page`` (from 0) and ``slot``: worst score first, ``size`` to a page, over each episode."""
    place = F.row_number().over(Window.partitionBy("ep").orderBy(F.col(score).desc(), *ties)) - 1
    return rows.withColumns({"page": F.floor(place / size).cast("long"), "slot": (place % size).cast("long")})


def batch_ledger(runs: DataFrame) -> DataFrame:
    """Of runs (batch, item, code, seconds; code 0: passed): per batch the numbers of runs and failures, the seconds, and the exit code (1 if any failed)."""
    failed = F.count_if(F.col("code").isNull() | (F.col("code") != 0))
    return runs.groupBy("batch").agg(F.count("*").alias("runs"), failed.alias("failed"), F.sum("seconds").alias("seconds"), F.when(failed > 0, 1).otherwise(0).alias("exit"))


def fingerprints(parts: DataFrame, *keys: str) -> DataFrame:
    """One SHA-256 for each key over its parts (name, bytes, sha256), by name, whatever the order of rows."""
    line = F.concat_ws(" ", "name", F.col("bytes").cast("string"), "sha256")
    return parts.groupBy(*keys).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"))


def mask_centres(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Area and centre of the mask of each frame (pixels: ep, f, x, y); a frame without pixels has area 0 and NaN for its centre."""
    found = pixels.groupBy("ep", "f").agg(F.count("*").alias("area"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    nan = F.lit(float("nan"))
    return frames.select("ep", "f").join(found, ["ep", "f"], "left").select("ep", "f", F.coalesce("area", F.lit(0)).alias("area"), F.coalesce("x", nan).alias("x"), F.coalesce("y", nan).alias("y"))


def accepted_masks(rows: DataFrame, most_area: float, most_jump: float) -> DataFrame:
    """Frames (ep, f, area, x, y) with ``accepted``: not too large, and no jump from the frame before if that was accepted.

    Whether a frame is accepted depends on the one before, but only a frame that is small enough and jumps turns on it: such frames alternate,
    starting from the last frame that is settled without them. So two windows do what a loop over frames would.
    """
    w = Window.partitionBy("ep").orderBy("f")
    jump = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2) > most_jump
    small = F.coalesce(F.col("area") <= most_area, F.lit(False))
    rows = rows.withColumns({"_small": small, "_jump": F.coalesce(jump, F.lit(False))})
    settled = F.when(~F.col("_small"), F.struct(F.col("f"), F.lit(0).alias("v"))).when(~F.col("_jump"), F.struct(F.col("f"), F.lit(1).alias("v")))
    last = F.last(settled, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(w)
    rows = rows.withColumns({"_place": place, "_last": F.last(F.when(settled.isNotNull(), place), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_v": last["v"]})
    turns = F.col("_place") - F.coalesce("_last", F.lit(0))
    return rows.withColumn("accepted", (F.coalesce("_v", F.lit(0)) + turns) % 2 == 1).drop("_small", "_jump", "_place", "_last", "_v")


def fitted_shift(corners: DataFrame, *keys: str) -> DataFrame:
    """Root mean square distance of fitted corners (x, y, fx, fy) and their mean shift."""
    dx, dy = F.col("fx") - F.col("x"), F.col("fy") - F.col("y")
    return corners.groupBy(*keys).agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("rms"), F.sqrt(F.avg(dx) ** 2 + F.avg(dy) ** 2).alias("shift"))


def largest_in_spans(parts: DataFrame, spans: DataFrame, least: float) -> DataFrame:
    """Frames within a carried span (ep, id, start, end) whose largest part (ep, f, part, area) reaches ``least``: that part (of equal ones the lowest)."""
    inside = parts.join(spans, "ep").where((F.col("f") >= F.col("start")) & (F.col("f") < F.col("end")))
    top = inside.groupBy("ep", "id", "f").agg(F.max(F.struct("area", (-F.col("part")).alias("p"))).alias("t"))
    return top.where(F.col("t.area") >= least).select("ep", "id", "f", (-F.col("t.p")).alias("part"), F.col("t.area").alias("area"))


def lone_peaks(clock: DataFrame, peaks: DataFrame, reach: int = 3) -> DataFrame:
    """Whether a lift runs through its peak without a stop (clock: ep, t, left, right; peaks: ep, peak, opened): the peak's frame comes once, the ``reach`` steps on
    either side go one frame on, and the right side has opened by then."""
    w = Window.partitionBy("ep").orderBy("t")
    unit = F.coalesce((F.col("left") - F.lag("left").over(w) == 1).cast("int"), F.lit(0))
    marked = clock.withColumn("_unit", unit)
    around = F.sum("_unit").over(w.rowsBetween(1 - reach, reach))
    at = marked.withColumn("_around", around).join(peaks, "ep").where(F.col("left") == F.col("peak"))
    found = at.groupBy("ep").agg(F.count("*").alias("times"), F.min("_around").alias("steps"), F.min("right").alias("right"), F.first("opened").alias("opened"))
    return peaks.select("ep").join(found, "ep", "left").select("ep", F.coalesce((F.col("times") == 1) & (F.col("steps") == 2 * reach) & (F.col("right") >= F.col("opened")), F.lit(False)).alias("uninterrupted"))


def tail_errors(rows: DataFrame, spans: DataFrame, rests: DataFrame, most: int) -> DataFrame:
    """Episodes (rests: ep, start, mask_start) whose idle spans (ep, start, end) leave a frame from mask_start on, or over ``most`` frames from start on, supervised."""
    spans = spans.select("ep", F.col("start").alias("_a"), F.col("end").alias("_b"))
    idle = rows.select("ep", "f").join(spans, "ep").where((F.col("f") >= F.col("_a")) & (F.col("f") < F.col("_b"))).select("ep", "f").distinct()
    free = rows.select("ep", "f").join(idle, ["ep", "f"], "left_anti").join(rests, "ep")
    out = free.groupBy("ep").agg(F.count_if(F.col("f") >= F.col("start")).alias("supervised"), F.count_if(F.col("f") >= F.col("mask_start")).alias("unmasked"))
    return out.where((F.col("supervised") > most) | (F.col("unmasked") > 0))


def spacing_errors(samples: DataFrame, expected: float = 0.5) -> DataFrame:
    """Sources (rank, variant, position, frames) whose next variant isn't ``expected`` further, or has another duration."""
    w = Window.partitionBy("rank").orderBy("variant")
    marked = samples.withColumns({"step": F.lead("position").over(w) - F.col("position"), "_frames": F.lead("frames").over(w)})
    wrong = (F.abs(F.col("step") - expected) > 1e-8) | (F.col("_frames") != F.col("frames"))
    return marked.where(wrong).select("rank", "variant", "step", (F.col("_frames") - F.col("frames")).alias("longer"))


def reseeded(areas: DataFrame) -> DataFrame:
    """Verdict on a proposed arm mask (id, area, before, combined, corroborated, held, side, entry): coverage of the reference before and with it, and ``selected``.

    Fixed values: coverage of 0.6 and 0.15 more than before; at most four times the reference or twice the mask before; an entry on the arm's own side.
    """
    old, new = F.col("before") / F.col("area"), F.col("combined") / F.col("area")
    selected = (new >= 0.6) & (new >= old + 0.15) & (F.col("entry") == F.col("side")) & (F.col("corroborated") <= F.greatest(4 * F.col("area"), 2 * F.col("held")))
    return areas.where("area > 0").select("id", old.alias("coverage"), new.alias("combined_coverage"), F.coalesce(selected, F.lit(False)).alias("selected"))


def sampled_points(pixels: DataFrame, k: int) -> DataFrame:
    """At most ``k`` pixels of each object (ep, owner, y, x), evenly spaced in row order, with their place."""
    w = Window.partitionBy("ep", "owner")
    ranked = pixels.withColumns({"_place": (F.row_number().over(w.orderBy("y", "x")) - 1).cast("long"), "_n": F.count("*").over(w)})
    chosen = ranked.where(F.array_contains(X.even_sample(F.col("_n"), k), F.col("_place")))
    return chosen.select("ep", "owner", F.col("_place").alias("place"), "y", "x")


def merged_keys(old: Column, new: Column) -> Column:
    """A map with the entries of ``new`` in the place of those of ``old``."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def flattened(stats: DataFrame, feature: str, *names: str) -> DataFrame:
    """(key, value) rows ``stats/<feature>/<name>`` of a table of statistics."""
    rows = [F.struct(F.concat(F.lit("stats/"), F.col(feature).cast("string"), F.lit(f"/{n}")).alias("key"), F.col(n).cast("double").alias("value")) for n in names]
    return stats.select(F.inline(F.array(*rows)))


def fixed_width(value: Column, width: int) -> Column:
    """An array of ``width`` doubles without null, or null: what statistics may be taken of."""
    return F.when((F.size(value) == width) & ~F.exists(value, lambda x: x.isNull() | F.isnan(x)), F.transform(value, lambda x: x.cast("double")))


def covers(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of ``whole`` that no part has, that several have, or that only a part has: (row, ``times``, ``known``). None if the parts are a disjoint cover."""
    every = reduce(DataFrame.unionAll, parts).groupBy(*whole.columns).agg(F.count("*").alias("times"))
    both = whole.withColumn("known", F.lit(True)).join(every, whole.columns, "full")
    out = both.withColumns({"times": F.coalesce("times", F.lit(0)), "known": F.coalesce("known", F.lit(False))})
    return out.where("times <> 1 or not known")


def template_looks(looks: DataFrame, hands: DataFrame, every: int = 3, clear: float = 1.5) -> DataFrame:
    """Looks (ep, f, id, x, y, size, score) on every ``every``-th frame with both hands (ep, f, side, x, y) at least ``clear`` sizes away."""
    some = looks.where(F.col("f") % every == 0)
    hand = hands.select("ep", "f", F.col("x").alias("hx"), F.col("y").alias("hy"))
    near = some.join(hand, ["ep", "f"]).where(F.sqrt((F.col("x") - F.col("hx")) ** 2 + (F.col("y") - F.col("hy")) ** 2) < clear * F.col("size"))
    return some.join(near.select("ep", "f", "id").distinct(), ["ep", "f", "id"], "left_anti")


def joint_regions(boxes: DataFrame, share: float = 0.6, quantile: float = 0.9) -> DataFrame:
    """Bounds of the boxes (ep, x0, y0, x1, y1) whose area reaches ``share`` of the episode's ``quantile`` of areas, and their number."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    marked = boxes.withColumn("_area", area).withColumn("_limit", share * F.percentile("_area", quantile).over(Window.partitionBy("ep")))
    return marked.where("_area >= _limit").groupBy("ep").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("boxes"))


def manifest_errors(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, bytes, sha256) that differ from a manifest: ``gone``, ``new``, ``size`` or ``content``."""
    was = manifest.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    both = now.join(was, "path", "full")
    why = F.when(F.col("sha256").isNull(), "gone").when(F.col("_sha256").isNull(), "new").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha256"), "content")
    return both.withColumn("why", why).where("why is not null").select("path", "why")


def final_gates(**violations: DataFrame) -> DataFrame:
    """A row for each named audit: its violations and whether it passed. All must pass before anything is published."""
    rows = [v.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations") for name, v in violations.items()]
    return reduce(DataFrame.unionAll, rows).withColumn("passed", F.col("violations") == 0)
