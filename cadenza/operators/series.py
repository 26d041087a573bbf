"""Frame-ordered operators. Frames have ep (episode), f (0, 1, ... in it), v (value) or vec (vector).

All windows partition by ep and order by f, so Spark shuffles the frames once by episode for a whole chain.

Nulls, ties, empties: a null value is a gap; steps beside it are null and no motion, windows leave it out, ``filled`` closes it. The earlier of equal frames
wins. An episode of one frame has no steps, edges or energy. Repeated (ep, f) rows are told by ``audit.repeated_keys`` first. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X



def EP():
    return Window.partitionBy("ep")


def ORDER():
    return EP().orderBy("f")


def frames(rows: DataFrame, episode: str, order: Sequence[str], *keep: Column) -> DataFrame:
    """ep, f and ``keep``: rows numbered from 0 within their episode."""
    w = Window.partitionBy(episode).orderBy(*order)
    return rows.select(F.col(episode).alias("ep"), (F.row_number().over(w) - 1).cast("long").alias("f"), *keep)


def rows_between(a: int, b: int):
    return ORDER().rowsBetween(a, b)


def still(rows: DataFrame, moves: Column) -> DataFrame:
    """``rows`` with ``still``: neither the edge before nor the one after moves; ``moves`` is of the edge before (null: first frame)."""
    rows = rows.withColumn("_moves", moves)
    return rows.withColumn("still", ~F.coalesce("_moves", F.lit(False)) & ~F.coalesce(F.lead("_moves").over(ORDER()), F.lit(False))).drop("_moves")


def edge_moves(v: Column, fps: float, threshold: float) -> Column:
    """Whether the step before a frame is as fast as ``threshold`` or faster; null at the first."""
    return F.abs(v - F.lag(v).over(ORDER())) * fps >= threshold


def static_edges(rows: DataFrame, fps: float, tail_seconds: float) -> DataFrame:
    """Per episode, from ``still``: frames to drop at the head, and the interval [start, stop) that stays.

    The tail keeps ceil(tail_seconds * fps) still frames. An episode without movement keeps its last max(1, keep) frames.
    """
    keep = -int(-tail_seconds * fps // 1)
    moving = F.when(~F.col("still"), F.col("f"))
    out = rows.groupBy("ep").agg(F.count("*").alias("n"), F.min(moving).alias("first"), F.max(moving).alias("last"))
    tail = F.col("n") - 1 - F.col("last")
    static = F.col("first").isNull()
    start = F.when(static, F.greatest(F.col("n") - max(1, keep), F.lit(0))).otherwise(F.col("first"))
    stop = F.when(static, F.col("n")).otherwise(F.least(F.col("last") + 1 + keep, F.col("n")))
    head_frames = F.when(static, F.col("n")).otherwise(F.col("first"))
    tail_frames = F.when(static, F.col("n")).otherwise(tail)
    return out.select(
        "ep",
        "n",
        head_frames.cast("long").alias("head_frames"),
        tail_frames.cast("long").alias("tail_frames"),
        start.cast("long").alias("start"),
        stop.cast("long").alias("stop"),
        static.alias("all_static"),
        F.greatest(F.lit(keep) - tail_frames, F.lit(0)).cast("long").alias("shortfall"),
    )


def trimmed(rows: DataFrame, edges: DataFrame, fps: float) -> DataFrame:
    """Rows in [start, stop) with new episode ranks, frame numbers, global index and timestamps.

    Offsets are sums over one row an episode, in two levels; rows only join them on ep.
    """
    kept = edges.select("ep", "start", "stop", (F.col("stop") - F.col("start")).alias("length"))
    places = global_offsets(kept.select("ep", F.col("length").alias("n"))).select("ep", F.col("from").alias("offset"))
    ranks = global_offsets(kept.select("ep", F.lit(1).cast("long").alias("n"))).select("ep", F.col("from").alias("new_ep"))
    kept = kept.join(places, "ep").join(ranks, "ep")
    joined = rows.join(kept, "ep").where((F.col("f") >= F.col("start")) & (F.col("f") < F.col("stop")))
    new = F.col("f") - F.col("start")
    return joined.withColumns({"new_f": new, "index": F.coalesce("offset", F.lit(0)) + new, "timestamp": new / fps}).drop("start", "stop", "length", "offset")


def energy(rows: DataFrame, step: Column, kernel: int = 7, floor: float = 0.08) -> DataFrame:
    """ep, i, e: energy of the edge before frame i + 1: centred sum over ``kernel`` edges (zeros outside) / kernel - floor, at least 0."""
    half = kernel // 2
    edges = rows.withColumn("_d", step).where(F.col("f") > 0)
    smooth = F.sum("_d").over(rows_between(-half, half)) / kernel
    return edges.withColumn("e", F.greatest(smooth - floor, F.lit(0.0))).select("ep", (F.col("f") - 1).alias("i"), "e")


def energies(rows: DataFrame, kernel: int = 7, floor: float = 0.08, **steps: Column) -> DataFrame:
    """ep, i and the energy of each of ``steps`` on the edge before frame i + 1, as ``energy`` has it: one window for all."""
    half = kernel // 2
    edges = rows.withColumns({f"_{c}": step for c, step in steps.items()}).where(F.col("f") > 0)
    smooth = [F.greatest(F.sum(f"_{c}").over(rows_between(-half, half)) / kernel - floor, F.lit(0.0)).alias(c) for c in steps]
    return edges.select("ep", (F.col("f") - 1).alias("i"), *smooth)


def energy_split(both: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Per episode the cut with the least energy on the wrong sides: right's share before it plus left's share from it on; earliest wins.

    ``both``: ep, i, left, right (edge energies, n edges). The cut lies in [max(1, round(low n)), min(n - 1, round(high n))).
    Episodes without energy in an arm, or too short for that window, have no row.
    """
    w = EP().orderBy("i")
    before = F.sum("right").over(w.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("right").over(EP())
    after = F.sum("left").over(w.rowsBetween(0, Window.unboundedFollowing)) / F.sum("left").over(EP())
    cost = both.select("ep", "i", F.count("*").over(EP()).alias("n"), (before + after).alias("cost"))
    inside = (F.col("i") >= F.greatest(F.lit(1), X.half_even(F.col("n") * low))) & (F.col("i") < F.least(F.col("n") - 1, X.half_even(F.col("n") * high)))
    best = cost.where(inside & F.col("cost").isNotNull()).groupBy("ep").agg(F.min(F.struct(F.round("cost", 9).alias("c"), "i")).alias("b"), F.max("n").alias("n"))
    return best.select("ep", F.col("b.i").alias("split"), F.col("b.c").alias("cost"), "n")


def _bounds(rows: DataFrame, side: str, share: float, pad: int) -> DataFrame:
    """[start, end) of one arm's activity within the edges [low, high) of each episode, by quantiles of cumulative energy."""
    inside = rows.where((F.col("i") >= F.col("low")) & (F.col("i") < F.col("high")))
    cum = F.sum(side).over(EP().orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    marked = inside.select("ep", "i", "low", "high", F.sum(side).over(EP()).alias("total"), cum.alias("cum"))
    reach = lambda q: F.min(F.when(F.round(F.col("cum") - q * F.col("total"), 9) >= 0, F.col("i")))
    out = marked.where("total > 0").groupBy("ep").agg(reach(share).alias("a"), reach(1 - share).alias("b"), F.max("low").alias("low"), F.max("high").alias("high"))
    return out.select("ep", F.greatest(F.col("a") - pad, "low").alias("start"), F.least(F.col("b") + 2 + pad, "high").alias("end"))


def active_interval(energy: DataFrame, share: float = 0.005, pad: int = 3) -> DataFrame:
    """ep, start, end of one arm's activity (ep, i, e), whatever the other arm does; episodes without energy have no row."""
    n = F.count("*").over(EP())
    return _bounds(energy.withColumns({"low": F.lit(0).cast("long"), "high": n}), "e", share, pad)


def segments(both: DataFrame, share: float = 0.005, pad: int = 3, least: int = 30, most_cross: float = 0.1) -> DataFrame:
    """Left and right activity segments before and after the split, shares of energy on the wrong side, and ``rejected``.

    Overlapping segments are parted at the middle. All is windows and one aggregate over the episode, so the edges are shuffled once.
    """
    w, past = EP().orderBy("i"), Window.unboundedPreceding
    total = {c: F.sum(c).over(EP()) for c in ("left", "right")}
    before, after = F.sum("right").over(w.rowsBetween(past, -1)) / total["right"], F.sum("left").over(w.rowsBetween(0, Window.unboundedFollowing)) / total["left"]
    rows = both.select("ep", "i", "left", "right", F.count("*").over(EP()).alias("n"), F.round(before + after, 9).alias("_cost"))
    inside = (F.col("i") >= F.greatest(F.lit(1), X.half_even(F.col("n") * 0.2))) & (F.col("i") < F.least(F.col("n") - 1, X.half_even(F.col("n") * 0.8)))
    rows = rows.withColumn("split", F.min(F.when(inside & F.col("_cost").isNotNull(), F.struct("_cost", "i"))).over(EP())["i"]).where("split is not null")
    own = F.when(F.col("i") < F.col("split"), F.col("left")).otherwise(F.col("right"))
    half = Window.partitionBy("ep", F.col("i") < F.col("split"))
    rows = rows.withColumn("_own", own).withColumns({"_cum": F.sum("_own").over(half.orderBy("i").rowsBetween(past, 0)), "_all": F.sum("_own").over(half)})
    first = F.col("i") < F.col("split")
    reach = lambda q, side: F.min(F.when(side & (F.col("_all") > 0) & (F.round(F.col("_cum") - q * F.col("_all"), 9) >= 0), F.col("i")))
    wrong = lambda side, cond: F.sum(F.when(cond, F.col(side)).otherwise(0.0)) / F.sum(side)
    out = rows.groupBy("ep", "split", "n").agg(
        reach(share, first).alias("la"), reach(1 - share, first).alias("lb"), reach(share, ~first).alias("ra"), reach(1 - share, ~first).alias("rb"),
        wrong("right", first).alias("right_before"), wrong("left", ~first).alias("left_after"),
    ).where("la is not null and ra is not null")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"ls": F.greatest(F.col("la") - pad, zero), "le": F.least(F.col("lb") + 2 + pad, F.col("split")), "rs": F.greatest(F.col("ra") - pad, F.col("split")), "re": F.least(F.col("rb") + 2 + pad, F.col("n"))})
    middle, overlap = F.floor((F.col("le") + F.col("rs")) / 2).cast("long"), F.col("le") > F.col("rs")
    out = out.withColumns({"le": F.when(overlap, middle).otherwise(F.col("le")), "rs": F.when(overlap, middle).otherwise(F.col("rs"))})
    rejected = (F.greatest("right_before", "left_after") > most_cross) | (F.least(F.col("le") - F.col("ls"), F.col("re") - F.col("rs")) < least)
    return out.select("ep", "split", "ls", "le", "rs", "re", "right_before", "left_after", rejected.alias("rejected"))


def islands(rows: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """Runs of frames with equal ``flag`` as half-open ranges: ep, flag, start, end."""
    marked = rows.select("ep", "f", flag.alias("flag"))
    new = F.coalesce(~F.col("flag").eqNullSafe(F.lag("flag").over(ORDER())), F.lit(True)) | (F.row_number().over(ORDER()) == 1)
    run = F.sum(new.cast("int")).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("run", run).groupBy("ep", "run", "flag").agg(F.min("f").alias("start"), (F.max("f") + 1).alias("end"))
    return out.where(F.col("end") - F.col("start") >= least).select("ep", "flag", "start", "end")


def filled(v: Column) -> Column:
    """``v`` with gaps interpolated by frame, and ends held."""
    up = ORDER().rowsBetween(Window.unboundedPreceding, 0)
    down = ORDER().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col("f"))
    a, b = F.last(v, True).over(up), F.first(v, True).over(down)
    fa, fb = F.last(at, True).over(up), F.first(at, True).over(down)
    between = a + (F.col("f") - fa) / (fb - fa) * (b - a)
    return F.coalesce(v, between, a, b)


def median_filter(rows: DataFrame, size: int = 5) -> DataFrame:
    """``rows`` with ``med``: median over ``size`` frames, edges mirrored (the edge frame repeats)."""
    half = size // 2
    n = F.count("*").over(EP())
    numbered = rows.withColumn("_n", n)
    head = numbered.where(F.col("f") < half).withColumns({"f": -1 - F.col("f"), "_x": F.lit(True)})
    tail = numbered.where(F.col("f") >= F.col("_n") - half).withColumns({"f": 2 * F.col("_n") - 1 - F.col("f"), "_x": F.lit(True)})
    every = numbered.withColumn("_x", F.lit(False)).unionByName(head).unionByName(tail)
    return every.withColumn("med", F.percentile("v", 0.5).over(rows_between(-half, half))).where(~F.col("_x")).drop("_x", "_n")


def lagged(v: Column, k: int) -> Column:
    """Change over ``k`` frames; the first frame repeats before the start."""
    first = F.first(v).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))
    return v - F.coalesce(F.lag(v, k).over(ORDER()), first)


def aperture_states(rows: DataFrame, fps: float, least_span: float = 1.0) -> DataFrame:
    """``rows`` with ``state``: CLOSED below and OPEN from the middle of the p10-p90 span on, CLOSING or OPENING if the
    smoothed value moves by more than 8 % of the span in a tenth of a second; later rules win. Frames without a
    value, and episodes with fewer than five or with a span below ``least_span``, are UNKNOWN.
    """
    marked = rows.withColumns({"_raw": F.col("v"), "_low": F.percentile("v", 0.1).over(EP()), "_high": F.percentile("v", 0.9).over(EP()), "_valid": F.count("v").over(EP())})
    smooth = median_filter(marked.withColumn("v", filled(F.col("v"))), 5)
    span = F.col("_high") - F.col("_low")
    smooth = smooth.withColumn("_d", lagged(F.col("med"), max(1, round(fps * 0.1))))
    state = (
        F.when(F.col("_raw").isNull() | (F.col("_valid") < 5) | (span < least_span), "UNKNOWN")
        .when(F.col("_d") > span * 0.08, "OPENING")
        .when(F.col("_d") < -span * 0.08, "CLOSING")
        .when(F.col("med") >= (F.col("_low") + F.col("_high")) / 2, "OPEN")
        .otherwise("CLOSED")
    )
    return smooth.withColumns({"state": state, "v": F.col("_raw")}).drop("_raw", "_low", "_high", "_valid", "_d", "med")


def quiet(v: Column, window: int, most: float) -> Column:
    """Whether the values of a full centred window differ by at most ``most``."""
    w = rows_between(-(window // 2), window - 1 - window // 2)
    return (F.count(v).over(w) == window) & (F.max(v).over(w) - F.min(v).over(w) <= most)


def terminal_rest(rows: DataFrame, most: float, fps: float, seconds: float = 1.5, after: int = 0) -> DataFrame:
    """Per episode: where the final stretch within ``most`` starts (not before ``after``), and what follows its first floor(seconds * fps) frames."""
    back = EP().orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_r", F.max("v").over(back) - F.min("v").over(back))
    start = F.greatest(F.coalesce(F.max(F.when(F.col("_r") > most, F.col("f"))) + 1, F.lit(0)), F.lit(after)).cast("long")
    out = marked.groupBy("ep").agg(F.count("*").alias("n"), start.alias("start"))
    return out.select("ep", "start", F.least(F.col("start") + int(seconds * fps), F.col("n")).alias("mask_start"), F.col("n").alias("end"))


def sustained_retreat(rows: DataFrame, window: int, least: float, bounds: DataFrame | None = None) -> DataFrame:
    """Per episode the first frame from which the next steps rise: the first one, all but one of ``window``, and by ``least`` in all."""
    stepped = rows.withColumn("_d", F.lead("v").over(ORDER()) - F.col("v"))
    w = rows_between(0, window - 1)
    marked = stepped.withColumns({"_sum": F.sum("_d").over(w), "_up": F.sum((F.col("_d") > 0).cast("int")).over(w), "_n": F.count("_d").over(w)})
    good = (F.col("_d") > 0) & (F.col("_n") == window) & (F.col("_sum") >= least) & (F.col("_up") >= window - 1)
    if bounds is not None:
        marked = marked.join(bounds, "ep")
        good = good & (F.col("f") >= F.col("low")) & (F.col("f") < F.col("high"))
    return marked.groupBy("ep").agg(F.min(F.when(good, F.col("f"))).alias("retreat"))


def gradient(v: Column) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(v).over(ORDER()), F.lead(v).over(ORDER())
    return F.coalesce((after - before) / 2, after - v, v - before)


def lift_peak(rows: DataFrame, within: float) -> DataFrame:
    """Per episode, of the frames within ``within`` of the greatest height, the slowest; the first of equals."""
    marked = rows.withColumns({"_top": F.max("v").over(EP()), "_speed": F.abs(gradient(F.col("v")))})
    best = marked.where(F.col("v") >= F.col("_top") - within).groupBy("ep").agg(F.min(F.struct(F.round("_speed", 9).alias("s"), "f")).alias("b"))
    return best.select("ep", F.col("b.f").alias("peak"), F.col("b.s").alias("speed"))


def derivatives(rows: DataFrame, fps: float) -> DataFrame:
    """Per episode the greatest speed and acceleration."""
    d = (F.col("v") - F.lag("v").over(ORDER())) * fps
    marked = rows.withColumn("_s", d)
    marked = marked.withColumn("_a", (F.col("_s") - F.lag("_s").over(ORDER())) * fps)
    return marked.groupBy("ep").agg(F.max(F.abs("_s")).alias("max_speed"), F.max(F.abs("_a")).alias("max_acceleration"))


def forward_share(flag: Column, window: int) -> Column:
    """Share of the next ``window`` frames, this one included, with ``flag``."""
    return F.avg(flag.cast("double")).over(rows_between(0, window - 1))


#: Episode numbers that are summed together before the sums themselves are.
EPISODES = 1 << 16


def global_offsets(lengths: DataFrame) -> DataFrame:
    """``lengths`` (ep, n) with the global range [from, to) of each episode, in the order of ep.

    In two levels: running sums within ranges of EPISODES numbers, each a task of its own, and over the few sums of these ranges.
    """
    part = F.floor(F.col("ep") / EPISODES).cast("long")
    rows = lengths.select("ep", "n", part.alias("_part"))
    sums = rows.groupBy(F.col("_part").alias("_of")).agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("n").over(Window.partitionBy("_part").orderBy("ep").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_own", own).join(sums.select("_of", before.alias("_before")), F.col("_part") == F.col("_of"))
    to = F.col("_before") + F.col("_own")
    return both.select("ep", "n", (to - F.col("n")).alias("from"), to.alias("to"))
