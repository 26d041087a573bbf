"""Evidence on objects and grips: verdicts on observed frames, intervals between runs, agreement of points, and what a clock left out.

Nulls, ties, empties: what wasn't seen is null and is no evidence either way; the lowest or earliest of equal candidates wins; verdicts without enough looks
say so; an episode without looks has no row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import series


def near_hues(items: DataFrame, most_hue: float = 15.0, most_ratio: float = 3.0) -> DataFrame:
    """Pairs a < b of items (ep, id, hue of 0 to 180, brightness) whose hue and brightness are too close to tell them apart.

    Items meet by bands of hue and of brightness, so only neighbours in both are compared.
    """
    bands, width = int(180 // most_hue), 180.0 / int(180 // most_hue)
    hue = F.least(F.floor(F.col("hue") / width), F.lit(bands - 1)).cast("int")
    light = F.floor(F.log(F.greatest("brightness", F.lit(1.0))) / F.log(F.lit(most_ratio + 1.0))).cast("int")
    own = items.select("ep", "id", "hue", "brightness", hue.alias("band"), light.alias("light"))
    a = own.select("ep", F.col("id").alias("a"), F.col("hue").alias("hue_a"), F.col("brightness").alias("bright_a"), "light", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("band") + k, F.lit(bands)) for k in (-1, 0, 1))))).alias("band"))
    a = a.withColumn("light", F.explode(F.array(*(F.col("light") + k for k in (-1, 0, 1)))))
    b = own.select("ep", F.col("id").alias("b"), F.col("hue").alias("hue_b"), F.col("brightness").alias("bright_b"), "band", "light")
    gap = F.abs(F.col("hue_a") - F.col("hue_b"))
    ratio = F.greatest("bright_a", "bright_b") / F.greatest(F.least("bright_a", "bright_b"), F.lit(1.0))
    near = (F.col("a") < F.col("b")) & (F.least(gap, 180 - gap) < most_hue) & (ratio < most_ratio)
    return a.join(b, ["ep", "band", "light"]).where(near).select("ep", "a", "b")


def _middle(xs: Column) -> Column:
    """The median of a filled array."""
    s, n = F.sort_array(xs), F.size(xs)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def consensus(points: DataFrame, diameter: float, share: float = 0.6, least: int = 3) -> DataFrame:
    """Frames of ``points`` (ep, f, point, x, y) where enough points agree: how many were seen and agree, and their median place.

    The group is that of the point with most others within diameter / 2, the lowest of equal ones. One shuffle: a frame's
    points are one small array.
    """
    def near(p: Column, q: Column) -> Column:
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return F.sqrt(dx * dx + dy * dy) <= diameter / 2

    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    seen = points.where(finite).groupBy("ep", "f").agg(F.sort_array(F.collect_list(F.struct("point", "x", "y"))).alias("ps"))
    seen = seen.withColumn("support", F.expr(f"transform(ps, p -> size(filter(ps, q -> sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= {diameter / 2})))"))
    centre = F.element_at("ps", F.array_position("support", F.array_max("support")).cast("int"))
    seen = seen.withColumn("own", F.filter("ps", lambda q: near(q, centre)))
    enough = F.size("own") >= F.greatest(F.lit(least), F.ceil(F.size("ps") * share))
    xs, ys = F.transform("own", lambda p: p["x"]), F.transform("own", lambda p: p["y"])
    return seen.where(enough).select("ep", "f", F.size("ps").alias("seen"), F.size("own").alias("members"), _middle(xs).alias("x"), _middle(ys).alias("y"))


def departures(observed: DataFrame, still_there: float = 0.85, most: float = 0.4, least: int = 3) -> DataFrame:
    """Verdict for each (ep, id) of ``observed`` (ep, id, score: likeness of the origin to its first look): whether the object has left it."""
    out = observed.groupBy("ep", "id").agg(F.count("score").alias("n"), F.avg((F.col("score") > still_there).cast("double")).alias("remaining"))
    reason = F.when(F.col("n") < least, "origin_unobservable").when(F.col("remaining") < most, "origin_departed").otherwise("object_still_at_origin")
    return out.select("ep", "id", "n", F.when(F.col("n") >= least, F.col("remaining")).alias("remaining"), reason.alias("reason"))


def detached(looks: DataFrame, least: int = 3, most: float = 0.5) -> DataFrame:
    """Whether each (ep, id) of ``looks`` (ep, id, area, both: area shared with a robot) starts apart from the robots: the median share over frames that show it."""
    shown = F.when(F.col("area") > 0, F.col("both") / F.col("area"))
    out = looks.groupBy("ep", "id").agg(F.count(shown).alias("observed"), F.coalesce(F.percentile(shown, 0.5), F.lit(1.0)).alias("overlap"))
    return out.withColumn("verified", (F.col("observed") >= least) & (F.col("overlap") < most))


def visibility(looks: DataFrame) -> DataFrame:
    """Shares of each ep's frames (ep, visible, supported: behind a robot, partial: near one) and how far they explain it; a partial frame weighs half."""
    share = lambda c: F.avg(c.cast("double"))
    full, hidden, partial = F.col("visible"), ~F.col("visible") & F.col("supported"), ~F.col("visible") & ~F.col("supported") & F.col("partial")
    out = looks.groupBy("ep").agg(share(full).alias("visible"), share(hidden).alias("occluded"), share(partial).alias("partial"))
    return out.withColumns({"explained": F.col("visible") + F.col("occluded") + F.col("partial"), "evidence": F.col("visible") + F.col("occluded") + 0.5 * F.col("partial")})


def departure_interval(rows: DataFrame, fps: float, present: float = 0.55, absent: float = 0.25) -> DataFrame:
    """Per ep of ``rows`` (ep, f, v: likeness, clear): last frame of the last present run, start of the first absent run after it, and the last contact up to then.

    Likeness is median-filtered first; runs last max(3, fps / 10) frames, absent ones max(3, fps / 5). Episodes without both are left out.
    """
    short, long_ = max(3, round(fps * 0.1)), max(3, round(fps * 0.2))
    smooth = series.median_filter(rows.select("ep", "f", "v"), 5).select("ep", "f", "med").join(rows.select("ep", "f", "clear"), ["ep", "f"])
    runs = lambda flag, least: series.islands(smooth, flag, least).where("flag").select("ep", "start", "end")
    last = runs((F.col("med") > present) & F.col("clear"), short).groupBy("ep").agg((F.max("end") - 1).alias("last"))
    gone = runs((F.col("med") < absent) & F.col("clear"), long_).join(last, "ep").where("start > last").groupBy("ep", "last").agg(F.min("start").alias("first"))
    touch = runs(~F.col("clear"), short).withColumnsRenamed({"start": "_s", "end": "_e"})
    prior = F.when((F.col("_s") < F.col("first")) & (F.col("_e") <= F.col("first") + round(fps * 0.2)), F.struct("_s", "_e"))
    out = gone.join(touch, "ep", "left").groupBy("ep", "last", "first").agg(F.max(prior).alias("c"))
    return out.select("ep", "last", "first", F.col("c._s").alias("contact_start"), F.col("c._e").alias("contact_end"))


def settled(rows: DataFrame, spans: DataFrame, fps: float, most_step: float) -> DataFrame:
    """Per ep of ``spans`` (ep, start, stop): the first frame of a quiet run that overlaps the span for max(3, fps / 5) frames.

    ``rows``: ep, f, x, y (null: not observed). Gaps are filled, medians of five taken with the ends repeated; an edge is quiet
    if both its frames are observed and it is shorter than ``most_step``.
    """
    least, w = max(3, round(fps * 0.2)), series.ORDER()
    all_rows = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("seen", F.col("x").isNotNull() & F.col("y").isNotNull())
    for c in ("x", "y"):
        out = out.withColumn(c, series.filled(F.when(F.col("seen"), F.col(c))))
    for c in ("x", "y"):
        first, last = F.first(c).over(all_rows), F.last(c).over(all_rows)
        five = [*(F.coalesce(F.lag(c, k).over(w), first) for k in (2, 1)), F.col(c), *(F.coalesce(F.lead(c, k).over(w), last) for k in (1, 2))]
        out = out.withColumn(f"_{c}", F.sort_array(F.array(*five))[2])
    dx, dy = (F.lead(c).over(w) - F.col(c) for c in ("_x", "_y"))
    out = out.withColumn("quiet", (F.sqrt(dx * dx + dy * dy) < most_step) & F.col("seen") & F.lead("seen").over(w)).where("quiet is not null")
    runs = series.islands(out, F.col("quiet"), least).where("flag").select("ep", F.col("start").alias("_s"), F.col("end").alias("_e"))
    at = F.greatest("_s", "start")
    found = spans.join(runs, "ep").where(F.least("_e", "stop") - at >= least)
    return found.groupBy("ep").agg(F.min(at).alias("settled"))


def removed_motion(clock: DataFrame, rows: DataFrame, most: float, bounds: DataFrame) -> DataFrame:
    """Jumps of a clock (ep, c) by more than one frame between ``bounds`` (ep, opened, closing) that leave out motion: v of ``rows`` ranges by more than ``most`` in them."""
    steps = clock.select("ep", "c").distinct().withColumn("stop", F.lead("c").over(Window.partitionBy("ep").orderBy("c"))).join(bounds, "ep")
    jumps = steps.where((F.col("stop") - F.col("c") > 1) & (F.col("stop") > F.col("opened")) & (F.col("c") < F.col("closing"))).select("ep", "c", "stop")
    inside = rows.select("ep", "f", "v").join(jumps, "ep").where((F.col("f") >= F.floor("c")) & (F.col("f") <= F.ceil("stop")))
    return inside.groupBy("ep", "c", "stop").agg((F.max("v") - F.min("v")).alias("range")).where(F.col("range") > most + 1e-9)


def interruptions(clock: DataFrame, spans: DataFrame) -> DataFrame:
    """Edges of a clock (ep, f, c) inside protected source intervals (ep, start, end) that don't advance by one frame."""
    edges = clock.select("ep", "f", "c", F.lead("c").over(series.ORDER()).alias("next"))
    inside = (F.col("c") >= F.col("start") - 1e-9) & (F.col("next") <= F.col("end") + 1e-9) & (F.col("c") < F.col("end") - 1e-9)
    return edges.join(spans, "ep").where(inside & (F.abs(F.col("next") - F.col("c") - 1) > 1e-8)).select("ep", "f", "c", "next").distinct()


def nearest(rows: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """The ``k`` frames of each ep nearest to its mark (ep, m), the earlier first of equal ones."""
    away = F.abs(F.col("f") - F.col("m"))
    place = F.row_number().over(Window.partitionBy("ep", "m").orderBy(away, "f"))
    return rows.join(marks, "ep").withColumn("place", place).where(F.col("place") <= k)


def alternating(events: DataFrame, cycles: int = 2) -> DataFrame:
    """Pickups in shared order, left before right in each cycle, of eps where both sides have ``cycles`` of them; ``events``: ep, side, pickup."""
    cycle = (F.row_number().over(Window.partitionBy("ep", "side").orderBy("pickup")) - 1).cast("long")
    whole = Window.partitionBy("ep")
    left = F.sum((F.col("side") == "left").cast("int")).over(whole)
    out = events.select("ep", "side", "pickup", cycle.alias("cycle"), left.alias("l"), (F.count("*").over(whole) - left).alias("r"))
    out = out.where((F.col("l") == cycles) & (F.col("r") == cycles))
    return out.select("ep", "side", "cycle", "pickup", (2 * F.col("cycle") + F.when(F.col("side") == "left", 0).otherwise(1)).alias("place"))


def sorted_positions(clock: DataFrame, marks: DataFrame) -> DataFrame:
    """Where marks (ep, m) fall in a sorted clock (ep, c): how many values lie below them, and how many at or below; one sort of both together."""
    both = clock.select("ep", F.col("c").cast("double").alias("c"), F.lit(1).alias("_n")).unionByName(marks.select("ep", F.col("m").cast("double").alias("c"), F.lit(0).alias("_n")))
    w = Window.partitionBy("ep").orderBy("c")
    upto = F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum("_n").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    out = both.select("ep", F.col("c").alias("m"), (upto - same).alias("left"), upto.alias("right"), "_n")
    return out.where("_n = 0").drop("_n").distinct()


def masked_median(rows: DataFrame, *keys: str) -> DataFrame:
    """The lower middle of x where ``masked`` isn't set, and the share of such rows, for each of ``keys``."""
    x = "CASE WHEN NOT masked THEN x END"
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})").alias("median"), F.avg((~F.col("masked")).cast("double")).alias("coverage"))


def gate_verdicts(gates: DataFrame, *keys: str) -> DataFrame:
    """Whether all gates (keys, name, passed) hold, how many don't, and which."""
    failed = F.when(~F.coalesce("passed", F.lit(False)), F.col("name"))
    return gates.groupBy(*keys).agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("verified"), F.count(failed).alias("weak"), F.array_join(F.sort_array(F.collect_set(failed)), ",").alias("reasons"))


def swept_boxes(path: DataFrame, pulls: DataFrame, half_width: float = 0.12, depth: float = 0.20, half_height: float = 0.035) -> DataFrame:
    """The box, along and across its pull, that a drawer behind a handle sweeps; ``path``: ep, f, x, y, z; ``pulls``: ep, pull, opened.

    Only samples within 1.5 lengths of the open place count. Pulls shorter than 0.03 give none.
    """
    place = F.struct("x", "y", "z")
    own = path.join(pulls, "ep").where((F.col("f") >= F.col("pull")) & (F.col("f") <= F.col("opened")))
    at = lambda frame: F.max(F.when(F.col("f") == F.col(frame), place)).over(series.EP())
    own = own.withColumns({"a": at("pull"), "b": at("opened")})
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    own = own.withColumns({"dx": dx, "dy": dy, "length": F.sqrt(dx * dx + dy * dy)}).where("length >= 0.03")
    away = F.sqrt(sum((F.col(c) - F.col(f"b.{c}")) * (F.col(c) - F.col(f"b.{c}")) for c in "xyz"))
    own = own.where(away < F.col("length") * 1.5)
    along = (F.col("x") * F.col("dx") + F.col("y") * F.col("dy")) / F.col("length")
    across = (F.col("y") * F.col("dx") - F.col("x") * F.col("dy")) / F.col("length")
    return own.groupBy("ep").agg(
        (F.min(along) - depth).alias("back"), F.max(along).alias("front"),
        (F.min(across) - half_width).alias("near"), (F.max(across) + half_width).alias("far"),
        (F.min("z") - half_height).alias("low"), (F.max("z") + half_height).alias("high"),
    )


def hold_errors(rows: DataFrame, fps: float, seconds: float) -> DataFrame:
    """Eps of ``rows`` (ep, f, c, held) whose held frames aren't exactly the last round(fps * seconds), or whose clock moves in them."""
    n = round(fps * seconds)
    c = F.when(F.col("held"), F.col("c"))
    out = rows.groupBy("ep").agg(F.count("*").alias("n"), F.count_if("held").alias("held"), F.min(F.when(F.col("held"), F.col("f"))).alias("start"), F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias("moved"))
    return out.where((F.col("held") != n) | ((F.col("held") > 0) & (F.col("start") != F.col("n") - F.col("held"))) | (F.col("moved") > 0))


def held_grasps(rows: DataFrame, pickups: DataFrame, fps: float) -> DataFrame:
    """Per (ep, id) of ``pickups`` (ep, id, approach, start, stop): where a closed jaw of ``rows`` (ep, f, v: aperture) holds something.

    A jaw is settled if max(3, fps / 10) frames range by at most 0.5, below the widest aperture by more than 2. Settling ends where the jaw
    has opened by 2 again; the grasp starts at the first that is within 0.5 of the tightest and ends where it is left. Empty
    closures (2 or less) and grasps shorter than the window are left out.
    """
    window = max(3, round(fps * 0.1))
    w = Window.partitionBy("ep", "id").orderBy("f")
    ahead = w.rowsBetween(0, window - 1)
    inside = rows.select("ep", "f", "v").join(pickups, "ep").where((F.col("f") >= F.col("approach")) & (F.col("f") <= F.col("stop")))
    inside = inside.withColumns({"low": F.min("v").over(ahead), "high": F.max("v").over(ahead), "full": F.count("v").over(ahead) == window, "wide": F.max("v").over(Window.partitionBy("ep", "id"))})
    level = F.when((F.col("f") >= F.col("start")) & (F.col("f") + window <= F.col("stop")) & (F.col("high") - F.col("low") <= 0.5) & (F.col("high") < F.col("wide") - 2), F.col("high"))
    inside = inside.where("full").withColumn("level", level)
    reopened = F.coalesce((F.col("f") + window <= F.col("stop")) & (F.col("low") > F.min("level").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 2), F.lit(False))
    inside = inside.withColumn("_r", reopened.cast("int")).withColumn("level", F.when(F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0, F.col("level")))
    whole = Window.partitionBy("ep", "id")
    inside = inside.withColumn("limit", F.min("level").over(whole) + 0.5).where("limit > 2.5")
    inside = inside.withColumn("grasp", F.min(F.when(F.col("level") <= F.col("limit"), F.col("f"))).over(whole))
    left = F.min(F.when((F.col("f") >= F.col("grasp") + window) & (F.col("low") > F.col("limit")), F.col("f")))
    out = inside.groupBy("ep", "id", "grasp", "limit", "stop").agg(left.alias("_left")).withColumn("end", F.coalesce("_left", "stop"))
    return out.where(F.col("end") - F.col("grasp") >= window).select("ep", "id", "grasp", "end", "limit")


def robust_line(pairs: DataFrame, *keys: str, rounds: int = 3, least: int = 50, least_std: float = 5.0, least_off: float = 5.0) -> DataFrame:
    """gain and offset of y over x for each of ``keys``, fitted again after residuals far from their median (3 deviations, 5 at least) are left out.

    Values of 5 or less and of 250 or more don't count. A key with too few or too equal values keeps its fit, at first gain 1 and
    offset 0. Both are clipped. All rounds are windows over the same keys: one shuffle.
    """
    rows = pairs.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"keep": (F.least("x", "y") > 5) & (F.greatest("x", "y") < 250), "gain": F.lit(1.0), "offset": F.lit(0.0), "on": F.lit(True)})
    kept = lambda c: F.when(F.col("keep"), c)
    w = Window.partitionBy(*keys)
    for _ in range(rounds):
        kx, ky = kept(F.col("x")), kept(F.col("y"))
        rows = rows.withColumns({"_n": F.count(kx).over(w), "_s": F.stddev_pop(kx).over(w), "_a": F.regr_slope(ky, kx).over(w), "_b": F.regr_intercept(ky, kx).over(w)})
        rows = rows.withColumn("on", F.col("on") & (F.col("_n") >= least) & F.coalesce(F.col("_s") >= least_std, F.lit(False)))
        rows = rows.withColumns({"gain": F.when(F.col("on"), F.col("_a")).otherwise(F.col("gain")), "offset": F.when(F.col("on"), F.col("_b")).otherwise(F.col("offset"))})
        rows = rows.withColumn("_res", F.col("y") - (F.col("gain") * F.col("x") + F.col("offset")))
        rows = rows.withColumn("_off", F.abs(F.col("_res") - F.percentile(kept(F.col("_res")), 0.5).over(w)))
        near = F.coalesce(F.col("_off") < F.greatest(F.lit(least_off), 3 * F.percentile(kept(F.col("_off")), 0.5).over(w)), F.lit(False))
        rows = rows.withColumn("_near", near).withColumn("keep", F.col("keep") & (~F.col("on") | F.col("_near"))).select(*keys, "x", "y", "keep", "gain", "offset", "on")
    clip = lambda c, a, b: F.least(F.greatest(F.max(c), F.lit(a)), F.lit(b)).alias(c)
    return rows.groupBy(*keys).agg(clip("gain", 0.65, 1.5), clip("offset", -50.0, 50.0))
