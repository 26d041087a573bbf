"""What tracks of objects and grippers say: idle spans, visits to a box, returns of a drawer, scored grasp hypotheses.

Tracks have a row a frame (ep, f); a coordinate that is null was not seen and is never made up where evidence is counted. Windows partition by
episode, or by candidate, whose window of frames is bounded; intervals meet frames by equality on (ep, f), so no pairs are made that don't count.
Episodes without a candidate, visit or span have no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from . import clocks, series
from .review import reasons


def idle_spans(clock: DataFrame, stages: DataFrame, rest: int) -> DataFrame:
    """Half-open spans of output frames that leave the loss of the left arm (clock: ep, t, left, right, held; stages: ep, peak, opened, withdrawn).

    Repeats of a source frame and held frames are idle, but for the wait at the peak until the drawer is open; ``rest`` frames after the withdrawal
    all the remainder is.
    """
    marked = clocks.idle_mask(clock.withColumnRenamed("t", "f"), "left").join(stages, "ep")
    wait = clocks.required_wait(F.col("left"), F.col("right"), F.col("peak"), F.col("opened"))
    done = F.count_if(F.col("left") < F.col("withdrawn")).over(series.EP())
    end = F.least(done + rest, F.count("*").over(series.EP()))
    flag = (F.col("f") >= end) | (~wait & (F.col("held") | F.col("idle")))
    marked = marked.select("ep", "f", flag.alias("flag"))
    return series.islands(marked, F.col("flag")).where("flag").drop("flag")


def close_proposals(quiet: DataFrame, spans: DataFrame, keep: int) -> DataFrame:
    """Where the closing is prepared, for spans (ep, gate, closing): ``keep`` frames before the end of the last quiet run (ep, start, end) within them, else the gate."""
    runs = quiet.select("ep", "start", "end").join(spans, "ep").where((F.col("end") > F.col("gate")) & (F.col("start") < F.col("closing")))
    last = runs.groupBy("ep").agg(F.max_by("end", "start").alias("_end"))
    boundary = F.least(F.col("closing"), F.greatest(F.col("gate"), F.col("_end") - keep))
    return spans.join(last, "ep", "left").select("ep", "gate", "closing", F.when(F.col("_end").isNull(), F.col("gate")).otherwise(boundary).alias("boundary"))


def _seen(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def bin_visits(track: DataFrame, visits: DataFrame, fps: float, most_step: float) -> DataFrame:
    """The first stay of a gripper (ep, f, x, y) in a box after its pickup (visits: ep, pickup, stop, left, right, top, bottom).

    ``entry`` and ``leaves`` bound the first run inside of 0.15 s, from 3 frames after the pickup on; ``clearance`` is the first sight outside after it
    (none: no visit); ``release`` the end of the last pause inside (median of 5 steps below ``most_step``), else its last frame.
    """
    inside = _seen("x", "y") & (F.col("x") > F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") > F.col("top")) & (F.col("y") < F.col("bottom"))
    track, visits = track.select("ep", "f", "x", "y"), visits.select("ep", "pickup", "stop", "left", "right", "top", "bottom")
    rows = track.join(visits, "ep").select("ep", "f", "stop", "x", "y", _seen("x", "y").alias("seen"), F.coalesce(inside, F.lit(False)).alias("near"), (F.col("f") >= F.col("pickup") + 3).alias("late"))
    runs = series.islands(rows, F.col("near") & F.col("late") & (F.col("f") < F.col("stop")), max(3, round(fps * 0.15))).where("flag")
    first = runs.groupBy("ep").agg(F.min(F.struct("start", "end")).alias("r")).select("ep", F.col("r.start").alias("entry"), F.col("r.end").alias("leaves"))
    out = rows.join(first, "ep").where((F.col("f") >= F.col("leaves")) & (F.col("f") < F.col("stop")) & F.col("seen") & ~F.col("near"))
    out = out.groupBy("ep", "entry", "leaves").agg(F.min("f").alias("clearance"))
    w = series.ORDER()
    step = F.sqrt((F.lead("x").over(w) - F.col("x")) ** 2 + (F.lead("y").over(w) - F.col("y")) ** 2)
    steps = rows.select("ep", "f", F.coalesce(F.nanvl(step, F.lit(float("inf"))), F.lit(float("inf"))).alias("v"), F.lead("f").over(w).alias("_next")).where("_next is not null").drop("_next")
    slow = series.median_filter(steps, 5).join(out, "ep").where((F.col("f") >= F.col("entry")) & (F.col("f") < F.col("leaves") - 1))
    pauses = series.islands(slow.select("ep", "f", "med"), F.col("med") < most_step, 3).where("flag").groupBy("ep").agg(F.max("end").alias("_pause"))
    return out.join(pauses, "ep", "left").select("ep", "entry", "leaves", "clearance", F.coalesce("_pause", F.col("leaves") - 1).alias("release"))


def observed_returns(track: DataFrame, drawers: DataFrame, fps: float, least: float) -> DataFrame:
    """The frame at which a drawer's handle starts to go back in, as the gripper (ep, f, x, y) and the interior's ``area`` (null: not measured) show it.

    drawers: ep, opening, pull, baseline, span. Places are projected on the way from the pull to the median of the first 0.2 s after the opening, if that is
    ``least`` long: 0 is shut, 1 is open. A run of 0.15 s of falling projection counts if it comes after the opening, starts at 0.7 or more, falls by 0.15,
    and is followed within 2 s by a sight below 0.3 with little interior left, without rising by over 0.1 before. The first such run is given.
    """
    early = max(3, round(fps * 0.2))
    track, drawers = track.select("ep", "f", "x", "y", "area"), drawers.select("ep", "opening", "pull", "baseline", "span")
    rows = track.join(drawers, "ep").withColumn("seen", _seen("x", "y"))
    at_pull = F.max(F.when(F.col("seen") & (F.col("f") == F.col("pull")), F.struct("x", "y")))
    opened = F.col("seen") & (F.col("f") >= F.col("opening")) & (F.col("f") < F.col("opening") + early)
    frame = rows.groupBy("ep").agg(at_pull.alias("o"), F.percentile(F.when(opened, F.col("x")), 0.5).alias("mx"), F.percentile(F.when(opened, F.col("y")), 0.5).alias("my"))
    frame = frame.select("ep", F.col("o.x").alias("ox"), F.col("o.y").alias("oy"), (F.col("mx") - F.col("o.x")).alias("dx"), (F.col("my") - F.col("o.y")).alias("dy")).withColumn("d2", F.col("dx") ** 2 + F.col("dy") ** 2)
    rows = rows.join(frame.where(F.sqrt("d2") >= least), "ep")
    way = ((F.col("x") - F.col("ox")) * F.col("dx") + (F.col("y") - F.col("oy")) * F.col("dy")) / F.col("d2")
    rows = rows.withColumn("p", F.when(F.col("seen"), way)).withColumn("v", series.filled(F.col("p")))
    smooth = series.median_filter(rows.select("ep", "f", "seen", "area", "opening", "baseline", "span", "v"), 7)
    smooth = smooth.withColumn("_fall", (series.gradient(F.col("med")) < -0.002) & F.col("seen"))
    runs = series.islands(smooth, F.col("_fall"), max(3, round(fps * 0.15))).where("flag").select("ep", "start", "end")
    ahead = runs.select("ep", "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") + round(fps * 2) - 1)).alias("f")).join(smooth, ["ep", "f"])
    back = F.col("seen") & (F.col("med") < 0.3) & F.coalesce(F.col("area") < F.col("baseline") + F.col("span") * 0.65, F.lit(False)) & (F.col("f") >= F.col("end"))
    run = Window.partitionBy("ep", "start")
    ahead = ahead.withColumns({"_arrival": F.min(F.when(back, F.col("f"))).over(run), "_top": F.max(F.when(F.col("f") == F.col("start"), F.col("med"))).over(run)})
    judged = ahead.groupBy("ep", "start", "opening", "_top").agg(
        F.max(F.when(F.col("f") == F.col("end") - 1, F.col("med"))).alias("low"), F.max(F.when((F.col("f") >= F.col("end")) & (F.col("f") <= F.col("_arrival")), F.col("med"))).alias("high"), F.max("_arrival").alias("arrival")
    )
    good = (F.col("start") > F.col("opening")) & (F.col("_top") >= 0.7) & (F.col("_top") - F.col("low") >= 0.15) & F.col("arrival").isNotNull() & (F.col("high") <= F.col("_top") + 0.1)
    return judged.where(good).groupBy("ep").agg(F.min("start").alias("returns"))


#: Weights of the seven components, and the least score: fixed values.
WEIGHTS = (0.15, 0.10, 0.15, 0.20, 0.25, 0.10, 0.05)
COMPONENTS = ("proximity", "contact", "static_before", "motion_onset", "motion_correlation", "attachment", "release_consistency")
LEAST_SCORE = 0.65


def scored_hypotheses(track: DataFrame, candidates: DataFrame, scale: float, window: int = 30, weights: Sequence[float] = WEIGHTS, least: float = LEAST_SCORE) -> DataFrame:
    """Candidates (ep, id, frame, verified: a release seen elsewhere, or null) of grasps with their components, score, pickup, release and the reasons against them.

    track: ep, f, x, y (object), gx, gy (gripper), jaw. A grasp needs motion of the object with the gripper afterwards and a release: closing alone proves nothing.
    Thresholds are shares of ``scale``. A candidate looks at ``window`` frames on either side, which meet it by equality on (ep, f); runs of release are
    found once for an episode.
    """
    s, w = scale, series.ORDER()
    nxt = lambda c: F.lead(c).over(w) - F.col(c)
    length = lambda a, b: F.sqrt(F.col(a) ** 2 + F.col(b) ** 2)
    candidates = candidates.select("ep", "id", "frame", "verified")
    rows = track.select("ep", "f", "x", "y", "gx", "gy", "jaw").withColumn("seen", _seen("x", "y", "gx", "gy"))
    rows = rows.withColumns({"edge": F.coalesce(F.col("seen") & F.lead("seen").over(w), F.lit(False)), "vx": nxt("x"), "vy": nxt("y"), "wx": nxt("gx"), "wy": nxt("gy"), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "n": F.count("*").over(series.EP())})
    rows = rows.withColumns({"speed": length("vx", "vy"), "hand": length("wx", "wy"), "apart": F.sqrt((F.col("vx") - F.col("wx")) ** 2 + (F.col("vy") - F.col("wy")) ** 2), "gap": F.when(F.col("seen"), F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2))})
    whole = series.EP()
    span = F.coalesce(F.max("jaw").over(whole) - F.min("jaw").over(whole), F.lit(0.0))
    rows = rows.withColumn("jaws", span).withColumn("opens", F.coalesce(series.lagged(F.col("jaw"), 8) > F.greatest(F.lit(1.0), F.col("jaws") * 0.08), F.lit(False)))
    leaving = F.col("edge") & (F.col("speed") < s * 0.002) & (F.col("hand") > s * 0.003) & (F.col("apart") > s * 0.002)
    leaves = series.islands(rows.where("f < n - 1"), leaving, 3).where("flag").select("ep", F.col("start").alias("a"), F.col("end").alias("b"))

    near = candidates.withColumn("f", F.explode(F.sequence(F.greatest(F.col("frame") - max(window, 8), F.lit(0)), F.col("frame") + max(window, 8)))).join(rows, ["ep", "f"])
    f, frame, own = F.col("f"), F.col("frame"), Window.partitionBy("ep", "id")
    begin, end = F.greatest(frame - window, F.lit(0)), F.least(F.col("n"), frame + window + 1)
    near = near.withColumns({"pre": F.col("edge") & (f >= begin) & (f < F.greatest(begin, frame - 2)), "post": F.col("edge") & (f >= frame) & (f < end - 1)})
    near = near.withColumn("_rank", F.when(F.col("pre"), F.sum(F.col("pre").cast("int")).over(own.orderBy("f").rowsBetween(Window.unboundedPreceding, 0))))
    at = lambda c, cond: F.max(F.when(cond, F.col(c))).over(own)
    first5 = F.col("_rank") <= 5
    near = near.withColumns({f"a{c}": F.coalesce(F.percentile(F.when(first5, F.col(c)), 0.5).over(own), at(c, f == frame)) for c in "xy"} | {f"i{c}": F.coalesce(at(c, F.col("_rank") == 1), at(c, f == frame)) for c in "xy"})
    away = F.sqrt((F.col("nx") - F.col("ax")) ** 2 + (F.col("ny") - F.col("ay")) ** 2)
    moving = F.coalesce(F.col("post") & (F.col("speed") > s * 0.0015) & (F.col("apart") < s * 0.012) & (away >= s * 0.01), F.lit(False))
    order = own.orderBy("f")
    near = near.withColumn("moving", moving)
    start = (F.col("moving") & F.lead("moving", 1, False).over(order) & F.lead("moving", 2, False).over(order))
    near = near.withColumn("pickup", F.min(F.when(start, f)).over(own) + 1)

    once = near.groupBy("ep", "id", "frame", "verified", "n", "pickup", "ix", "iy").agg(F.max("jaws").alias("jaws"))
    spot = track.select("ep", F.col("f").alias("a"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    later = once.join(leaves, "ep").where(F.col("a") > F.col("pickup") + 3).join(spot, ["ep", "a"])
    later = later.where(F.sqrt((F.col("rx") - F.col("ix")) ** 2 + (F.col("ry") - F.col("iy")) ** 2) > s * 0.03)
    found = later.groupBy("ep", "id").agg(F.min(F.struct("a", "b")).alias("run"))
    near = near.join(found, ["ep", "id"], "left")
    verified = F.when((F.col("pickup") < F.col("verified")) & (F.col("verified") < F.col("n")), F.col("verified"))
    near = near.withColumn("release", F.coalesce(verified, F.col("run.a") + 1))

    carried = F.col("edge") & (f >= F.coalesce("pickup", frame)) & (f < F.least(end - 1, F.coalesce("release", end - 1)))
    active = carried & ((F.col("speed") > s * 0.0015) | (F.col("hand") > s * 0.0015))
    closest = F.min(F.when((f >= frame - 3) & (f <= frame + 3), F.col("gap")))
    median = lambda c, cond: F.percentile(F.when(cond, F.col(c)), 0.5)
    out = near.groupBy("ep", "id", "frame", "pickup", "release").agg(
        F.count_if("pre").alias("_pre"), F.count_if("post").alias("_post"), closest.alias("_near"), median("speed", F.col("pre")).alias("_still"),
        ((median("jaw", (f >= frame - 8) & (f < frame)) - median("jaw", (f >= frame) & (f < frame + 8))) / F.greatest(F.max("jaws"), F.lit(1.0))).alias("_closure"),
        median("speed", active).alias("_moves"), F.avg(F.when(active, F.exp(-F.col("apart") / (s * 0.008)))).alias("_with"), F.avg(F.when(carried, (F.col("gap") < s * 0.12).cast("double"))).alias("_held"),
    )
    zero = F.lit(0.0)
    parts = (
        F.coalesce(F.exp(-F.col("_near") / (s * 0.08)), zero),
        F.coalesce(F.exp(-F.col("_near") / (s * 0.035)), zero),
        F.coalesce(F.exp(-F.col("_still") / (s * 0.002)), zero),
        F.coalesce(X.clip(F.col("_moves") / (s * 0.006), 0.0, 1.0), zero),
        F.coalesce("_with", zero),
        F.coalesce("_held", zero),
        F.col("release").isNotNull().cast("double"),
    )
    out = out.select("ep", "id", "frame", "pickup", "release", "_pre", "_post", F.coalesce("_closure", zero).alias("closure"), *(p.alias(c) for c, p in zip(COMPONENTS, parts)))
    out = out.withColumn("score", X.dot(F.array(*COMPONENTS), F.array(*map(F.lit, weights))))
    why = reasons(
        insufficient_pre_grasp_visibility=F.col("_pre") < 3,
        insufficient_future_visibility=F.col("_post") < min(10, max(5, window // 3)),
        no_stable_correlated_pickup=F.col("pickup").isNull(),
        release_not_verified=F.col("release").isNull(),
        insufficient_persistent_attachment=F.col("attachment") < 0.5,
        low_posterior_score=F.col("score") < least,
    )
    return out.withColumn("why", why).withColumn("accepted", F.size("why") == 0).drop("_pre", "_post")
