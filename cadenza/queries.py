"""The catalogue: every operator bound to the driver's tables, each with the SQL that gives the same rows.

Episodes are users' events (scalar series) or vectors of a label (14 channels, halves as the two sides). Thresholds are scaled
to these values, so both branches of each rule occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as X
from .operators import audit, clocks, events, evidence, series, stats
from .plans import solvers
from .session import table
from .streaming import sessions, tumbling

FLAGSHIP = "trim_static_edges"
FPS, SPEED, TAIL = 2.0, 80.0, 1.0
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def user_frames(spark: SparkSession, d: str) -> DataFrame:
    return series.frames(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value").alias("v"), F.col("event_type").alias("kind"), "event_id", "ts")


def label_frames(spark: SparkSession, d: str) -> DataFrame:
    return series.frames(table(spark, d, "embeddings"), "label", ["vec_id"], X.doubles(F.slice("embedding", 1, 14)).alias("vec"), "vec_id")


def whole_vectors(spark: SparkSession, d: str) -> DataFrame:
    """As label_frames, with all channels."""
    return series.frames(table(spark, d, "embeddings"), "label", ["vec_id"], X.doubles(F.col("embedding")).alias("vec"))


S = "s AS (SELECT user_id AS ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, value AS v, event_type AS kind, event_id, ts FROM events)"
V = "e AS (SELECT label::BIGINT AS ep, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, vec_id, embedding FROM embeddings)"
W = "(PARTITION BY ep ORDER BY f)"

# ---- static edges, trimming

STILL = f"""{S}, m AS (SELECT *, abs(v - lag(v) OVER {W}) * {FPS} >= {SPEED} AS moves FROM s),
st AS (SELECT *, NOT coalesce(moves, false) AND NOT coalesce(lead(moves) OVER {W}, false) AS still FROM m)"""
EDGES = f"""{STILL}, g AS (SELECT ep, count(*) AS n, min(CASE WHEN NOT still THEN f END) AS a, max(CASE WHEN NOT still THEN f END) AS b FROM st GROUP BY ep),
ed AS (SELECT ep, n, coalesce(a, n) AS head_frames, coalesce(n - 1 - b, n) AS tail_frames,
  CASE WHEN a IS NULL THEN greatest(n - 2, 0) ELSE a END AS start, CASE WHEN a IS NULL THEN n ELSE least(b + 3, n) END AS stop,
  a IS NULL AS all_static FROM g)"""


def _still(spark, d):
    rows = user_frames(spark, d)
    return series.still(rows, series.edge_moves(F.col("v"), FPS, SPEED))


def _edges(spark, d):
    return series.static_edges(_still(spark, d), FPS, TAIL)


@query(f"WITH {EDGES} SELECT ep, n, head_frames, tail_frames, start, stop, all_static, greatest(2 - tail_frames, 0) AS shortfall FROM ed")
def trim_static_edges(spark, d):
    return _edges(spark, d)


@query(f"""WITH {EDGES}, k AS (SELECT ep, start, stop, row_number() OVER (ORDER BY ep) - 1 AS new_ep,
  coalesce(sum(stop - start) OVER (ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM ed)
SELECT ep, new_ep, f - start AS new_f, o + f - start AS "index", (f - start) / {FPS} AS timestamp, event_id FROM st JOIN k USING (ep) WHERE f >= start AND f < stop""")
def trim_reindexed_rows(spark, d):
    rows = _still(spark, d)
    return series.trimmed(rows, series.static_edges(rows, FPS, TAIL), FPS).select("ep", "new_ep", "new_f", "index", "timestamp", "event_id")


@query(f"WITH {EDGES} SELECT count(*) AS episodes, sum(n)::BIGINT AS frames, sum(stop - start)::BIGINT AS kept, count_if(all_static) AS static, min(start) AS least_start FROM ed")
def dataset_rollup(spark, d):
    return _edges(spark, d).agg(F.count("*").alias("episodes"), F.sum("n").alias("frames"), F.sum(F.col("stop") - F.col("start")).alias("kept"), F.count_if("all_static").alias("static"), F.min("start").alias("least_start"))


@query(f"WITH {S}, l AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), o AS (SELECT ep, n, sum(n) OVER (ORDER BY ep)::BIGINT AS t FROM l) SELECT ep, n, t - n AS \"from\", t AS \"to\" FROM o")
def global_offsets(spark, d):
    return series.global_offsets(user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n")))


# ---- statistics

U = f"{V}, u AS (SELECT ep, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM e, range(1, 65) t(i))"
STATS = "min(x) AS min, max(x) AS max, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(x) AS count"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query(f"WITH {U} SELECT pos::INT AS pos, {STATS}, " + ", ".join(f"round(quantile_cont(x, {q}), 9) AS q{round(100 * q):02d}" for q in stats.QUANTILES) + " FROM u GROUP BY pos")
def vector_feature_stats(spark, d):
    return _rounded(stats.vector_stats(whole_vectors(spark, d)), "mean", "std", *(f"q{round(100 * q):02d}" for q in stats.QUANTILES))


@query(f"WITH {U} SELECT pos::INT AS pos, {STATS} FROM u GROUP BY pos")
def merged_stats(spark, d):
    parts = stats.vector_stats(whole_vectors(spark, d), "vec", "ep", quantiles=False)
    return _rounded(stats.merged_stats(parts, "pos"), "mean", "std")


@query("SELECT event_type AS kind, " + ", ".join(f"round(quantile_cont(value, {q}), 9) AS q{round(100 * q):02d}" for q in stats.QUANTILES) + " FROM events GROUP BY 1")
def value_quantiles(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(*[F.round(F.percentile("value", q), 9).alias(f"q{round(100 * q):02d}") for q in stats.QUANTILES])


@query(f"WITH {S} SELECT ep, round(quantile_cont(abs(v), 0.9), 9) AS p, max(abs(v)) AS most, arg_min(f, (-abs(v), f)) AS at, arg_max(abs(v), f) AS last FROM s GROUP BY ep HAVING quantile_cont(abs(v), 0.9) > 90")
def displacement_p90(spark, d):
    return _rounded(stats.displacement(user_frames(spark, d), F.abs("v")).where("p > 90"), "p")


@query(f"WITH {S} SELECT ep, round((degrees(atan2(avg(sin(radians(v))), avg(cos(radians(v))))) + 360) % 360, 6) AS hue FROM s GROUP BY ep")
def circular_mean(spark, d):
    return user_frames(spark, d).groupBy("ep").agg(F.round(stats.circular_mean(F.col("v")), 6).alias("hue"))


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE value < 20 GROUP BY 1")
def failure_histogram(spark, d):
    return table(spark, d, "events").where("value < 20").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


ISL = f"""i AS (SELECT ep, f, flag, sum(new) OVER {W} AS run FROM (SELECT *, CASE WHEN flag IS NOT DISTINCT FROM lag(flag) OVER {W} AND f > 0 THEN 0 ELSE 1 END AS new FROM x)),
r AS (SELECT ep, flag, min(f) AS start, max(f) + 1 AS "end" FROM i GROUP BY ep, run, flag)"""
RUNS = f"WITH {S}, x AS (SELECT ep, f, v >= 50 AS flag FROM s), {ISL}"


@query(f'{RUNS} SELECT ep, flag, start, "end" FROM r')
def boolean_runs(spark, d):
    return series.islands(user_frames(spark, d), F.col("v") >= 50)


@query(f'{RUNS} SELECT ep, flag, start, "end", start / {FPS} AS start_s, "end" / {FPS} AS end_s FROM r WHERE flag AND "end" - start >= 3')
def stable_runs(spark, d):
    runs = series.islands(user_frames(spark, d), F.col("v") >= 50, 3).where("flag")
    return runs.withColumns({"start_s": F.col("start") / FPS, "end_s": F.col("end") / FPS})


@query(f'{RUNS}, l AS (SELECT ep, max("end" - start) AS longest FROM r WHERE flag GROUP BY ep) SELECT s.ep, count(*) AS n, avg(CASE WHEN v >= 50 THEN 1.0 ELSE 0 END)::DOUBLE AS share, coalesce(any_value(longest), 0) AS longest FROM s LEFT JOIN l USING (ep) GROUP BY s.ep')
def longest_bad_run(spark, d):
    return stats.bad_runs(user_frames(spark, d), F.col("v") >= 50)


# ---- frame-ordered operators

EN = """d AS (SELECT ep, f - 1 AS i, {step} AS x FROM s), en AS (SELECT ep, i, greatest(coalesce(sum(x) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) / 7 - 0.08, 0) AS e FROM d WHERE i >= 0)"""


@query(f"WITH {S}, {EN.format(step=f'abs(v - lag(v) OVER {W})')} SELECT ep, i, round(e, 6) AS e FROM en")
def motion_energy(spark, d):
    rows = user_frames(spark, d)
    return series.energy(rows, F.abs(F.col("v") - F.lag("v").over(series.ORDER()))).withColumn("e", F.round("e", 6))


def _sides(spark, d):
    """Edge energies of both sides: clicks fade over an episode on the left, other events grow on the right."""
    rows = user_frames(spark, d)
    n = F.count("*").over(series.EP())
    rows = rows.withColumns({"l": F.when(F.col("f") * 2 < n, F.col("v")).otherwise(0.0), "r": F.when(F.col("f") * 2 >= n, F.col("v")).otherwise(0.0)})
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(series.ORDER()))
    return series.energies(rows, left=step("l"), right=step("r"))


SIDES = f"""{S}, b AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM s), lr AS (SELECT ep, f, CASE WHEN f * 2 < n THEN v ELSE 0 END AS l, CASE WHEN f * 2 >= n THEN v ELSE 0 END AS r FROM b),
d AS (SELECT ep, f - 1 AS i, abs(l - lag(l) OVER {W}) AS l, abs(r - lag(r) OVER {W}) AS r FROM lr),
bo AS (SELECT ep, i, greatest(sum(l) OVER w / 7 - 0.08, 0) AS lft, greatest(sum(r) OVER w / 7 - 0.08, 0) AS rgt FROM d WHERE i >= 0 WINDOW w AS (PARTITION BY ep ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
c AS (SELECT ep, i, lft, rgt, count(*) OVER p AS n, sum(rgt) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(rgt) OVER p + sum(lft) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / sum(lft) OVER p AS cost FROM bo WINDOW p AS (PARTITION BY ep)),
sp AS (SELECT ep, arg_min(i, (round(cost, 9), i)) AS split, min(round(cost, 9)) AS cost, any_value(n) AS n FROM c WHERE cost IS NOT NULL AND i >= greatest(1, round_even(n * 0.2, 0)) AND i < least(n - 1, round_even(n * 0.8, 0)) GROUP BY ep)"""


@query(f"WITH {SIDES} SELECT ep, split, round(cost, 6) AS cost, n FROM sp")
def energy_split(spark, d):
    return series.energy_split(_sides(spark, d)).withColumn("cost", F.round("cost", 6))


SEG = f"""{SIDES}, j AS (SELECT bo.ep, i, lft, rgt, split, n FROM bo JOIN sp USING (ep)),
lc AS (SELECT ep, i, split, sum(lft) OVER (PARTITION BY ep ORDER BY i) AS cum, sum(lft) OVER (PARTITION BY ep) AS t FROM j WHERE i < split),
rc AS (SELECT ep, i, split, n, sum(rgt) OVER (PARTITION BY ep ORDER BY i) AS cum, sum(rgt) OVER (PARTITION BY ep) AS t FROM j WHERE i >= split),
ls AS (SELECT ep, greatest(min(CASE WHEN round(cum - 0.005 * t, 9) >= 0 THEN i END) - 3, 0) AS ls, least(min(CASE WHEN round(cum - 0.995 * t, 9) >= 0 THEN i END) + 5, any_value(split)) AS le FROM lc WHERE t > 0 GROUP BY ep),
rs AS (SELECT ep, greatest(min(CASE WHEN round(cum - 0.005 * t, 9) >= 0 THEN i END) - 3, any_value(split)) AS rs, least(min(CASE WHEN round(cum - 0.995 * t, 9) >= 0 THEN i END) + 5, any_value(n)) AS re FROM rc WHERE t > 0 GROUP BY ep),
cr AS (SELECT ep, split, sum(CASE WHEN i < split THEN rgt ELSE 0 END) / sum(rgt) AS right_before, sum(CASE WHEN i >= split THEN lft ELSE 0 END) / sum(lft) AS left_after FROM j GROUP BY ep, split),
sg AS (SELECT ep, split, ls, CASE WHEN le > rs THEN (le + rs) // 2 ELSE le END AS le, CASE WHEN le > rs THEN (le + rs) // 2 ELSE rs END AS rs, re, right_before, left_after FROM ls JOIN rs USING (ep) JOIN cr USING (ep)),
seg AS (SELECT *, greatest(right_before, left_after) > 0.1 OR least(le - ls, re - rs) < 12 AS rejected FROM sg)"""


def _segments(spark, d):
    return series.segments(_sides(spark, d), least=12)


@query(f"WITH {SEG} SELECT ep, split, ls, le, rs, re, round(right_before, 6) AS right_before, round(left_after, 6) AS left_after, rejected FROM seg")
def arm_segments(spark, d):
    return _segments(spark, d).withColumns({c: F.round(c, 6) for c in ("right_before", "left_after")})


PLAN = f"""{SEG}, pl AS (SELECT ep, ls, le, rs, re, le - ls AS L, re - rs AS R, g AS grid_index, 8 AS grid_size, (2 * g * (le - ls + re - rs) + 8) // 16 AS position FROM seg, range(0, 8) t(g) WHERE NOT rejected AND g % 2 = 0),
pn AS (SELECT *, greatest(position - L, 0) AS left_start, greatest(L - position, 0) AS right_start FROM pl), pz AS (SELECT *, greatest(left_start + L, right_start + R) AS length FROM pn),
ck AS (SELECT ep, grid_index, t, least(greatest(t - left_start, 0), L - 1) + ls AS left_src, least(greatest(t - right_start, 0), R - 1) + rs AS right_src, t >= left_start AND t < left_start + L AS left_active, t >= right_start AND t < right_start + R AS right_active FROM pz, LATERAL (SELECT unnest(range(0, length)) AS t))"""


def _plan(spark, d):
    good = _segments(spark, d).where("not rejected").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).where("g % 2 = 0")
    return clocks.uniform_plan(good, F.col("g"), F.lit(8))


@query(f"WITH {PLAN} SELECT ep, grid_index, position, left_start, right_start, length FROM pz")
def uniform_plan(spark, d):
    return _plan(spark, d).select("ep", "grid_index", "position", "left_start", "right_start", "length")


@query(f"WITH {PLAN} SELECT c.ep, grid_index, t, left_src, right_src, left_active, right_active, a.v AS \"left\", b.v AS \"right\" FROM ck c JOIN s a ON a.ep = c.ep AND a.f = left_src JOIN s b ON b.ep = c.ep AND b.f = right_src")
def retimed_rows(spark, d):
    out = clocks.gather(clocks.clock_of(_plan(spark, d)), user_frames(spark, d))
    return out.select("ep", "grid_index", "t", "left_src", "right_src", "left_active", "right_active", "left", "right")


@query(f"WITH {PLAN} SELECT ep, grid_index, count(*) AS frames, count_if(left_active AND right_active) AS overlap, count_if(NOT left_active AND NOT right_active) AS both_idle, count_if(NOT left_active) AS left_idle FROM ck GROUP BY ep, grid_index")
def idle_overlap_counts(spark, d):
    clock = clocks.clock_of(_plan(spark, d))
    return clock.groupBy("ep", "grid_index").agg(F.count("*").alias("frames"), F.count_if(F.col("left_active") & F.col("right_active")).alias("overlap"), F.count_if(~F.col("left_active") & ~F.col("right_active")).alias("both_idle"), F.count_if(~F.col("left_active")).alias("left_idle"))


@query(f"WITH {PLAN}, x AS (SELECT ep * 8 + grid_index AS ep, t AS f, left_active AND right_active AS flag FROM ck), {ISL} SELECT ep, start, \"end\" FROM r WHERE flag")
def idle_overlap_intervals(spark, d):
    clock = clocks.clock_of(_plan(spark, d)).select((F.col("ep") * 8 + F.col("grid_index")).alias("ep"), F.col("t").alias("f"), "left_active", "right_active")
    return series.islands(clock, F.col("left_active") & F.col("right_active")).where("flag").drop("flag")


@query(f"""WITH {S}, m AS (SELECT ep, f, v, count(*) OVER (PARTITION BY ep) AS n FROM s), k AS (SELECT ep, f, list_sort([v2 FOR v2 IN list(v) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)]) AS l FROM (
  SELECT ep, f, v, n, false AS x FROM m UNION ALL SELECT ep, -1 - f, v, n, true FROM m WHERE f < 2 UNION ALL SELECT ep, 2 * n - 1 - f, v, n, true FROM m WHERE f >= n - 2)) SELECT k.ep, k.f, l[3] AS med FROM k JOIN s USING (ep, f)""")
def median_filter5(spark, d):
    return series.median_filter(user_frames(spark, d).select("ep", "f", "v"), 5).select("ep", "f", "med")


def _gappy(spark, d):
    return user_frames(spark, d).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("v")))


FILL = f"""{S}, g AS (SELECT ep, f, event_id, CASE WHEN event_id % 7 <> 0 THEN v END AS v FROM s),
h AS (SELECT ep, f, v, last_value(v IGNORE NULLS) OVER up AS a, first_value(v IGNORE NULLS) OVER dn AS b, last_value(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER up AS fa, first_value(CASE WHEN v IS NOT NULL THEN f END IGNORE NULLS) OVER dn AS fb FROM g
WINDOW up AS (PARTITION BY ep ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT ep, f, v AS raw, coalesce(v, a + (f - fa)::DOUBLE / (fb - fa) * (b - a), a, b) AS v FROM h)"""


@query(f"WITH {FILL} SELECT ep, f, round(v, 9) AS v FROM fl")
def gap_fill_linear(spark, d):
    return _gappy(spark, d).select("ep", "f", F.round(series.filled(F.col("v")), 9).alias("v"))


@query(f"WITH {S} SELECT ep, f, v - coalesce(lag(v, 8) OVER {W}, first_value(v) OVER {W}) AS d FROM s")
def lagged_difference(spark, d):
    return user_frames(spark, d).select("ep", "f", series.lagged(F.col("v"), 8).alias("d"))


@query(f"""WITH {FILL}, q AS (SELECT ep, quantile_cont(raw, 0.1) AS lo, quantile_cont(raw, 0.9) AS hi, count(raw) AS k, count(*) AS n FROM fl GROUP BY ep),
m AS (SELECT ep, f, v, n FROM fl JOIN q USING (ep)), k AS (SELECT ep, f, list_sort(list(v) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM (
  SELECT ep, f, v FROM m UNION ALL SELECT ep, -1 - f, v FROM m WHERE f < 2 UNION ALL SELECT ep, 2 * n - 1 - f, v FROM m WHERE f >= n - 2)),
sm AS (SELECT k.ep, k.f, raw, l[3] AS med FROM k JOIN fl USING (ep, f)), df AS (SELECT *, med - coalesce(lag(med, 1) OVER {W}, first_value(med) OVER {W}) AS d FROM sm)
SELECT ep, f, CASE WHEN raw IS NULL OR k < 5 OR hi - lo < 1 THEN 'UNKNOWN' WHEN d > (hi - lo) * 0.08 THEN 'OPENING' WHEN d < -(hi - lo) * 0.08 THEN 'CLOSING' WHEN med >= (lo + hi) / 2 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM df JOIN q USING (ep)""")
def aperture_states(spark, d):
    return series.aperture_states(_gappy(spark, d).select("ep", "f", "v"), 10.0).select("ep", "f", "state")


@query(f"WITH {S} SELECT ep, f, count(v) OVER w = 5 AND max(v) OVER w - min(v) OVER w <= 60 AS quiet FROM s WINDOW w AS (PARTITION BY ep ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def quiet_windows(spark, d):
    return user_frames(spark, d).select("ep", "f", series.quiet(F.col("v"), 5, 60.0).alias("quiet"))


def _plateaus(spark, d):
    """A monotone clock with holds: clicks stand still."""
    rows = user_frames(spark, d)
    c = F.sum(F.when(F.col("kind") == "click", 0).otherwise(1)).over(series.rows_between(Window.unboundedPreceding, 0))
    return rows.select("ep", "f", c.cast("double").alias("c"))


PLAT = f"{S}, p AS (SELECT ep, f, (sum(CASE WHEN kind = 'click' THEN 0 ELSE 1 END) OVER {W})::DOUBLE AS c FROM s)"


@query(f"""WITH {PLAT}, z AS (SELECT *, min(c) OVER (PARTITION BY ep) AS a, max(c) OVER (PARTITION BY ep) AS b, count(*) OVER (PARTITION BY ep) AS n, coalesce(lag(c) OVER {W} = c, false) AS fi, coalesce(lead(c) OVER {W} = c, false) AS inn FROM p)
SELECT ep, f, CASE WHEN a = b AND n > 1 THEN true WHEN c = b THEN fi ELSE inn END AS idle FROM z""")
def clock_idle_mask(spark, d):
    return clocks.idle_mask(_plateaus(spark, d)).select("ep", "f", "idle")


@query(f"WITH {S}, t AS (SELECT ep, f, max(v) OVER w - min(v) OVER w AS r FROM s WINDOW w AS (PARTITION BY ep ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), g AS (SELECT ep, count(*) AS n, coalesce(max(CASE WHEN r > 60 THEN f END) + 1, 0) AS start FROM t GROUP BY ep) SELECT ep, start, least(start + 3, n) AS mask_start, n AS \"end\" FROM g")
def terminal_rest(spark, d):
    return series.terminal_rest(user_frames(spark, d), 60.0, FPS)


@query(f"WITH {S}, a AS (SELECT ep, f, lead(v) OVER {W} - v AS d FROM s), b AS (SELECT ep, f, d, sum(d) OVER w AS sm, sum((d > 0)::INT) OVER w AS up, count(d) OVER w AS n FROM a WINDOW w AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT ep, min(CASE WHEN d > 0 AND n = 4 AND sm >= 20 AND up >= 3 THEN f END) AS retreat FROM b GROUP BY ep")
def sustained_retreat(spark, d):
    return series.sustained_retreat(user_frames(spark, d), 4, 20.0)


@query(f"WITH {S} SELECT ep, f, round(coalesce((lead(v) OVER {W} - lag(v) OVER {W}) / 2, lead(v) OVER {W} - v, v - lag(v) OVER {W}), 9) AS speed FROM s")
def gradient_speed(spark, d):
    return user_frames(spark, d).select("ep", "f", F.round(series.gradient(F.col("v")), 9).alias("speed"))


@query(f"WITH {S}, g AS (SELECT ep, f, v, max(v) OVER (PARTITION BY ep) AS top, round(abs(coalesce((lead(v) OVER {W} - lag(v) OVER {W}) / 2, lead(v) OVER {W} - v, v - lag(v) OVER {W})), 9) AS sp FROM s) SELECT ep, arg_min(f, (sp, f)) AS peak, min(sp) AS speed FROM g WHERE v >= top - 40 GROUP BY ep")
def lift_peak(spark, d):
    return series.lift_peak(user_frames(spark, d), 40.0)


@query(f"WITH {S}, a AS (SELECT ep, f, (v - lag(v) OVER {W}) * 2 AS sp FROM s), b AS (SELECT ep, sp, (sp - lag(sp) OVER {W}) * 2 AS ac FROM a) SELECT ep, round(max(abs(sp)), 6) AS max_speed, round(max(abs(ac)), 6) AS max_acceleration FROM b GROUP BY ep")
def derivative_maxima(spark, d):
    return series.derivatives(user_frames(spark, d), FPS).withColumns({c: F.round(c, 6) for c in ("max_speed", "max_acceleration")})


@query(f"WITH {S}, a AS (SELECT ep, f, avg((v > 50)::INT::DOUBLE) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS share FROM s) SELECT ep, min(f) AS first FROM a WHERE share > 0.7 GROUP BY ep")
def pickup_uncertainty(spark, d):
    rows = user_frames(spark, d).withColumn("share", series.forward_share(F.col("v") > 50, 10))
    return rows.where("share > 0.7").groupBy("ep").agg(F.min("f").alias("first"))


# ---- clocks


@query(f"""WITH {V}, t AS (SELECT ep, f AS t, f * 0.75 AS c FROM e) SELECT t.ep, t.t, c, [round(a.embedding[i]::DOUBLE + (c - floor(c)) * (b.embedding[i]::DOUBLE - a.embedding[i]::DOUBLE), 9) FOR i IN range(1, 15)] AS vec
FROM t JOIN e a ON a.ep = t.ep AND a.f = floor(c) JOIN e b ON b.ep = t.ep AND b.f = ceil(c)""")
def interpolated_clock_rows(spark, d):
    rows = label_frames(spark, d)
    clock = rows.select("ep", F.col("f").alias("t"), (F.col("f") * F.lit(0.75)).alias("c"))
    return clocks.interpolate(clock, rows.select("ep", "f", "vec")).select("ep", "t", "c", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))


@query(f"WITH {V}, n AS (SELECT ep, count(*) AS n FROM e GROUP BY ep), x AS (SELECT ep, f, CASE WHEN f % 9 = 0 THEN NULL WHEN f % 8 = 7 THEN 'nan'::DOUBLE WHEN f % 7 = 6 THEN -0.5 ELSE f * 1.25::DOUBLE END AS c FROM e) SELECT x.ep, f AS t, c FROM x JOIN n USING (ep) WHERE c IS NULL OR isnan(c) OR c < 0 OR c > n - 1")
def clock_bounds_audit(spark, d):
    rows, f = label_frames(spark, d), F.col("f")
    c = F.when(f % 9 == 0, None).when(f % 8 == 7, float("nan")).when(f % 7 == 6, -0.5).otherwise(f * 1.25)
    return clocks.bad_positions(rows.select("ep", f.alias("t"), c.alias("c")), rows.groupBy("ep").agg(F.count("*").alias("n"))).select("ep", "t", "c")


@query(f"WITH {PLAN}, k AS (SELECT ep * 8 + grid_index AS ep, t, left_src, right_src FROM ck), w AS (SELECT *, lag(left_src) OVER (PARTITION BY ep ORDER BY t) AS a, lag(right_src) OVER (PARTITION BY ep ORDER BY t) AS b FROM k) SELECT ep, count_if(left_src = a) AS left_waits, count_if(right_src = b) AS right_waits, count(*) AS frames FROM w GROUP BY ep")
def wait_counts(spark, d):
    return clocks.waits(_flat_clock(spark, d))


def _flat_clock(spark, d):
    return clocks.clock_of(_plan(spark, d)).select((F.col("ep") * 8 + F.col("grid_index")).alias("ep"), "t", "left_src", "right_src")


@query(f"WITH {PLAN}, k AS (SELECT ep * 8 + grid_index AS ep, t, left_src, right_src FROM ck), l AS (SELECT ep, max(t) AS t, arg_max(left_src, t) AS a, arg_max(right_src, t) AS b FROM k GROUP BY ep) SELECT ep, t, left_src, right_src, false AS held FROM k UNION ALL SELECT ep, t + i, a, b, true FROM l, range(1, 5) r(i)")
def terminal_hold(spark, d):
    return clocks.hold(_flat_clock(spark, d), FPS, 2.0)


@query(f"WITH {PLAT}, w AS (SELECT ep, f AS t, c - lag(c) OVER {W} AS step FROM (SELECT ep, f, CASE WHEN f % 10 = 9 THEN c + 3 ELSE c END AS c FROM p)) SELECT ep, t, step FROM w WHERE step < 0 OR step > 1")
def map_step_audit(spark, d):
    clock = _plateaus(spark, d).select("ep", F.col("f").alias("t"), F.when(F.col("f") % 10 == 9, F.col("c") + 3).otherwise(F.col("c")).alias("c"))
    return clocks.step_violations(clock, "c").select("ep", "t", "step")


@query("WITH n AS (SELECT DISTINCT user_id AS ep FROM events), r AS (SELECT ep, dense_rank() OVER (ORDER BY ep) - 1 AS rank, count(*) OVER () AS n FROM n) SELECT ep, rank, v AS variant, rank + n * v AS output, (rank + n * v)::DOUBLE / (2 * n) AS u FROM r, range(0, 2) t(v)")
def variant_grid(spark, d):
    return clocks.grid(user_frames(spark, d), 2)


@query(f"WITH {S} SELECT ep, f, v = 50 OR (v < 50 AND f < 10) AS required, f >= 10 AND NOT v >= 30 AS must, f >= 10 AND v >= 30 AND f < 40 AS excess FROM s")
def wait_masks(spark, d):
    must, excess = clocks.right_waits(F.col("v"), F.col("f"), 10, 30, 40)
    left = F.when(F.col("v") < 50, 50.0).otherwise(F.col("v"))
    rows = user_frames(spark, d)
    return rows.select("ep", "f", ((F.col("v") == 50) | clocks.required_wait(left, F.col("f"), 50.0, 10) & (F.col("v") < 50)).alias("required"), must.alias("must"), excess.alias("excess"))


# ---- joins of events and frames

IV = f"iv AS (SELECT ep, event_id AS id, f AS grasp, f + 2 + event_id % 5 AS release FROM s WHERE kind = 'purchase')"


def _intervals(spark, d):
    rows = user_frames(spark, d).where("kind = 'purchase'")
    return rows.select("ep", F.col("event_id").alias("id"), F.col("f").alias("grasp"), (F.col("f") + 2 + F.col("event_id") % 5).alias("release"))


@query(f"WITH {S}, {IV} SELECT iv.ep, id, f, event_id FROM iv JOIN s ON s.ep = iv.ep AND f >= grasp AND f < release")
def interval_frame_join(spark, d):
    spans = _intervals(spark, d).select("ep", "id", F.col("grasp").alias("start"), F.col("release").alias("end"))
    return events.interval_frames(user_frames(spark, d), spans).select("ep", "id", "f", "event_id")


STOPS = "FROM s a LEFT JOIN s b ON a.ep = b.ep AND b.kind = 'purchase'"


@query(f"WITH {S} SELECT a.ep, a.f, max(b.f) AS mark {STOPS} AND b.f <= a.f WHERE a.kind = 'click' GROUP BY 1, 2")
def asof_prev_stop(spark, d):
    rows = user_frames(spark, d)
    return events.asof_before(rows.where("kind = 'click'").select("ep", "f"), rows.where("kind = 'purchase'").select("ep", F.col("f").alias("m")))


@query(f"WITH {S} SELECT a.ep, a.f, min(b.f) AS mark {STOPS} AND b.f > a.f WHERE a.kind = 'click' GROUP BY 1, 2")
def asof_next_stop(spark, d):
    rows = user_frames(spark, d)
    return events.asof_after(rows.where("kind = 'click'").select("ep", "f"), rows.where("kind = 'purchase'").select("ep", F.col("f").alias("m")))


@query(f"WITH {S}, {IV} SELECT x.ep, x.id AS a, y.id AS b FROM iv x JOIN iv y ON x.ep = y.ep AND x.id < y.id AND NOT (x.release < y.grasp OR y.release < x.grasp)")
def overlapping_pairs(spark, d):
    return events.overlapping(_intervals(spark, d)).select("ep", "a", "b")


@query(f"""WITH {V}, tr AS (SELECT ep, f, i AS track, embedding[i]::DOUBLE AS x FROM e, range(1, 7) t(i)), g AS (SELECT a.ep, a.f, a.track AS a, b.track AS b, b.x - a.x AS gap FROM tr a JOIN tr b ON a.ep = b.ep AND a.f = b.f AND a.track < b.track),
m AS (SELECT *, abs(gap - quantile_cont(gap, 0.5) OVER (PARTITION BY ep, a, b)) AS off FROM g) SELECT ep, a, b, count(*) AS frames, round(quantile_cont(off, 0.95), 9) AS p95 FROM m GROUP BY ep, a, b HAVING quantile_cont(off, 0.95) < 2.5""")
def pair_support(spark, d):
    rows = label_frames(spark, d)
    tracks = rows.select("ep", "f", F.posexplode(F.slice("vec", 1, 6)).alias("track", "x")).withColumn("track", (F.col("track") + 1).cast("long"))
    return events.pair_support(tracks, 2.5).withColumn("p95", F.round("p95", 9))


@query(f"""WITH {S}, {IV}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), st AS (SELECT iv.ep, id, f, CASE WHEN f < grasp THEN 'AT_ORIGIN' WHEN f < grasp + 1 THEN 'GRASPING' WHEN f < release THEN 'HELD' WHEN f = release THEN 'RELEASING' ELSE 'PLACED' END AS state FROM iv JOIN s USING (ep))
SELECT ep, id, state, min(f) AS start, max(f) + 1 AS "end" FROM st GROUP BY 1, 2, 3""")
def object_states(spark, d):
    """The state of every object at every frame, as one interval for each state."""
    marks = _intervals(spark, d).withColumn("pickup", F.col("grasp") + 1)
    return events.state_spans(marks, user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n")))


@query(f"WITH {S} SELECT ep, f, (v <= 40 OR f >= 5) AND (f < 20 OR v >= 60) AS admitted FROM s")
def precedence_gate(spark, d):
    return user_frames(spark, d).select("ep", "f", events.precedence_gate(F.col("v"), F.col("f"), 40, 5, 20, 60).alias("admitted"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_replay(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_missing(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_dimension_join(spark, d):
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"WITH {S}, a AS (SELECT ep, f, row_number() OVER (PARTITION BY ep ORDER BY f) AS rank FROM s WHERE v > 30), b AS (SELECT ep, f, row_number() OVER (PARTITION BY ep ORDER BY f) AS rank FROM s WHERE v > 31) SELECT ep, rank, a.f AS a, b.f AS b FROM a FULL JOIN b USING (ep, rank) WHERE a.f IS DISTINCT FROM b.f")
def positional_mismatch(spark, d):
    rows = user_frames(spark, d)
    return events.positional(rows.where("v > 30").select("ep", "f"), rows.where("v > 31").select("ep", "f"), "f", "ep")


@query(f"""WITH {S}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), ev AS (SELECT ep, event_id AS id, f AS grasp, f + 1 AS pickup, f + 2 AS release FROM s WHERE kind = 'purchase'),
x AS (SELECT ep, f, v < 30 AS flag FROM s), {ISL}, o AS (SELECT ev.*, coalesce(lag(release) OVER w + 1, 0) AS fl, coalesce(lead(grasp) OVER w, n - 1) AS ce FROM ev JOIN n USING (ep) WINDOW w AS (PARTITION BY ep ORDER BY pickup))
SELECT o.ep, id, grasp, pickup, release, coalesce(max(CASE WHEN r."end" >= fl AND r."end" < grasp THEN r."end" END), fl) AS approach, coalesce(min(CASE WHEN r.start > release AND r.start <= ce THEN r.start END), ce) AS retract
FROM o LEFT JOIN r ON r.ep = o.ep AND r.flag GROUP BY o.ep, id, grasp, pickup, release, fl, ce""")
def episode_boundaries(spark, d):
    rows = user_frames(spark, d)
    own = rows.where("kind = 'purchase'").select("ep", F.col("event_id").alias("id"), F.col("f").alias("grasp"), (F.col("f") + 1).alias("pickup"), (F.col("f") + 2).alias("release"))
    stops = series.islands(rows, F.col("v") < 30).where("flag").select("ep", "start", "end")
    return events.boundaries(own, stops, rows.groupBy("ep").agg(F.count("*").alias("n")))


# ---- sets, sorts, audits


@query("SELECT event_id, 'both' AS part FROM events WHERE value > 30 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'less' FROM events WHERE value > 30 AND event_id % 2 <> 0")
def set_ops_clocks(spark, d):
    ids = table(spark, d, "events")
    high, even = ids.where("value > 30").select("event_id"), ids.where("event_id % 2 = 0").select("event_id")
    return high.intersect(even).withColumn("part", F.lit("both")).unionByName(high.exceptAll(even).withColumn("part", F.lit("less")))


@query("SELECT event_id, 'a' AS side FROM events WHERE value > 97 AND value <= 98 UNION ALL SELECT event_id, 'b' FROM events WHERE value < 1")
def set_equality_audit(spark, d):
    ids = table(spark, d, "events")
    return events.one_sided(ids.where("value > 97 or value >= 1 and value < 2").select("event_id"), ids.where("value > 98 or value < 2").select("event_id"))


@query(f"WITH {S} SELECT ep, f, event_id FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY v DESC, f) AS r FROM s) WHERE r <= 2")
def top2_per_episode(spark, d):
    place = F.row_number().over(Window.partitionBy("ep").orderBy(F.col("v").desc(), "f"))
    return user_frames(spark, d).withColumn("r", place).where("r <= 2").select("ep", "f", "event_id")


@query(f"WITH {S}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), k AS (SELECT DISTINCT ep, floor(i * (n - 1) / 9.0)::BIGINT AS f FROM n, range(0, 10) t(i)) SELECT s.ep, s.f, event_id FROM s JOIN k USING (ep, f)")
def even_sample_rows(spark, d):
    rows = user_frames(spark, d)
    at = rows.groupBy("ep").agg(F.count("*").alias("n")).select("ep", F.explode(X.even_sample(F.col("n"), 10)).alias("f"))
    return rows.join(at, ["ep", "f"]).select("ep", "f", "event_id")


@query(f"WITH {S}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep) SELECT ep, unnest(list_distinct([0, n // 2, n - 1]))::BIGINT AS f FROM n")
def three_point_sample(spark, d):
    return user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n")).select("ep", F.explode(X.three_points(F.col("n"))).alias("f"))


@query("SELECT event_id, (2 * event_id + 7) // 14 AS half_up, round_even(event_id / 2.0, 0)::BIGINT AS half_even, floor(value + 0.5)::BIGINT AS nearest FROM events")
def roundings(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", X.half_up_div(F.col("event_id"), F.lit(7)).alias("half_up"), X.half_even(F.col("event_id") / 2).alias("half_even"), X.half_up(F.col("value")).alias("nearest"))


@query(f"WITH {S}, g AS (SELECT ep, f, event_id FROM s WHERE event_id % 11 <> 0), x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - 1 AS expected FROM g) SELECT ep, f, event_id, expected FROM x WHERE f <> expected")
def frame_gap_audit(spark, d):
    return audit.frame_gaps(user_frames(spark, d).where("event_id % 11 <> 0").select("ep", "f", "event_id"))


@query("SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return audit.repeated_keys(table(spark, d, "lineitem"), "l_orderkey")


@query(f"WITH {S}, {IV}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), m AS (SELECT ep, id, grasp AS start, release AS \"end\", lag(release) OVER (PARTITION BY ep ORDER BY grasp, release) AS b FROM iv) SELECT ep, id, start, \"end\" FROM m JOIN n USING (ep) WHERE \"end\" > n OR coalesce(b, 0) > start")
def interval_audit(spark, d):
    spans = _intervals(spark, d).select("ep", "id", F.col("grasp").alias("start"), F.col("release").alias("end"))
    return audit.interval_errors(spans, user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n"))).select("ep", "id", "start", "end")


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def text_inventory(spark, d):
    return audit.inventory(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, printf('data/chunk-%03d/file-%03d.parquet', page_id // 100, page_id % 100) AS path, regexp_full_match(regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1), '[a-z0-9-]+') AS slug FROM pages")
def url_parts(spark, d):
    p = table(spark, d, "pages")
    first = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)
    path = X.chunk_path(F.floor(F.col("page_id") / 100).cast("long"), F.col("page_id") % 100)
    return p.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), path.alias("path"), X.is_slug(first).alias("slug"))


@query("SELECT event_type AS kind, count(props) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, max((props->>'k')::BIGINT) AS most FROM events GROUP BY 1")
def json_props_stats(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("props").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query(f"WITH {V} SELECT ep, f, round(list_sum([abs(embedding[i]::DOUBLE - embedding[i + 7]::DOUBLE) FOR i IN range(1, 8)]) / 7, 9) AS error, f % 5 <> 0 AND f % 7 <> 0 AND f % 11 <> 0 AND f % 13 <> 0 AS finite FROM e")
def vector_guards(spark, d):
    rows, f = label_frames(spark, d), F.col("f")
    put = lambda x: F.transform("vec", lambda v, i: F.when(i == 2, x).otherwise(v))
    bad = F.when(f % 5 == 0, F.slice("vec", 1, 13)).when(f % 7 == 0, put(F.lit(float("nan")))).when(f % 11 == 0, put(F.lit(float("inf")))).when(f % 13 == 0, put(F.lit(None).cast("double"))).otherwise(F.col("vec"))
    return rows.select("ep", "f", F.round(X.mean_abs_error(F.slice("vec", 1, 7), F.slice("vec", 8, 7)), 9).alias("error"), X.is_vector(bad, 14).alias("finite"))


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def user_sessions(spark, d):
    return sessions(table(spark, d, "events"), "user_id", "ts", "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_windows(spark, d):
    return tumbling(table(spark, d, "events"), "ts", "1 day", "event_type").select(F.unix_timestamp("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- solvers


@query(f"""WITH RECURSIVE {S}, z AS (SELECT ep, list(v ORDER BY f) AS l, count(*) AS n FROM s GROUP BY ep),
w(ep, f, start, lo, hi) AS (SELECT ep, 0, 0, l[1], l[1] FROM z UNION ALL SELECT w.ep, w.f + 1, CASE WHEN greatest(hi, l[w.f + 2]) - least(lo, l[w.f + 2]) > 70 THEN w.f + 1 ELSE start END, CASE WHEN greatest(hi, l[w.f + 2]) - least(lo, l[w.f + 2]) > 70 THEN l[w.f + 2] ELSE least(lo, l[w.f + 2]) END, CASE WHEN greatest(hi, l[w.f + 2]) - least(lo, l[w.f + 2]) > 70 THEN l[w.f + 2] ELSE greatest(hi, l[w.f + 2]) END FROM w JOIN z USING (ep) WHERE w.f + 1 < n),
g AS (SELECT ep, start, max(f) + 1 AS stop FROM w GROUP BY ep, start) SELECT w.ep, w.f::BIGINT AS f FROM w JOIN g USING (ep, start) WHERE stop - g.start < 5 OR w.f < g.start + 1 OR w.f >= stop - 1""")
def greedy_static_spans(spark, d):
    return solvers.kept_frames(user_frames(spark, d), 70.0, 5, 1)


def _candidates(spark, d):
    rows = user_frames(spark, d).where("kind in ('purchase', 'click')")
    side = F.when(F.col("kind") == "click", "left").otherwise("right")
    return rows.select("ep", (F.col("event_id") % 4).alias("object"), side.alias("side"), F.col("f").alias("grasp"), (F.col("f") + 1).alias("pickup"), (F.col("f") + 3).alias("release"), F.col("v").alias("score"))


@query(f"""WITH RECURSIVE {S}, x AS (SELECT ep, event_id % 4 AS object, CASE WHEN kind = 'click' THEN 'left' ELSE 'right' END AS side, f AS grasp, f + 1 AS pickup, f + 3 AS release, v AS score FROM s WHERE kind IN ('purchase', 'click')),
c AS (SELECT *, row_number() OVER (PARTITION BY ep, object ORDER BY score DESC, pickup, release) AS rn, count(*) OVER (PARTITION BY ep, object) AS n FROM x),
g(ep, object, rn, n, kept) AS (SELECT DISTINCT ep, object, 0::BIGINT, n, []::STRUCT(side VARCHAR, grasp BIGINT, pickup BIGINT, release BIGINT, score DOUBLE)[] FROM c
  UNION ALL SELECT g.ep, g.object, c.rn, g.n, CASE WHEN len(kept) < 6 AND len(list_filter(kept, lambda k: k.side = c.side AND abs(k.pickup - c.pickup) < 8 AND abs(k.release - c.release) < 8)) = 0 THEN list_append(kept, {{'side': c.side, 'grasp': c.grasp, 'pickup': c.pickup, 'release': c.release, 'score': c.score}}) ELSE kept END FROM g JOIN c ON c.ep = g.ep AND c.object = g.object AND c.rn = g.rn + 1),
u AS (SELECT ep, object, unnest(kept) AS k FROM g WHERE rn = n) SELECT ep, object, k.side AS side, k.grasp AS grasp, k.pickup AS pickup, k.release AS release, k.score AS score FROM u""")
def top6_diverse(spark, d):
    return solvers.top_diverse(_candidates(spark, d), FPS * 4)


@query()
def best_event_subset(spark, d):
    return solvers.selected(_candidates(spark, d), FPS * 0.5)


def _cells(spark, d):
    """A grid of four columns for each episode; frames after the last whole row form no cell."""
    rows = user_frames(spark, d).withColumn("n", F.floor(F.count("*").over(series.EP()) / 4).cast("long"))
    i, j = F.floor(F.col("f") / 4).cast("long"), (F.col("f") % 4).cast("long")
    return rows.select("ep", "n", F.lit(4).alias("m"), i.alias("i"), j.alias("j"), (F.col("v") < 1).alias("blocked")).where("n > 0 and i < n")


@query(f"""WITH RECURSIVE {S}, n AS (SELECT ep, count(*) // 4 AS n FROM s GROUP BY ep), c AS (SELECT ep, f // 4 AS i, f % 4 AS j, v < 1 AS bad, n FROM s JOIN n USING (ep) WHERE f // 4 < n), ok AS (SELECT * FROM c WHERE NOT bad),
w(ep, i, j, k) AS (SELECT ep, i, j, 0 FROM ok WHERE i = 0 AND j = 0 UNION SELECT w.ep, ok.i, ok.j, w.k + 1 FROM w JOIN ok ON ok.ep = w.ep AND ok.i - w.i BETWEEN 0 AND 1 AND ok.j - w.j BETWEEN 0 AND 1 AND (ok.i, ok.j) <> (w.i, w.j)),
g AS (SELECT ep, min(k) AS steps FROM w JOIN n USING (ep) WHERE i = n - 1 AND j = 3 GROUP BY ep) SELECT n.ep, g.steps IS NOT NULL AS feasible, g.steps::BIGINT AS steps, CASE WHEN g.steps IS NOT NULL THEN NULL WHEN max(CASE WHEN i = 0 AND j = 0 THEN bad::INT END) = 1 THEN 'start' WHEN max(CASE WHEN i = n.n - 1 AND j = 3 THEN bad::INT END) = 1 THEN 'end' ELSE 'no path' END AS why FROM n JOIN c ON c.ep = n.ep LEFT JOIN g ON g.ep = n.ep GROUP BY n.ep, n.n, g.steps""")
def min_wait_schedule(spark, d):
    return solvers.schedules(_cells(spark, d))


# ---- evidence


@query(f"""WITH {S}, x AS (SELECT ep, event_id AS id, (v * 1.7::DOUBLE) % 180 AS hue, (f + 1)::DOUBLE AS br FROM s WHERE kind = 'purchase') SELECT a.ep, a.id AS a, b.id AS b FROM x a JOIN x b
ON a.ep = b.ep AND a.id < b.id AND least(abs(a.hue - b.hue), 180 - abs(a.hue - b.hue)) < 15 AND greatest(a.br, b.br) / greatest(least(a.br, b.br), 1) < 3""")
def similar_hues(spark, d):
    rows = user_frames(spark, d).where("kind = 'purchase'")
    return evidence.near_hues(rows.select("ep", F.col("event_id").alias("id"), (F.col("v") * 1.7 % 180).alias("hue"), (F.col("f") + 1).cast("double").alias("brightness")))


@query(f"""WITH {V}, p AS (SELECT ep, f, k, embedding[k]::DOUBLE AS x, embedding[k + 7]::DOUBLE AS y FROM e, range(1, 8) t(k)),
j AS (SELECT a.ep, a.f, a.k, b.x, b.y FROM p a JOIN p b ON a.ep = b.ep AND a.f = b.f AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.25),
g AS (SELECT ep, f, k, count(*) AS members, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM j GROUP BY ep, f, k)
SELECT ep, f, 7 AS seen, members, round(x, 9) AS x, round(y, 9) AS y FROM g WHERE members >= 5 QUALIFY row_number() OVER (PARTITION BY ep, f ORDER BY members DESC, k) = 1""")
def point_consensus(spark, d):
    at = F.explode(F.sequence(F.lit(1), F.lit(7)))
    points = label_frames(spark, d).select("ep", "f", "vec", at.alias("point")).select("ep", "f", "point", F.element_at("vec", F.col("point")).alias("x"), F.element_at("vec", F.col("point") + 7).alias("y"))
    return evidence.consensus(points, 0.5).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})


LOOKS = f"{S}, {IV}, lk AS (SELECT iv.ep, id, f, v, event_id FROM iv JOIN s ON s.ep = iv.ep AND f >= grasp AND f < release)"


def _looks(spark, d):
    spans = _intervals(spark, d).select("ep", "id", F.col("grasp").alias("start"), F.col("release").alias("end"))
    return events.interval_frames(user_frames(spark, d), spans)


@query(f"""WITH {LOOKS}, g AS (SELECT ep, id, count(*) AS n, avg(CASE WHEN v / 100 > 0.5 THEN 1.0 ELSE 0 END)::DOUBLE AS r FROM lk GROUP BY ep, id)
SELECT ep, id, n, CASE WHEN n >= 3 THEN round(r, 9) END AS remaining, CASE WHEN n < 3 THEN 'origin_unobservable' WHEN r < 0.4 THEN 'origin_departed' ELSE 'object_still_at_origin' END AS reason FROM g""")
def origin_departures(spark, d):
    looks = _looks(spark, d).select("ep", "id", (F.col("v") / 100).alias("score"))
    return evidence.departures(looks, 0.5).withColumn("remaining", F.round("remaining", 9))


@query(f"""WITH {LOOKS}, x AS (SELECT ep, id, CASE WHEN v > 20 THEN least(v - 20, event_id % 40) / (v - 20) END AS part FROM lk), g AS (SELECT ep, id, count(part) AS observed, coalesce(quantile_cont(part, 0.5), 1.0) AS o FROM x GROUP BY ep, id)
SELECT ep, id, observed, round(o, 9) AS overlap, observed >= 3 AND o < 0.5 AS verified FROM g""")
def detached_origins(spark, d):
    area = F.greatest(F.col("v") - 20, F.lit(0.0))
    return evidence.detached(_looks(spark, d).select("ep", "id", area.alias("area"), F.least(area, F.col("event_id") % 40).alias("both"))).withColumn("overlap", F.round("overlap", 9))


@query(f"""WITH {S}, g AS (SELECT ep, avg((v >= 60)::INT) AS visible, avg((v < 20)::INT) AS occluded, avg((v >= 20 AND v < 30)::INT) AS partial FROM s GROUP BY ep)
SELECT ep, round(visible, 9) AS visible, round(occluded, 9) AS occluded, round(partial, 9) AS partial, round(visible + occluded + partial, 9) AS explained, round(visible + occluded + 0.5 * partial, 9) AS evidence FROM g""")
def visibility_shares(spark, d):
    v = F.col("v")
    out = evidence.visibility(user_frames(spark, d).select("ep", (v >= 60).alias("visible"), (v < 20).alias("supported"), (v < 30).alias("partial")))
    return out.select("ep", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"""WITH {S}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), m AS (SELECT ep, f, v / 100 AS v, n FROM s JOIN n USING (ep)), k AS (SELECT ep, f, list_sort(list(v) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[3] AS med FROM (
  SELECT ep, f, v FROM m UNION ALL SELECT ep, -1 - f, v FROM m WHERE f < 2 UNION ALL SELECT ep, 2 * n - 1 - f, v FROM m WHERE f >= n - 2)),
y AS (SELECT k.ep, k.f, med, kind <> 'error' AS clear FROM k JOIN s USING (ep, f)), fl AS (SELECT ep, f, t.k, CASE t.k WHEN 0 THEN med > 0.6 AND clear WHEN 1 THEN med < 0.5 AND clear ELSE NOT clear END AS flag FROM y, range(0, 3) t(k)),
b AS (SELECT *, row_number() OVER (PARTITION BY ep, k ORDER BY f) - row_number() OVER (PARTITION BY ep, k, flag ORDER BY f) AS g FROM fl), r AS (SELECT ep, k, min(f) AS start, max(f) + 1 AS stop FROM b WHERE flag GROUP BY ep, k, g HAVING count(*) >= 3),
la AS (SELECT ep, max(stop) - 1 AS last FROM r WHERE k = 0 GROUP BY ep), fi AS (SELECT r.ep, last, min(start) AS first FROM r JOIN la USING (ep) WHERE k = 1 AND start > last GROUP BY r.ep, last)
SELECT fi.ep, last, first, max(start) AS contact_start, max(stop) AS contact_end FROM fi LEFT JOIN r ON r.ep = fi.ep AND k = 2 AND start < first AND stop <= first + 2 GROUP BY fi.ep, last, first""")
def origin_departure_intervals(spark, d):
    rows = user_frames(spark, d).select("ep", "f", (F.col("v") / 100).alias("v"), (F.col("kind") != "error").alias("clear"))
    return evidence.departure_interval(rows, 10.0, 0.6, 0.5)


@query(f"""WITH {V}, q AS (SELECT ep, f, CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS x, CASE WHEN vec_id % 7 <> 0 THEN embedding[2]::DOUBLE END AS y FROM e),
h AS (SELECT *, last_value(x IGNORE NULLS) OVER up AS xa, first_value(x IGNORE NULLS) OVER dn AS xb, last_value(y IGNORE NULLS) OVER up AS ya, first_value(y IGNORE NULLS) OVER dn AS yb, last_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER up AS fa, first_value(CASE WHEN x IS NOT NULL THEN f END IGNORE NULLS) OVER dn AS fb FROM q
WINDOW up AS (PARTITION BY ep ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT ep, f, x IS NOT NULL AS seen, coalesce(x, xa + (f - fa)::DOUBLE / (fb - fa) * (xb - xa), xa, xb) AS x, coalesce(y, ya + (f - fa)::DOUBLE / (fb - fa) * (yb - ya), ya, yb) AS y FROM h), z AS (SELECT ep, max(f) AS m FROM fl GROUP BY ep),
sm AS (SELECT a.ep, a.f, any_value(a.seen) AS seen, quantile_cont(b.x, 0.5) AS x, quantile_cont(b.y, 0.5) AS y FROM fl a JOIN z USING (ep), range(-2, 3) t(k), fl b WHERE b.ep = a.ep AND b.f = greatest(least(a.f + k, m), 0) GROUP BY a.ep, a.f),
st AS (SELECT a.ep, a.f, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) < 0.07 AND a.seen AND b.seen AS flag FROM sm a JOIN sm b ON a.ep = b.ep AND b.f = a.f + 1),
g AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS g FROM st), r AS (SELECT ep, min(f) AS a, max(f) + 1 AS b FROM g WHERE flag GROUP BY ep, g HAVING count(*) >= 3)
SELECT ep, min(greatest(a, 5)) AS settled FROM r WHERE least(b, 40) - greatest(a, 5) >= 3 GROUP BY ep""")
def settled_open_frames(spark, d):
    rows = label_frames(spark, d)
    seen = lambda k: F.when(F.col("vec_id") % 7 != 0, F.element_at("vec", k))
    spans = rows.select("ep").distinct().withColumns({"start": F.lit(5).cast("long"), "stop": F.lit(40).cast("long")})
    return evidence.settled(rows.select("ep", "f", seen(1).alias("x"), seen(2).alias("y")), spans, 10.0, 0.07)


@query(f"""WITH {S}, c AS (SELECT ep, f AS c, lead(f) OVER {W} AS stop FROM s WHERE kind <> 'click') SELECT c.ep, c::DOUBLE AS c, stop::DOUBLE AS stop, max(v) - min(v) AS range FROM c JOIN s ON s.ep = c.ep AND f BETWEEN c AND stop
WHERE stop - c > 1 AND stop > 5 AND c < 60 GROUP BY c.ep, c, stop HAVING max(v) - min(v) > 60 + 1e-9""")
def removed_motion_audit(spark, d):
    rows = user_frames(spark, d)
    bounds = rows.select("ep").distinct().withColumns({"opened": F.lit(5), "closing": F.lit(60)})
    return evidence.removed_motion(rows.where("kind <> 'click'").select("ep", F.col("f").cast("double").alias("c")), rows, 60.0, bounds)


@query(f"WITH {PLAT}, n AS (SELECT *, lead(c) OVER {W} AS next FROM p) SELECT ep, f, c, next FROM n WHERE c >= 3 AND next <= 30 AND c < 30 AND abs(next - c - 1) > 1e-8")
def interrupted_execution(spark, d):
    clock = _plateaus(spark, d)
    return evidence.interruptions(clock, clock.select("ep").distinct().withColumns({"start": F.lit(3.0), "end": F.lit(30.0)}))


@query(f"WITH {S}, n AS (SELECT ep, count(*) // 2 AS m FROM s GROUP BY ep) SELECT ep, f, event_id, place FROM (SELECT s.ep, f, event_id, row_number() OVER (PARTITION BY s.ep ORDER BY abs(f - m), f) AS place FROM s JOIN n USING (ep)) WHERE place <= 5")
def nearest_frames(spark, d):
    rows = user_frames(spark, d)
    marks = rows.groupBy("ep").agg(F.floor(F.count("*") / 2).cast("long").alias("m"))
    return evidence.nearest(rows, marks, 5).select("ep", "f", "event_id", "place")


@query(f"""WITH {S}, x AS (SELECT ep, CASE WHEN kind = 'click' THEN 'left' ELSE 'right' END AS side, f AS pickup FROM s WHERE kind IN ('click', 'purchase') AND v > 85), k AS (SELECT ep FROM x GROUP BY ep HAVING count_if(side = 'left') = 2 AND count_if(side = 'right') = 2),
c AS (SELECT *, row_number() OVER (PARTITION BY ep, side ORDER BY pickup) - 1 AS cycle FROM x JOIN k USING (ep)) SELECT ep, side, cycle, pickup, 2 * cycle + CASE WHEN side = 'left' THEN 0 ELSE 1 END AS place FROM c""")
def alternating_pickups(spark, d):
    rows = user_frames(spark, d).where("kind in ('click', 'purchase') and v > 85")
    return evidence.alternating(rows.select("ep", F.when(F.col("kind") == "click", "left").otherwise("right").alias("side"), F.col("f").alias("pickup")))


@query(f"WITH {S}, c AS (SELECT ep, floor(v / 3) AS c FROM s WHERE kind <> 'click'), m AS (SELECT DISTINCT ep, floor(v / 3) AS m FROM s WHERE kind = 'click') SELECT m.ep, m, count_if(c < m) AS \"left\", count_if(c <= m) AS \"right\" FROM m LEFT JOIN c USING (ep) GROUP BY m.ep, m")
def sorted_positions(spark, d):
    at = user_frames(spark, d).select("ep", "kind", F.floor(F.col("v") / 3).alias("x"))
    return evidence.sorted_positions(at.where("kind <> 'click'").select("ep", F.col("x").alias("c")), at.where("kind = 'click'").select("ep", F.col("x").alias("m")))


@query("SELECT user_id AS ep, event_type AS kind, quantile_disc(CASE WHEN event_id % 5 <> 0 THEN value END, 0.5) AS median, round(avg((event_id % 5 <> 0)::INT), 9) AS coverage FROM events GROUP BY 1, 2")
def masked_medians(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("ep"), F.col("event_type").alias("kind"), F.col("value").alias("x"), (F.col("event_id") % 5 == 0).alias("masked"))
    return evidence.masked_median(rows, "ep", "kind").withColumn("coverage", F.round("coverage", 9))


@query("SELECT user_id AS ep, bool_and(value < 150) AS verified, count_if(value >= 150) AS weak, coalesce(string_agg(DISTINCT CASE WHEN value >= 150 THEN event_type END, ',' ORDER BY CASE WHEN value >= 150 THEN event_type END), '') AS reasons FROM events GROUP BY 1")
def gate_verdicts(spark, d):
    return evidence.gate_verdicts(table(spark, d, "events").select(F.col("user_id").alias("ep"), F.col("event_type").alias("name"), (F.col("value") < 150).alias("passed")), "ep")


@query(f"""WITH {V}, p AS (SELECT ep, f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM e WHERE f BETWEEN 2 AND 12), o AS (SELECT p.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, b.z AS bz, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS l
  FROM p JOIN p a ON a.ep = p.ep AND a.f = 2 JOIN p b ON b.ep = p.ep AND b.f = 12),
u AS (SELECT ep, z, (x * (bx - ax) + y * (by_ - ay)) / l AS s, (y * (bx - ax) - x * (by_ - ay)) / l AS t FROM o WHERE l >= 0.03 AND sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_) + (z - bz) * (z - bz)) < l * 1.5)
SELECT ep, round(min(s) - 0.2, 9) AS back, round(max(s), 9) AS front, round(min(t) - 0.12, 9) AS near, round(max(t) + 0.12, 9) AS far, round(min(z) - 0.035, 9) AS low, round(max(z) + 0.035, 9) AS high FROM u GROUP BY ep""")
def swept_boxes(spark, d):
    rows = label_frames(spark, d)
    path = rows.select("ep", "f", *(F.element_at("vec", k + 1).alias(c) for k, c in enumerate("xyz")))
    out = evidence.swept_boxes(path, rows.select("ep").distinct().withColumns({"pull": F.lit(2), "opened": F.lit(12)}))
    return out.select("ep", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"""WITH {PLAT}, x AS (SELECT *, f >= count(*) OVER (PARTITION BY ep) - 3 + ep % 3 OR ep % 5 = 0 AND f % 20 = 7 AS held FROM p), g AS (SELECT ep, count(*) AS n, count_if(held) AS held, min(CASE WHEN held THEN f END) AS start, max(CASE WHEN held THEN c END) - min(CASE WHEN held THEN c END) AS moved FROM x GROUP BY ep) SELECT * FROM g WHERE held <> 3 OR start <> n - held OR moved > 0""")
def hold_audit(spark, d):
    ep, f = F.col("ep"), F.col("f")
    rows = _plateaus(spark, d).withColumn("held", (f >= F.count("*").over(series.EP()) - 3 + ep % 3) | (ep % 5 == 0) & (f % 20 == 7))
    return evidence.hold_errors(rows, FPS, 1.5)


@query("SELECT user_id AS ep, dense_rank() OVER (ORDER BY user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')")
def dense_cohort_rank(spark, d):
    own = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("ep")).distinct()
    return own.withColumn("place", (F.dense_rank().over(Window.orderBy("ep")) - 1).cast("long"))


@query(f"""WITH {S}, g AS (SELECT ep, v - lag(v) OVER {W} AS gap FROM s) SELECT ep, round(min(gap), 9) AS p0, round(quantile_cont(gap, 0.05), 9) AS p5, round(quantile_cont(gap, 0.5), 9) AS p50, round(quantile_cont(gap, 0.95), 9) AS p95, round(max(gap), 9) AS p100 FROM g GROUP BY ep""")
def gap_percentiles(spark, d):
    rows = user_frames(spark, d).withColumn("gap", F.col("v") - F.lag("v").over(series.ORDER()))
    out = rows.groupBy("ep").agg(F.percentile("gap", F.array(*(F.lit(q) for q in (0.0, 0.05, 0.5, 0.95, 1.0)))).alias("q"))
    return out.select("ep", *(F.round(F.col("q")[k], 9).alias(f"p{p}") for k, p in enumerate((0, 5, 50, 95, 100))))


@query(f"WITH {S} SELECT ep, f, (v < 40 OR f > 10) AND (f < 30 OR v > 40) AS ordered, (v <= 50 OR f > 8) AND (f <= 25 OR v > 20) AS admitted FROM s")
def order_gates(spark, d):
    v, f = F.col("v"), F.col("f")
    return user_frames(spark, d).select("ep", "f", events.pickups_in_order(v, f, [("right", 10), ("left", 40), ("right", 30)]).alias("ordered"), events.admitted(v, f, [("left", 50, "right", 8), ("right", 25, "left", 20)]).alias("admitted"))


@query("""WITH p AS (SELECT page_id, strlen(html)::BIGINT AS n, page_id % 3 AS k FROM pages), q AS (SELECT page_id, n, CASE k WHEN 0 THEN page_id WHEN 1 THEN greatest(n - page_id, 0) ELSE page_id END AS a, CASE k WHEN 2 THEN least(page_id + 99, n - 1) ELSE n - 1 END AS b FROM p)
SELECT page_id, CASE WHEN a <= b AND a < n THEN a END AS start, CASE WHEN a <= b AND a < n THEN b END AS "end" FROM q""")
def byte_ranges(spark, d):
    i = F.col("page_id")
    header = F.when(i % 3 == 0, F.format_string("bytes=%d-", i)).when(i % 3 == 1, F.format_string("bytes=-%d", i)).otherwise(F.format_string("bytes=%d-%d", i, i + 99))
    got = table(spark, d, "pages").select("page_id", X.byte_range(header, F.octet_length("html").cast("long")).alias("r"))
    return got.select("page_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


HELD = "w AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"


@query(f"""WITH {S}, n AS (SELECT ep, count(*) - 2 AS stop FROM s GROUP BY ep), a AS (SELECT ep, f, floor(v / 25) * 3 AS v, stop FROM s JOIN n USING (ep) WHERE f <= stop),
b AS (SELECT ep, f, stop, min(v) OVER w AS lo, max(v) OVER w AS hi, count(v) OVER w AS k, max(v) OVER (PARTITION BY ep) AS wide FROM a WINDOW {HELD}),
c AS (SELECT *, CASE WHEN f >= 5 AND f + 3 <= stop AND hi - lo <= 0.5 AND hi < wide - 2 THEN hi END AS level FROM b WHERE k = 3),
e AS (SELECT *, min(level) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM c), k AS (SELECT ep, min(CASE WHEN f + 3 <= stop AND lo > floor + 2 THEN f END) AS broken FROM e GROUP BY ep),
o AS (SELECT e.*, CASE WHEN broken IS NULL OR f < broken THEN level END AS ok FROM e JOIN k USING (ep)), g AS (SELECT ep, min(ok) + 0.5 AS "limit" FROM o GROUP BY ep), h AS (SELECT o.ep, "limit", stop, min(CASE WHEN ok <= "limit" THEN f END) AS grasp FROM o JOIN g USING (ep) WHERE "limit" > 2.5 GROUP BY o.ep, "limit", stop),
l AS (SELECT h.ep, grasp, "limit", coalesce(min(CASE WHEN f >= grasp + 3 AND lo > "limit" THEN f END), h.stop) AS "end" FROM h JOIN o USING (ep) GROUP BY h.ep, grasp, "limit", h.stop) SELECT ep, 1 AS id, grasp, "end", "limit" FROM l WHERE "end" - grasp >= 3""")
def held_grasps(spark, d):
    rows = user_frames(spark, d).select("ep", "f", (F.floor(F.col("v") / 25) * 3).cast("double").alias("v"))
    pickups = rows.groupBy("ep").agg((F.count("*") - 2).alias("stop")).select("ep", F.lit(1).alias("id"), F.lit(0).alias("approach"), F.lit(5).alias("start"), "stop")
    return evidence.held_grasps(rows, pickups, 10.0)


def _rounds() -> str:
    """Three rounds of a fit, each with the medians of its residuals."""
    out = ""
    for k in range(3):
        out += f""", a{k} AS (SELECT user_id, count(x) FILTER (keep) >= 50 AND coalesce(stddev_pop(x) FILTER (keep) >= 5, false) AS good, regr_slope(y, x) FILTER (keep) AS sa, regr_intercept(y, x) FILTER (keep) AS sb FROM r{k} GROUP BY 1),
b{k} AS (SELECT r{k}.user_id, id, x, y, keep, fit AND good AS fit, CASE WHEN fit AND good THEN sa ELSE gain END AS gain, CASE WHEN fit AND good THEN sb ELSE shift END AS shift FROM r{k} JOIN a{k} USING (user_id)), c{k} AS (SELECT *, y - (gain * x + shift) AS res FROM b{k}),
d{k} AS (SELECT user_id, quantile_cont(res, 0.5) FILTER (keep) AS mid FROM c{k} GROUP BY 1), e{k} AS (SELECT c{k}.*, abs(res - mid) AS away FROM c{k} JOIN d{k} USING (user_id)), f{k} AS (SELECT user_id, quantile_cont(away, 0.5) FILTER (keep) AS mad FROM e{k} GROUP BY 1),
r{k + 1} AS (SELECT e{k}.user_id, id, x, y, keep AND (NOT fit OR coalesce(away < greatest(5, 3 * mad), false)) AS keep, gain, shift, fit FROM e{k} JOIN f{k} USING (user_id))"""
    return out


@query(f"""WITH r0 AS (SELECT user_id, event_id AS id, x, y, least(x, y) > 5 AND greatest(x, y) < 250 AS keep, 1.0::DOUBLE AS gain, 0.0::DOUBLE AS shift, true AS fit FROM (SELECT *, value AS x, value * 1.1 + event_id % 7 + CASE WHEN event_id % 13 = 0 THEN 60.0 ELSE 0.0 END AS y FROM events)){_rounds()}
SELECT user_id, round(least(greatest(max(gain), 0.65), 1.5), 7) AS gain, round(least(greatest(max(shift), -50), 50), 7) AS "offset" FROM r3 GROUP BY 1""")
def robust_line_fit(spark, d):
    v, i = F.col("value"), F.col("event_id")
    y = v * 1.1 + i % 7 + F.when(i % 13 == 0, 60.0).otherwise(0.0)
    out = evidence.robust_line(table(spark, d, "events").select("user_id", v.alias("x"), y.alias("y")), "user_id")
    return out.select("user_id", F.round("gain", 7).alias("gain"), F.round("offset", 7).alias("offset"))


@query()
def assigned_pairs(spark, d):
    rows = user_frames(spark, d).select("ep", "event_id", "kind", "v")
    a = rows.where("kind = 'click'").select("ep", F.col("event_id").alias("a"), F.col("v").alias("va"))
    b = rows.where("kind = 'purchase'").select("ep", F.col("event_id").alias("b"), F.col("v").alias("vb"))
    return solvers.assignments(a.join(b, "ep").select("ep", "a", "b", (F.abs(F.col("va") - F.col("vb")) / 10).alias("cost")))


@query(f"""WITH RECURSIVE {S}, h AS (SELECT ep, f, v AS height, coalesce(abs(coalesce((lead(v) OVER {W} - lag(v) OVER {W}) / 2, lead(v) OVER {W} - v, v - lag(v) OVER {W})), 0) AS speed FROM s),
z AS (SELECT ep, list({{'speed': speed, 'f': f, 'height': height}}) AS l FROM h GROUP BY ep),
g(ep, place, f, l) AS (SELECT ep, -1::BIGINT, -1::BIGINT, l FROM z UNION ALL SELECT ep, place + 1, b.f, list_filter(l, lambda x: x.f <> b.f) FROM (SELECT ep, place, l, list_sort(list_filter(l, lambda x: x.height >= list_max(list_transform(l, lambda y: y.height)) - 20))[1] AS b FROM g WHERE len(l) > 0))
SELECT ep, f, place FROM g WHERE place >= 0""")
def ranked_peaks(spark, d):
    rows = user_frames(spark, d)
    return solvers.ranked_peaks(rows.select("ep", "f", F.col("v").alias("height"), F.abs(series.gradient(F.col("v"))).alias("speed")).fillna(0.0, ["speed"]), 20.0)


from . import dataset_queries, plan_queries, review_queries  # noqa: E402, F401
