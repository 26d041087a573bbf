"""Queries for clocks with ramps, stage plans, bounds, visits and returns, with their SQL; bound to the driver's tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import clocks, motion, series
from .queries import FPS, S, V, W, label_frames, query, user_frames

# ---- clocks with ramps

SLOWER = "{n} * ({u} - {u} ** 3 + {u} ** 4 / 2 + 30 * ({d}::DOUBLE / {n} - 0.5) * ({u} ** 3 / 3 - {u} ** 4 / 2 + {u} ** 5 / 5))"
FASTER = "{n} * ({u} ** 3 - {u} ** 4 / 2 + 30 * ({d}::DOUBLE / {n} - 0.5) * ({u} ** 3 / 3 - {u} ** 4 / 2 + {u} ** 5 / 5))"


@query(f"""WITH {S}, p AS (SELECT ep, count(*) // 2 AS peak, count(*) - 1 AS stop FROM s GROUP BY ep), k AS (SELECT ep, peak, stop, unnest(range(0, peak - 8 + 24 + stop - peak - 4 + 1)) AS t FROM p WHERE peak >= 8 AND peak + 4 <= stop), z AS (SELECT *, t - (peak - 8) AS q FROM k)
SELECT ep, t, round(CASE WHEN q < 0 THEN t WHEN q < 15 THEN peak - 8 + {SLOWER.format(n=15, d=8, u='(q / 15.0::DOUBLE)')} WHEN q < 24 THEN peak + {FASTER.format(n=9, d=4, u='((q - 15) / 9.0::DOUBLE)')} ELSE peak + 4 + q - 24 END, 6) AS c FROM z""")
def lift_clock(spark, d):
    n = F.count("*")
    plans = user_frames(spark, d).groupBy("ep").agg(F.lit(0).cast("long").alias("start"), F.floor(n / 2).cast("long").alias("peak"), (n - 1).alias("stop"))
    return clocks.lift_clock(plans, 30.0).withColumn("c", F.round("c", 6))


@query(f"""WITH {S}, n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), g AS (SELECT ep, 0 AS part, 0 AS a, 3 + ep % 7 AS b FROM n UNION ALL SELECT ep, 1, 3 + ep % 7, n // 2 FROM n UNION ALL SELECT ep, 2, n // 2, n // 2 + ep % 2 * (n - 1 - n // 2) FROM n UNION ALL SELECT ep, 3, n // 2 + ep % 2 * (n - 1 - n // 2), n - 1 FROM n),
h AS (SELECT ep, part, a, b - a AS dd, CASE WHEN part = 3 THEN 0 WHEN part = 0 THEN least(15, greatest(2, 2 * (b - a))) ELSE 15 END AS br, CASE WHEN part = 0 THEN 0 ELSE 9 END AS up FROM g WHERE b > a),
i AS (SELECT *, round_even(br / 2.0, 0)::BIGINT AS sl, round_even(up / 2.0, 0)::BIGINT AS fa FROM h), j AS (SELECT *, greatest(dd - sl - fa, 0) AS ev FROM i), l AS (SELECT *, dd::DOUBLE / (sl + fa + ev) AS rate, up + ev + br AS n FROM j),
m AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ep ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0, unnest(range(1, n + 1)) AS k FROM l)
SELECT ep, 0 AS t, 0.0::DOUBLE AS c, false AS held FROM n UNION ALL SELECT ep, t0 + k, round(a + CASE WHEN k = n THEN dd WHEN k <= up THEN rate * {FASTER.format(n='up', d='fa', u='(k::DOUBLE / up)')} WHEN k <= up + ev THEN rate * (fa + k - up)
ELSE rate * (fa + ev + {SLOWER.format(n='br', d='sl', u='((k - up - ev)::DOUBLE / br)')}) END, 6), br > 0 AND k = n FROM m""")
def approach_clocks(spark, d):
    n, ep, zero = F.col("n"), F.col("ep"), F.lit(0).cast("long")
    rows = user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n"))
    half = F.floor(n / 2).cast("long")
    routes = rows.select("ep", zero.alias("start"), F.array(3 + ep % 7, half, half + ep % 2 * (n - 1 - half)).alias("stops"), (n - 1).alias("end"))
    return clocks.approach_clock(routes, 30.0).withColumn("c", F.round("c", 6))


@query(f"""WITH {S}, k AS (SELECT ep, f AS t, ep % 5 + 6 AS p FROM s), o AS (SELECT ep, t, ((t // (2 * p)) * p + least(t % (2 * p), p))::DOUBLE AS l, t::DOUBLE AS r FROM k),
m AS (SELECT *, lead(l) OVER w > l AS ml, lead(r) OVER w > r AS mr, max(t) OVER (PARTITION BY ep) AS e FROM o WINDOW w AS (PARTITION BY ep ORDER BY t)), co AS (SELECT ep, t, e FROM (SELECT *, lag(ml) OVER w AS bl, lag(mr) OVER w AS br FROM m WINDOW w AS (PARTITION BY ep ORDER BY t)) WHERE t > 0 AND t < e AND (ml <> bl OR mr <> br)),
b AS (SELECT ep, t AS x FROM co UNION ALL SELECT DISTINCT ep, 0 FROM o), g AS (SELECT b.ep, row_number() OVER (PARTITION BY b.ep ORDER BY x) - 1 AS part, x AS a, coalesce(lead(x) OVER (PARTITION BY b.ep ORDER BY x), e) AS b, lead(x) OVER (PARTITION BY b.ep ORDER BY x) IS NOT NULL AS braking FROM b JOIN (SELECT ep, max(t) AS e FROM o GROUP BY ep) z ON z.ep = b.ep),
h AS (SELECT ep, part, a, b - a AS dd, CASE WHEN braking THEN 15 ELSE 0 END AS br, CASE WHEN part = 0 THEN 0 ELSE 9 END AS up FROM g WHERE b > a), i AS (SELECT *, round_even(br / 2.0, 0)::BIGINT AS sl, round_even(up / 2.0, 0)::BIGINT AS fa FROM h), j AS (SELECT *, greatest(dd - sl - fa, 0) AS ev FROM i), q AS (SELECT *, dd::DOUBLE / (sl + fa + ev) AS rate, up + ev + br AS n FROM j),
y AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ep ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0, unnest(range(1, n + 1)) AS k FROM q),
c AS (SELECT DISTINCT ep, 0 AS t, 0.0::DOUBLE AS c, false AS held FROM o UNION ALL SELECT ep, t0 + k, a + CASE WHEN k = n THEN dd WHEN k <= up THEN rate * {FASTER.format(n='up', d='fa', u='(k::DOUBLE / up)')} WHEN k <= up + ev THEN rate * (fa + k - up)
ELSE rate * (fa + ev + {SLOWER.format(n='br', d='sl', u='((k - up - ev)::DOUBLE / br)')}) END, br > 0 AND k = n FROM y)
SELECT c.ep, c.t, round(c, 6) AS c, round(u.l + (c - floor(c)) * (v.l - u.l), 6) AS "left", round(u.r + (c - floor(c)) * (v.r - u.r), 6) AS "right", held FROM c JOIN o u ON u.ep = c.ep AND u.t = floor(c) JOIN o v ON v.ep = c.ep AND v.t = ceil(c)""")
def smoothed_waits(spark, d):
    """The left side waits every other stretch of 6 to 10 frames."""
    t, p = F.col("f"), F.col("ep") % 5 + 6
    left = F.floor(t / (2 * p)) * p + F.least(t % (2 * p), p)
    clock = user_frames(spark, d).select("ep", t.alias("t"), left.cast("double").alias("left"), t.cast("double").alias("right"))
    return clocks.smoothed_waits(clock, 30.0).withColumns({c: F.round(c, 6) for c in ("c", "left", "right")})


STAGES = f"{S}, p AS (SELECT ep, 10 AS start, 10 + count(*) // 3 AS peak, 5 + ep % 30 AS opening, ep % 11 / 10.0::DOUBLE AS position FROM s GROUP BY ep)"


@query(f"""WITH {STAGES}, a AS (SELECT *, peak - start AS pl, floor(peak - start - position * (peak - start + opening) + 0.5)::BIGINT AS x FROM p), b AS (SELECT *, greatest(x, 0) + opening > greatest(-x, 0) + pl AS stops FROM a),
c AS (SELECT *, CASE WHEN stops THEN pl + 15 - 8 ELSE pl END AS frames FROM b), e AS (SELECT *, floor(frames - position * (frames + opening) + 0.5)::BIGINT AS y FROM c) SELECT ep, start, peak, opening, position, stops, frames, greatest(-y, 0) AS left_delay, greatest(y, 0) AS right_delay FROM e""")
def lift_profiles(spark, d):
    ep = F.col("ep")
    stages = user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n")).select("ep", F.lit(10).cast("long").alias("start"), (10 + F.floor(F.col("n") / 3)).cast("long").alias("peak"), (5 + ep % 30).alias("opening"), (ep % 11 / 10).alias("position"))
    return clocks.lift_profiles(stages, 30.0)


CLOCK = f"{S}, c AS (SELECT ep, f AS t, (sum(CASE WHEN kind = 'click' THEN 0 ELSE 1 END) OVER {W})::BIGINT AS l, CASE WHEN event_id % 97 = 0 THEN f - 2 ELSE f END AS r FROM s), g AS (SELECT ep, max(l) // 2 AS peak, count(*) // 3 AS opened, count(*) * 2 // 3 AS closing, max(l) * 2 // 3 AS withdrawn FROM c GROUP BY ep)"


def _staged(spark, d):
    rows = user_frames(spark, d)
    c = F.sum(F.when(F.col("kind") == "click", 0).otherwise(1)).over(series.rows_between(Window.unboundedPreceding, 0))
    clock = rows.select("ep", F.col("f").alias("t"), c.alias("left"), F.when(F.col("event_id") % 97 == 0, F.col("f") - 2).otherwise(F.col("f")).alias("right"))
    n, most = F.count("*"), F.max("left")
    at = clock.groupBy("ep").agg(*(F.floor(x).cast("long").alias(k) for k, x in (("peak", most / 2), ("opened", n / 3), ("closing", n * 2 / 3), ("withdrawn", most * 2 / 3))))
    return clock, at


@query(f"""WITH {CLOCK}, w AS (SELECT c.*, lead(l) OVER (PARTITION BY c.ep ORDER BY t) AS nl, lead(r) OVER (PARTITION BY c.ep ORDER BY t) AS nr, peak, opened, closing, withdrawn FROM c JOIN g USING (ep)),
q AS (SELECT ep, bool_or(nl < l OR nr < r) AS back, min(CASE WHEN nl - l > 1e-9 THEN t END) AS ls, min(CASE WHEN nr - r > 1e-9 THEN t END) AS rs, bool_or(nl > peak AND r < opened) AS early, bool_or(nr >= closing AND l < withdrawn) AS shut, min(CASE WHEN l = peak THEN t END) AS arr, min(CASE WHEN r = opened THEN t END) AS op, any_value(opened) AS b FROM w GROUP BY ep),
y AS (SELECT ep, flatten([CASE WHEN coalesce(back, true) THEN ['runs_back'] ELSE [] END, CASE WHEN coalesce(rs - ls <> 0, true) THEN ['onset'] ELSE [] END, CASE WHEN coalesce(early, true) THEN ['inserted_early'] ELSE [] END, CASE WHEN coalesce(shut, true) THEN ['closed_early'] ELSE [] END, CASE WHEN coalesce(arr - ls <> 12 OR op - rs <> b, true) THEN ['duration'] ELSE [] END]) AS why FROM q) SELECT * FROM y WHERE len(why) > 0""")
def stage_audit(spark, d):
    clock, at = _staged(spark, d)
    return clocks.stage_errors(clock, at.withColumns({"ahead": F.lit(0), "a": F.lit(12), "b": F.col("opened")}))


BASIC = "greatest(40 - 1 - {a}, 50 - 1 - {b}, CASE WHEN {a} < 12 AND {b} < 20 THEN greatest(12 - {a}, 20 - {b}) + 40 - 1 - 12 END, CASE WHEN {b} < 35 THEN greatest(greatest(0, 28 - {a}, CASE WHEN {a} < 12 AND {b} < 20 THEN greatest(12 - {a}, 20 - {b}) + 28 - 12 END), 35 - {b}) + 50 - 1 - 35 END)"


@query(f"""WITH {S}, x AS (SELECT ep, f, event_id, (event_id % 40) AS i, (floor(v)::BIGINT % 50) AS j FROM s), a AS (SELECT *, CASE WHEN i >= 10 AND j >= 15 THEN 0 ELSE greatest(10 - i, 15 - j) END AS e1, CASE WHEN i >= 10 AND j >= 15 THEN i ELSE 10 END AS a1, CASE WHEN i >= 10 AND j >= 15 THEN j ELSE 15 END AS b1 FROM x),
b AS (SELECT *, e1 + CASE WHEN a1 >= 25 AND b1 >= 30 THEN 0 ELSE greatest(25 - a1, 30 - b1) END AS e2, CASE WHEN a1 >= 25 AND b1 >= 30 THEN a1 ELSE 25 END AS a2, CASE WHEN a1 >= 25 AND b1 >= 30 THEN b1 ELSE 30 END AS b2 FROM a)
SELECT event_id, greatest({BASIC.format(a='i', b='j')}, e2 + {BASIC.format(a='a2', b='b2')}) AS bound FROM b""")
def remaining_bounds(spark, d):
    rows = user_frames(spark, d)
    i, j = F.col("event_id") % 40, F.floor("v").cast("long") % 50
    markers = F.array(*[F.struct(F.lit(u).cast("long").alias("u"), F.lit(v).cast("long").alias("v")) for u, v in ((10, 15), (25, 30))])
    return rows.select("event_id", clocks.remaining_bound(i, j, 40, 50, 12, 20, 28, 35, markers).cast("long").alias("bound"))


# ---- intervals of one arm, idle masks, proposals


EN = f"d AS (SELECT ep, f - 1 AS i, abs(v - lag(v) OVER {W}) AS x FROM s), en AS (SELECT ep, i, greatest(sum(x) OVER (PARTITION BY ep ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 - 0.08, 0) AS e FROM d WHERE i >= 0)"


@query(f"""WITH {S}, {EN}, c AS (SELECT ep, i, sum(e) OVER (PARTITION BY ep ORDER BY i) AS cum, sum(e) OVER (PARTITION BY ep) AS t, count(*) OVER (PARTITION BY ep) AS n FROM en)
SELECT ep, greatest(min(CASE WHEN round(cum - 0.005 * t, 9) >= 0 THEN i END) - 3, 0) AS start, least(min(CASE WHEN round(cum - 0.995 * t, 9) >= 0 THEN i END) + 5, any_value(n)) AS "end" FROM c WHERE t > 0 GROUP BY ep""")
def one_arm_intervals(spark, d):
    rows = user_frames(spark, d)
    return series.active_interval(series.energy(rows, F.abs(F.col("v") - F.lag("v").over(series.ORDER()))))


@query(f"""WITH {CLOCK}, z AS (SELECT ep, t, l, min(l) OVER p AS a, max(l) OVER p AS b, count(*) OVER p AS n, coalesce(lag(l) OVER o = l, false) AS fi, coalesce(lead(l) OVER o = l, false) AS nx, r FROM c WINDOW p AS (PARTITION BY ep), o AS (PARTITION BY ep ORDER BY t)),
k AS (SELECT z.*, peak, opened, count_if(l < withdrawn) OVER (PARTITION BY z.ep) AS done FROM z JOIN g USING (ep)), m AS (SELECT ep, t AS f, CASE WHEN t >= least(done + 6, n) THEN true WHEN l = peak AND r < opened THEN false WHEN t >= n - 2 THEN true WHEN a = b AND n > 1 THEN true WHEN l = b THEN fi ELSE nx END AS flag FROM k),
i AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM m) SELECT ep, min(f) AS start, max(f) + 1 AS "end" FROM i WHERE flag GROUP BY ep, run""")
def idle_export(spark, d):
    clock, at = _staged(spark, d)
    n = F.count("*").over(Window.partitionBy("ep"))
    rows = clock.withColumn("held", F.col("t") >= n - 2)
    return motion.idle_spans(rows, at.select("ep", "peak", "opened", "withdrawn"), 6)


@query(f"""WITH {S}, q AS (SELECT ep, f, count(v) OVER w = 3 AND max(v) OVER w - min(v) OVER w <= 25 AS flag FROM s WINDOW w AS (PARTITION BY ep ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), i AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM q),
r AS (SELECT ep, min(f) AS a, max(f) + 1 AS b FROM i WHERE flag GROUP BY ep, run HAVING count(*) >= 3), p AS (SELECT ep, count(*) // 3 AS gate, count(*) * 2 // 3 AS closing FROM s GROUP BY ep), x AS (SELECT p.ep, gate, closing, max_by(b, a) AS last FROM p LEFT JOIN r ON r.ep = p.ep AND b > gate AND a < closing GROUP BY 1, 2, 3)
SELECT ep, gate, closing, coalesce(least(closing, greatest(gate, last - 3)), gate) AS boundary FROM x""")
def close_proposals(spark, d):
    rows = user_frames(spark, d)
    n = F.count("*")
    spans = rows.groupBy("ep").agg(F.floor(n / 3).cast("long").alias("gate"), F.floor(n * 2 / 3).cast("long").alias("closing"))
    return motion.close_proposals(series.islands(rows, series.quiet(F.col("v"), 3, 25.0), 3).where("flag"), spans, 3)


# ---- visits and returns


PATH = f"{V}, p AS (SELECT ep, f, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS x, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE embedding[2]::DOUBLE END AS y FROM e)"


def _path(spark, d):
    at = lambda k: F.when(F.col("vec_id") % 9 != 0, F.element_at("vec", k))
    return label_frames(spark, d).select("ep", "f", at(1).alias("x"), at(2).alias("y"))


@query(f"""WITH {PATH}, z AS (SELECT ep, f, x IS NOT NULL AS seen, coalesce(x > -0.13 AND x < 0.13 AND y > -0.13 AND y < 0.13, false) AS near, coalesce(sqrt((lead(x) OVER o - x) ** 2 + (lead(y) OVER o - y) ** 2), 'inf'::DOUBLE) AS sp, count(*) OVER (PARTITION BY ep) AS n FROM p WINDOW o AS (PARTITION BY ep ORDER BY f)),
i AS (SELECT *, near AND f >= 5 AND f < 40 AS flag FROM z), r AS (SELECT ep, min(f) AS a, max(f) + 1 AS b FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM i) WHERE flag GROUP BY ep, run HAVING count(*) >= 3),
v AS (SELECT ep, min(a) AS entry, arg_min(b, a) AS leaves FROM r GROUP BY ep), c AS (SELECT v.ep, entry, leaves, min(z.f) AS clearance FROM v JOIN z ON z.ep = v.ep AND z.f >= leaves AND z.f < 40 AND seen AND NOT near GROUP BY 1, 2, 3),
h AS (SELECT ep, f, list_sort(list(sp) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[3] < 0.17 AS quiet FROM (SELECT ep, f, sp FROM z WHERE f < n - 1 UNION ALL SELECT ep, -1 - f, sp FROM z WHERE f < 2 UNION ALL SELECT ep, 2 * (n - 1) - 1 - f, sp FROM z WHERE f >= n - 3 AND f < n - 1)),
w AS (SELECT h.ep, h.f, quiet AS flag FROM h JOIN c ON c.ep = h.ep AND h.f >= entry AND h.f < leaves - 1), pa AS (SELECT ep, max(f) + 1 AS b FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM w) WHERE flag GROUP BY ep, run HAVING count(*) >= 3)
SELECT c.ep, entry, leaves, clearance, coalesce(max(pa.b), leaves - 1) AS release FROM c LEFT JOIN pa ON pa.ep = c.ep GROUP BY 1, 2, 3, 4""")
def bin_visits(spark, d):
    rows = _path(spark, d)
    visits = rows.select("ep").distinct().select("ep", F.lit(2).alias("pickup"), F.lit(40).alias("stop"), *(F.lit(x).alias(c) for c, x in (("left", -0.13), ("right", 0.13), ("top", -0.13), ("bottom", 0.13))))
    return motion.bin_visits(rows, visits, 10.0, 0.17)


@query(f"""WITH {PATH}, q AS (SELECT ep, f, x * 0.1 + CASE WHEN f < 6 THEN f / 6.0::DOUBLE WHEN f < 14 + ep THEN 1 ELSE greatest(1 - (f - 14 - ep) / (5.0::DOUBLE + ep), 0) END AS x, y * 0.1 AS y, CASE WHEN f % 11 <> 0 THEN (f * 7 % 40)::DOUBLE END AS area, x IS NOT NULL AS seen FROM p), fr AS (SELECT ep, max(CASE WHEN f = 2 THEN x END) AS ox, max(CASE WHEN f = 2 THEN y END) AS oy, quantile_cont(CASE WHEN f >= 6 AND f < 9 THEN x END, 0.5) AS mx, quantile_cont(CASE WHEN f >= 6 AND f < 9 THEN y END, 0.5) AS my FROM q GROUP BY ep),
k AS (SELECT q.*, ((x - ox) * (mx - ox) + (y - oy) * (my - oy)) / ((mx - ox) ** 2 + (my - oy) ** 2) AS pr FROM q JOIN fr USING (ep) WHERE sqrt((mx - ox) ** 2 + (my - oy) ** 2) >= 0.02),
h AS (SELECT *, last_value(pr IGNORE NULLS) OVER up AS a, first_value(pr IGNORE NULLS) OVER dn AS b, last_value(CASE WHEN pr IS NOT NULL THEN f END IGNORE NULLS) OVER up AS fa, first_value(CASE WHEN pr IS NOT NULL THEN f END IGNORE NULLS) OVER dn AS fb, count(*) OVER (PARTITION BY ep) AS n FROM k
WINDOW up AS (PARTITION BY ep ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY ep ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT ep, f, n, coalesce(pr, a + (f - fa)::DOUBLE / (fb - fa) * (b - a), a, b) AS v FROM h), md AS (SELECT ep, f, list_sort(list(v) OVER (PARTITION BY ep ORDER BY f ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))[4] AS med FROM (SELECT ep, f, v FROM fl UNION ALL SELECT ep, -1 - f, v FROM fl WHERE f < 3 UNION ALL SELECT ep, 2 * n - 1 - f, v FROM fl WHERE f >= n - 3)),
sm AS (SELECT k.ep, k.f, seen, area, med, coalesce(coalesce((lead(med) OVER w - lag(med) OVER w) / 2, lead(med) OVER w - med, med - lag(med) OVER w) < -0.002 AND seen, false) AS flag FROM k JOIN md USING (ep, f) WINDOW w AS (PARTITION BY k.ep ORDER BY k.f)),
r AS (SELECT ep, min(f) AS a, max(f) + 1 AS b FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM sm) WHERE flag GROUP BY ep, run HAVING count(*) >= 3),
ar AS (SELECT r.ep, a, b, min(CASE WHEN seen AND med < 0.3 AND area < 5 + 40 * 0.65 THEN f END) AS arrival FROM r JOIN sm ON sm.ep = r.ep AND f >= b AND f < b + 20 GROUP BY 1, 2, 3),
j AS (SELECT ar.ep, a, arrival, max(CASE WHEN f = a THEN med END) AS top, max(CASE WHEN f = b - 1 THEN med END) AS low, max(CASE WHEN f >= b AND f <= arrival THEN med END) AS high FROM ar JOIN sm ON sm.ep = ar.ep AND f >= a AND f < b + 20 GROUP BY 1, 2, 3)
SELECT ep, min(a) AS returns FROM j WHERE a > 6 AND top >= 0.7 AND top - low >= 0.15 AND arrival IS NOT NULL AND high <= top + 0.1 GROUP BY ep""")
def observed_returns(spark, d):
    f, ep = F.col("f"), F.col("ep")
    place = F.when(f < 6, f / 6).when(f < 14 + ep, 1.0).otherwise(F.greatest(1 - (f - 14 - ep) / (5 + ep), F.lit(0.0)))
    rows = _path(spark, d).withColumns({"x": F.col("x") * 0.1 + place, "y": F.col("y") * 0.1}).withColumn("area", F.when(F.col("f") % 11 != 0, (F.col("f") * 7 % 40).cast("double")))
    drawers = rows.select("ep").distinct().select("ep", F.lit(6).alias("opening"), F.lit(2).alias("pull"), F.lit(5.0).alias("baseline"), F.lit(40.0).alias("span"))
    return motion.observed_returns(rows, drawers, 10.0, 0.02)


TRACK = f"""{S}, t0 AS (SELECT *, 14 + ep % 9 AS a, 30 + ep % 7 AS b, count(*) OVER (PARTITION BY ep) AS n FROM s),
tr AS (SELECT ep, f, n, CASE WHEN event_id % 23 <> 0 THEN (greatest(least(f, b), a) - a)::DOUBLE + CASE WHEN v > 95 THEN 0.05 ELSE 0 END END AS x, CASE WHEN event_id % 23 <> 0 THEN 0.0::DOUBLE END AS y,
  (greatest(least(f, b), a) - a + greatest(f - b, 0) * 2)::DOUBLE + (event_id % 3) * 0.1 AS gx, 0.5::DOUBLE AS gy, CASE WHEN f < a OR f >= b THEN 20.0::DOUBLE ELSE 2.0 + event_id % 4 END AS jaw FROM t0)"""


@query(f"""WITH {TRACK}, ed AS (SELECT *, x IS NOT NULL AS seen, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(gx) OVER w AS ngx, lead(gy) OVER w AS ngy, jaw - coalesce(lag(jaw, 8) OVER w, first_value(jaw) OVER w) AS dj FROM tr WINDOW w AS (PARTITION BY ep ORDER BY f)),
e2 AS (SELECT *, coalesce(seen AND nx IS NOT NULL, false) AS edge, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS speed, sqrt((ngx - gx) ** 2 + (ngy - gy) ** 2) AS hand, sqrt(((nx - x) - (ngx - gx)) ** 2 + ((ny - y) - (ngy - gy)) ** 2) AS apart, sqrt((x - gx) ** 2 + (y - gy) ** 2) AS gap, max(jaw) OVER p - min(jaw) OVER p AS jaws FROM ed WINDOW p AS (PARTITION BY ep)),
lv AS (SELECT ep, min(f) AS a, max(f) + 1 AS b FROM (SELECT ep, f, flag, row_number() OVER (PARTITION BY ep ORDER BY f) - row_number() OVER (PARTITION BY ep, flag ORDER BY f) AS run FROM (SELECT ep, f, coalesce(edge AND speed < 0.2 AND hand > 0.3 AND apart > 0.2, false) AS flag FROM e2 WHERE f < n - 1)) WHERE flag GROUP BY ep, run HAVING count(*) >= 3),
cd AS (SELECT ep, event_id AS id, f AS frame, CASE WHEN event_id % 5 = 0 THEN f + 12 END AS verified FROM s WHERE kind = 'purchase' AND f BETWEEN 6 AND 40),
nr AS (SELECT e2.*, id, frame, verified, edge AND f >= greatest(frame - 20, 0) AND f < greatest(greatest(frame - 20, 0), frame - 2) AS pre, edge AND f >= frame AND f < least(n, frame + 21) - 1 AS post FROM cd JOIN e2 ON e2.ep = cd.ep AND f BETWEEN frame - 20 AND frame + 20),
rk AS (SELECT *, CASE WHEN pre THEN sum(pre::INT) OVER (PARTITION BY ep, id ORDER BY f) END AS k FROM nr),
an AS (SELECT ep, id, coalesce(quantile_cont(CASE WHEN k <= 5 THEN x END, 0.5), max(CASE WHEN f = frame THEN x END)) AS ax, coalesce(quantile_cont(CASE WHEN k <= 5 THEN y END, 0.5), max(CASE WHEN f = frame THEN y END)) AS ay, coalesce(max(CASE WHEN k = 1 THEN x END), max(CASE WHEN f = frame THEN x END)) AS ix, coalesce(max(CASE WHEN k = 1 THEN y END), max(CASE WHEN f = frame THEN y END)) AS iy FROM rk GROUP BY ep, id),
mv AS (SELECT rk.*, ix, iy, coalesce(post AND speed > 0.15 AND apart < 1.2 AND sqrt((nx - ax) ** 2 + (ny - ay) ** 2) >= 1, false) AS moving FROM rk JOIN an USING (ep, id)),
pk AS (SELECT ep, id, min(f) + 1 AS pickup FROM (SELECT *, moving AND coalesce(lead(moving, 1) OVER w, false) AND coalesce(lead(moving, 2) OVER w, false) AS starts FROM mv WINDOW w AS (PARTITION BY ep, id ORDER BY f)) WHERE starts GROUP BY ep, id),
rl AS (SELECT pk.ep, pk.id, min(lv.a) AS a FROM pk JOIN an ON an.ep = pk.ep AND an.id = pk.id JOIN lv ON lv.ep = pk.ep AND lv.a > pickup + 3 JOIN tr ON tr.ep = lv.ep AND tr.f = lv.a WHERE sqrt((tr.x - ix) ** 2 + (tr.y - iy) ** 2) > 3 GROUP BY 1, 2),
al AS (SELECT mv.*, pickup, coalesce(CASE WHEN pickup < verified AND verified < n THEN verified END, rl.a + 1) AS release FROM mv LEFT JOIN pk ON pk.ep = mv.ep AND pk.id = mv.id LEFT JOIN rl ON rl.ep = mv.ep AND rl.id = mv.id),
cr AS (SELECT *, edge AND f >= coalesce(pickup, frame) AND f < least(least(n, frame + 21) - 1, coalesce(release, least(n, frame + 21) - 1)) AS carried FROM al),
ag AS (SELECT ep, id, frame, pickup, release, count_if(pre) AS n_pre, count_if(post) AS n_post, min(CASE WHEN f BETWEEN frame - 3 AND frame + 3 THEN gap END) AS near, quantile_cont(CASE WHEN pre THEN speed END, 0.5) AS still,
  (quantile_cont(CASE WHEN f >= frame - 8 AND f < frame THEN jaw END, 0.5) - quantile_cont(CASE WHEN f >= frame AND f < frame + 8 THEN jaw END, 0.5)) / greatest(max(jaws), 1) AS closure, quantile_cont(CASE WHEN carried AND (speed > 0.15 OR hand > 0.15) THEN speed END, 0.5) AS moves,
  avg(CASE WHEN carried AND (speed > 0.15 OR hand > 0.15) THEN exp(-apart / 0.8) END) AS along, avg(CASE WHEN carried THEN (gap < 12)::INT::DOUBLE END) AS held FROM cr GROUP BY 1, 2, 3, 4, 5),
cp AS (SELECT *, coalesce(exp(-near / 8.0), 0) AS proximity, coalesce(exp(-near / 3.5), 0) AS contact, coalesce(exp(-still / 0.2), 0) AS static_before, coalesce(least(greatest(moves / 0.6, 0), 1), 0) AS motion_onset, coalesce(along, 0) AS motion_correlation, coalesce(held, 0) AS attachment FROM ag),
sc AS (SELECT *, 0.15 * proximity + 0.10 * contact + 0.15 * static_before + 0.20 * motion_onset + 0.25 * motion_correlation + 0.10 * attachment + 0.05 * (release IS NOT NULL)::INT AS score FROM cp),
wy AS (SELECT *, flatten([CASE WHEN n_pre < 3 THEN ['insufficient_pre_grasp_visibility'] ELSE [] END, CASE WHEN n_post < 6 THEN ['insufficient_future_visibility'] ELSE [] END, CASE WHEN pickup IS NULL THEN ['no_stable_correlated_pickup'] ELSE [] END, CASE WHEN release IS NULL THEN ['release_not_verified'] ELSE [] END, CASE WHEN attachment < 0.5 THEN ['insufficient_persistent_attachment'] ELSE [] END, CASE WHEN score < 0.65 THEN ['low_posterior_score'] ELSE [] END]) AS why FROM sc)
SELECT ep, id, frame, pickup, release, round(closure, 6) AS closure, round(motion_onset, 6) AS motion_onset, round(motion_correlation, 6) AS motion_correlation, round(attachment, 6) AS attachment, round(score, 6) AS score, why, len(why) = 0 AS accepted FROM wy""")
def scored_hypotheses(spark, d):
    rows = user_frames(spark, d)
    f, e, ep, v = (F.col(c) for c in ("f", "event_id", "ep", "v"))
    a, b = 14 + ep % 9, 30 + ep % 7
    way = F.greatest(F.least(f, b), a) - a
    x = F.when(e % 23 != 0, way.cast("double") + F.when(v > 95, 0.05).otherwise(0.0))
    jaw = F.when((f < a) | (f >= b), 20.0).otherwise((2 + e % 4).cast("double"))
    track = rows.select("ep", "f", x.alias("x"), F.when(e % 23 != 0, 0.0).alias("y"), ((way + F.greatest(f - b, F.lit(0)) * 2).cast("double") + e % 3 * 0.1).alias("gx"), F.lit(0.5).alias("gy"), jaw.alias("jaw"))
    marks = rows.where(f.between(6, 40) & (F.col("kind") == "purchase")).select("ep", e.alias("id"), f.alias("frame"), F.when(e % 5 == 0, f + 12).alias("verified"))
    out = motion.scored_hypotheses(track, marks, 100.0, 20)
    return out.select("ep", "id", "frame", "pickup", "release", *(F.round(c, 6).alias(c) for c in ("closure", "motion_onset", "motion_correlation", "attachment", "score")), "why", "accepted")
