"""Queries for guards, lookups, ledgers and pixel arithmetic, with their SQL; bound to the driver's tables as in ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import functions as X
from .functions import geometry as G
from .operators import audit, review, series
from .plans import profiles, solvers
from .queries import FPS, S, V, W, label_frames, query, user_frames
from .session import table


def _marks(spark, d):
    return user_frames(spark, d).where("kind = 'purchase'")


# ---- functions on pixels and poses


@query("""SELECT event_id, s + 1 - s % 2 AS size FROM (SELECT event_id, greatest(3, round_even(3 * (event_id % 1000 + 1) / 424.0::DOUBLE, 0)::BIGINT) AS s FROM events)""")
def odd_kernel_sizes(spark, d):
    return table(spark, d, "events").select("event_id", G.odd_size(3, F.col("event_id") % 1000 + 1).alias("size"))


@query("""SELECT event_id, greatest(cx - 40, 0) AS "left", greatest(cy - 40, 0) AS top, least(cx + 41, 640) AS "right", least(cy + 41, 362) AS bottom
FROM (SELECT event_id, round_even(value * 6, 0)::BIGINT AS cx, round_even(value * 3.5, 0)::BIGINT AS cy FROM events)""")
def crop_boxes(spark, d):
    v = F.col("value")
    box = G.crop_box(v * 6, v * 3.5, 40, F.lit(640).cast("long"), F.lit(362).cast("long"))
    return table(spark, d, "events").select("event_id", box.alias("b")).select("event_id", "b.*")


@query("SELECT event_id, event_id % 60 AS t, round(value * (256 / 362.0::DOUBLE), 9) AS y, round(value * 2 * (256 / 640.0::DOUBLE), 9) AS x FROM events")
def rescaled_queries(spark, d):
    v = F.col("value")
    q = G.rescaled_query(F.col("event_id") % 60, v, v * 2, F.lit(362.0), F.lit(640.0), 256)
    return table(spark, d, "events").select("event_id", q.alias("q")).select("event_id", "q.t", F.round("q.y", 9).alias("y"), F.round("q.x", 9).alias("x"))


@query("SELECT event_id FROM events WHERE (value % 180 < 12 OR value % 180 > 170) AND event_id % 256 > 120 AND event_id * 7 % 256 > 70")
def red_pixels(spark, d):
    e = table(spark, d, "events")
    return e.where(G.is_red(F.col("value") % 180, F.col("event_id") % 256, F.col("event_id") * 7 % 256)).select("event_id")


@query("SELECT user_id AS ep, CASE WHEN l AND NOT r THEN 0 WHEN r AND NOT l THEN 1 END AS side FROM (SELECT user_id, bool_or(value < 2) AS l, bool_or(value > 90) AS r FROM events GROUP BY 1)")
def entry_sides(spark, d):
    touched = table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(F.bool_or(F.col("value") < 2).alias("l"), F.bool_or(F.col("value") > 90).alias("r"))
    return touched.select("ep", G.entry_side(F.col("l"), F.col("r")).alias("side"))


@query(f"WITH {S}, g AS (SELECT ep, min(CASE WHEN kind = 'error' THEN f END) AS c, max(CASE WHEN v > 90 THEN f END) AS l FROM s GROUP BY ep) SELECT ep, greatest(coalesce(c, l, 0) - 3, 0) AS seed FROM g")
def seed_frames(spark, d):
    marks = user_frames(spark, d).groupBy("ep").agg(F.min(F.when(F.col("kind") == "error", F.col("f"))).alias("c"), F.max(F.when(F.col("v") > 90, F.col("f"))).alias("l"))
    return marks.select("ep", G.seed_frame(F.col("c"), F.col("l"), 30.0).alias("seed"))


@query(f"""WITH {S}, b AS (SELECT ep, f // 8 AS k, sum(CASE WHEN v >= 50 THEN (128 >> (f % 8)::INT) ELSE 0 END)::INT AS byte FROM s GROUP BY 1, 2), n AS (SELECT ep, count(*) AS n FROM s GROUP BY ep)
SELECT ep, list(byte ORDER BY k) AS packed, any_value(n) AS n, true AS same FROM b JOIN n USING (ep) GROUP BY ep""")
def packed_masks(spark, d):
    flags = user_frames(spark, d).groupBy("ep").agg(F.sort_array(F.collect_list(F.struct("f", (F.col("v") >= 50).alias("b")))).alias("r"))
    flags = flags.select("ep", F.transform("r", lambda x: x["b"]).alias("flags"))
    packed = flags.select("ep", "flags", G.packed_bits(F.col("flags")).alias("packed"), F.size("flags").cast("long").alias("n"))
    return packed.select("ep", "packed", "n", (G.unpacked_bits(F.col("packed"), F.col("n")) == F.col("flags")).alias("same"))


@query(f"""WITH {V}, p AS (SELECT *, lag(embedding) OVER {W} AS b FROM e), m AS (SELECT ep, f, list_sum([abs((embedding[i] - b[i])::DOUBLE * 100) FOR i IN range(1, 7)]) * (pi() / 180 * 0.7) + abs((embedding[7] - b[7])::DOUBLE * 100) / 2000 AS bound FROM p WHERE f > 0)
SELECT ep, f, round(bound, 6) AS bound, greatest(ceil(round(bound, 6) / 0.01), 1)::BIGINT AS steps FROM m""")
def swept_edge_steps(spark, d):
    rows = label_frames(spark, d).withColumn("b", F.lag("vec").over(series.ORDER())).where("f > 0")
    diff = F.zip_with(F.slice("vec", 1, 7), F.slice("b", 1, 7), lambda x, y: (x.cast("float") - y.cast("float")).cast("double") * 100)
    rows = rows.withColumn("d", diff)
    bound = F.round(G.motion_bound(F.slice("d", 1, 6), F.element_at("d", 7), 0.7), 6)
    return rows.select("ep", "f", bound.alias("bound"), G.substeps(bound, 0.02).alias("steps"))


BOX = "p.x BETWEEN {0}.x - 0.2 AND {0}.x AND p.y BETWEEN {0}.y - 0.12 AND {0}.y + 0.12 AND p.z BETWEEN {0}.z - 0.035 AND {0}.z + 0.035"


@query(f"""WITH {V}, x AS (SELECT ep, f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM e), h AS (SELECT * FROM x WHERE f = 0)
SELECT p.ep, max(CASE WHEN NOT ({BOX.format('h')}) THEN p.f END) AS wait, count_if({BOX.format('h')}) AS inside FROM x p JOIN h USING (ep) WHERE p.f BETWEEN 3 AND 30 GROUP BY p.ep""")
def last_pose_outside(spark, d):
    rows = label_frames(spark, d)
    p = rows.select("ep", "f", *(F.element_at("vec", k + 1).alias(c) for k, c in enumerate("xyz")))
    box = p.where("f = 0").select("ep", G.body_box(F.col("x"), F.col("y"), F.col("z")).alias("box"))
    inside = G.in_box(F.col("x"), F.col("y"), F.col("z"), F.col("box"))
    held = p.where(F.col("f").between(3, 30)).join(box, "ep")
    return held.groupBy("ep").agg(F.max(F.when(~inside, F.col("f"))).alias("wait"), F.count_if(inside).alias("inside"))


@query("SELECT page_id, regexp_extract(url, '([^/?#]*?)(?:\\.[^./?#]*)?(?:[?#].*)?$', 1) || '_review.mp4' AS name FROM pages")
def review_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(G.file_stem(F.col("url")), F.lit("_review.mp4")).alias("name"))


# ---- guards


@query(f"""WITH {S}, x AS (SELECT ep, f, f AS l, CASE WHEN event_id % 5 = 0 THEN f + 1 ELSE f END AS r, f + 1 AS nl, CASE WHEN event_id % 7 = 0 THEN f + 2 ELSE f + 1 END AS nr FROM s)
SELECT ep, l FROM x WHERE l = r AND nl = nr AND nl = l + 1 AND EXISTS (SELECT 1 FROM s WHERE s.ep = x.ep AND s.f = x.l AND kind = 'error')""")
def replay_edges(spark, d):
    rows, f, e = user_frames(spark, d), F.col("f"), F.col("event_id")
    edges = rows.select("ep", f.alias("l"), F.when(e % 5 == 0, f + 1).otherwise(f).alias("r"), (f + 1).alias("nl"), F.when(e % 7 == 0, f + 2).otherwise(f + 1).alias("nr"))
    return review.replayed_edges(edges, rows.where("kind = 'error'")).select("ep", "l")


@query(f"""WITH {S}, x AS (SELECT ep AS cohort, f AS place, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN -1 ELSE f * 3 + event_id % 5 END AS id FROM s), m AS (SELECT *, lag(id) OVER (PARTITION BY cohort ORDER BY place) AS b FROM x),
w AS (SELECT cohort, place, id, list_concat(CASE WHEN id BETWEEN 0 AND 199 THEN [] ELSE ['out_of_range'] END, CASE WHEN coalesce(b IS NOT NULL AND id <= b, true) THEN ['not_rising'] ELSE [] END) AS why FROM m) SELECT * FROM w WHERE len(why) > 0""")
def cohort_audit(spark, d):
    e, f = F.col("event_id"), F.col("f")
    ids = user_frames(spark, d).select(F.col("ep").alias("cohort"), f.alias("place"), F.when(e % 13 == 0, None).when(e % 11 == 0, -1).otherwise(f * 3 + e % 5).alias("id"))
    return review.cohort_errors(ids, 200)


PARAMS = "SELECT event_id AS id, event_id % 4 AS smoothing, value / 100 AS low, event_id % 10 / 10.0 AS high, event_id % 7 / 10.0 AS share, event_id % 13 / 12.0 AS crossing FROM events"


@query(f"""WITH p AS ({PARAMS}), w AS (SELECT id, list_concat(list_concat(CASE WHEN smoothing < 1 THEN ['smoothing'] ELSE [] END, CASE WHEN NOT (low > 0 AND low < high AND high < 1) THEN ['search'] ELSE [] END),
list_concat(CASE WHEN NOT (share >= 0 AND share < 0.5) THEN ['share'] ELSE [] END, CASE WHEN NOT (crossing >= 0 AND crossing < 1) THEN ['cross'] ELSE [] END)) AS why FROM p) SELECT * FROM w WHERE len(why) > 0""")
def parameter_audit(spark, d):
    e = F.col("event_id")
    sets = table(spark, d, "events").select(e.alias("id"), (e % 4).alias("smoothing"), (F.col("value") / 100).alias("low"), (e % 10 / 10).alias("high"), (e % 7 / 10).alias("share"), (e % 13 / 12).alias("cross"))
    return review.parameter_errors(sets)


@query(f"""WITH {S}, c AS (SELECT ep, event_id AS id, f AS grasp, v AS ox, 50.0::DOUBLE AS oy, 20.0::DOUBLE AS size FROM s WHERE kind = 'purchase'), l AS (SELECT ep, f, v AS x, (event_id % 100)::DOUBLE AS y FROM s WHERE kind <> 'error'),
m AS (SELECT c.ep, id, count(*) AS looks, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM c JOIN l ON l.ep = c.ep AND l.f < grasp AND l.f >= grasp - 12 GROUP BY 1, 2)
SELECT c.ep, c.id, coalesce(looks, 0) AS looks, coalesce(looks >= 3 AND sqrt((mx - ox) ** 2 + (my - oy) ** 2) <= 1.25 * size, false) AS at_origin FROM c LEFT JOIN m ON m.ep = c.ep AND m.id = c.id""")
def origin_sightings(spark, d):
    rows = user_frames(spark, d)
    marks = rows.where("kind = 'purchase'").select("ep", F.col("event_id").alias("id"), F.col("f").alias("grasp"), F.col("v").alias("ox"), F.lit(50.0).alias("oy"), F.lit(20.0).alias("size"))
    looks = rows.where("kind <> 'error'").select("ep", "f", F.col("v").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    return review.seen_at_origin(looks, marks, 12)


@query("SELECT user_id AS ep, list_concat(list_concat(CASE WHEN stage = 'complete' THEN [] ELSE ['stage'] END, CASE WHEN ok THEN [] ELSE ['success'] END), list_concat(CASE WHEN coalesce(passed, false) THEN [] ELSE ['gates'] END, CASE WHEN digest = file THEN [] ELSE ['digest'] END)) AS why FROM (SELECT user_id, CASE WHEN count(*) > 20 THEN 'complete' ELSE 'partial' END AS stage, max(value) < 400 AS ok, bool_and(CASE WHEN event_type = 'error' THEN value < 60 END) AS passed, sum(event_id) % 5 AS digest, count(*) % 5 AS file FROM events GROUP BY 1)")
def input_admission(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "ep")
    runs = e.groupBy("ep").agg(F.when(F.count("*") > 20, "complete").otherwise("partial").alias("stage"), (F.max("value") < 400).alias("success"), (F.sum("event_id") % 5).alias("digest"))
    gates = e.where("event_type = 'error'").select("ep", (F.col("value") < 60).alias("passed"))
    return review.admitted_inputs(runs, gates, e.groupBy("ep").agg((F.count("*") % 5).alias("digest")))


# ---- lookups


@query("""WITH n AS (SELECT DISTINCT user_id AS ep FROM events), r AS (SELECT ep, row_number() OVER (ORDER BY ep) - 1 AS rank, count(*) OVER () AS n FROM n), k AS (SELECT max(n) AS n FROM r)
SELECT g, ep, g % k.n AS rank, g // k.n AS sample FROM k, range(0, (SELECT 2 * n FROM k)) t(g) JOIN r ON r.rank = g % k.n""")
def modular_assignment(spark, d):
    ranks = series.global_offsets(table(spark, d, "events").select(F.col("user_id").alias("ep")).distinct().withColumn("n", F.lit(1).cast("long"))).select("ep", F.col("from").alias("rank"))
    n = ranks.count()
    return review.dealt_sources(spark.range(2 * n).withColumnRenamed("id", "g"), ranks, F.lit(n)).select("g", "ep", "rank", "sample")


@query(f"""WITH {S}, l AS (SELECT ep, count(*) AS n FROM s GROUP BY ep), o AS (SELECT ep, n, sum(n) OVER (ORDER BY ep)::BIGINT - n AS a FROM l), x AS (SELECT o_orderkey AS output, o_custkey % 200 AS ep FROM orders)
SELECT output, x.ep, a AS "from", a + n AS "to", a + output % n AS global_index FROM x JOIN o USING (ep)""")
def episode_slices(spark, d):
    offsets = series.global_offsets(user_frames(spark, d).groupBy("ep").agg(F.count("*").alias("n")))
    outputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("output"), (F.col("o_custkey") % 200).alias("ep"))
    found = outputs.join(offsets, "ep")
    return found.select("output", "ep", "from", "to", (F.col("from") + F.col("output") % F.col("n")).alias("global_index"))


@query(f"WITH {S}, c AS (SELECT ep, event_id AS id, f AS a FROM s WHERE kind = 'purchase') SELECT c.ep, id, a AS \"at\", min(s.f) AS first FROM c LEFT JOIN s ON s.ep = c.ep AND s.f > a AND v < 10 GROUP BY 1, 2, 3")
def first_withdrawals(spark, d):
    events = _marks(spark, d).select("ep", F.col("event_id").alias("id"), F.col("f").alias("at"))
    return review.first_after(events, user_frames(spark, d), F.col("v") < 10)


@query(f"WITH {S} SELECT ep, f AS l FROM s WHERE v > 80 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.ep = s.ep AND b.f // 6 = s.f // 6 AND b.v < 8)")
def unpartnered_poses(spark, d):
    rows = user_frames(spark, d)
    needed = rows.where("v > 80").select("ep", F.col("f").alias("l"), F.floor(F.col("f") / 6).alias("k"))
    clear = rows.where("v < 8").select("ep", F.floor(F.col("f") / 6).alias("k"), F.col("f").alias("r")).join(needed, ["ep", "k"])
    return review.unpartnered(needed.select("ep", "l"), clear.select("ep", "l", "r"))


@query(f"""WITH {V} SELECT ep, f, k AS id, h.side, round(sqrt((embedding[k]::DOUBLE - embedding[h.x]::DOUBLE) ** 2 + (embedding[k + 1]::DOUBLE - embedding[h.x + 1]::DOUBLE) ** 2), 6) AS distance FROM e, range(1, 9) t(k), (VALUES ('left', 10), ('right', 12)) h(side, x)""")
def hand_distances(spark, d):
    rows = label_frames(spark, d)
    at = lambda k: F.element_at("vec", k).cast("double")
    items = rows.select("ep", "f", "vec", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("id")).select("ep", "f", "id", F.element_at("vec", F.col("id").cast("int")).alias("x"), F.element_at("vec", (F.col("id") + 1).cast("int")).alias("y"))
    hands = rows.select("ep", "f", F.inline(F.array(F.struct(F.lit("left").alias("side"), at(10).alias("x"), at(11).alias("y")), F.struct(F.lit("right").alias("side"), at(12).alias("x"), at(13).alias("y")))))
    return review.hand_distances(items, hands).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {S}, b AS (SELECT ep, event_id AS bin, floor(v) AS area, (event_id * 37 % 101)::DOUBLE AS x FROM s WHERE kind = 'error'), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ep ORDER BY area DESC, bin) <= 2),
z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ep ORDER BY x, bin) = 1 THEN 'left' ELSE 'right' END AS side FROM t), c AS (SELECT ep, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM s WHERE kind = 'purchase')
SELECT c.ep, c.id, c.side, z.bin FROM c LEFT JOIN z ON z.ep = c.ep AND z.side = c.side""")
def bin_owners(spark, d):
    rows = user_frames(spark, d)
    bins = rows.where("kind = 'error'").select("ep", F.col("event_id").alias("bin"), F.floor("v").alias("area"), (F.col("event_id") * 37 % 101).cast("double").alias("x"))
    candidates = rows.where("kind = 'purchase'").select("ep", F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"))
    return review.bins_by_side(candidates, bins)


# ---- ledgers


RECEIPTS = """r AS (SELECT o_orderkey AS output, o_custkey AS source, o_orderkey % 40 AS frames, o_custkey % 9 AS digest FROM orders WHERE o_orderkey % 17 <> 0),
p AS (SELECT o_orderkey AS output, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_custkey END AS source, o_orderkey % 40 AS frames FROM orders WHERE o_orderkey % 23 <> 0),
m AS (SELECT o_orderkey AS output, CASE WHEN o_orderkey % 29 = 0 THEN 99 ELSE o_orderkey % 40 END AS frames, CASE WHEN o_orderkey % 31 = 0 THEN 99 ELSE o_custkey % 9 END AS digest FROM orders WHERE o_orderkey % 37 <> 0)"""
LIST = "CASE WHEN coalesce({0}, true) THEN ['{1}'] ELSE [] END"


def _why(**failed: str) -> str:
    return "flatten([" + ", ".join(LIST.format(c, n) for n, c in failed.items()) + "])"


WHY = _why(receipt="r.frames IS NULL", plan="p.frames IS NULL", map="m.frames IS NULL", source="r.source <> p.source", frames="r.frames <> p.frames OR r.frames <> m.frames", digest="r.digest <> m.digest")


@query(f"WITH {RECEIPTS}, w AS (SELECT coalesce(r.output, p.output, m.output) AS output, {WHY} AS why FROM r FULL JOIN p ON p.output = r.output FULL JOIN m ON m.output = coalesce(r.output, p.output)) SELECT * FROM w WHERE len(why) > 0")
def receipt_audit(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders")
    receipts = orders.where(k % 17 != 0).select(k.alias("output"), c.alias("source"), (k % 40).alias("frames"), (c % 9).alias("digest"))
    plans = orders.where(k % 23 != 0).select(k.alias("output"), F.when(k % 19 == 0, 0).otherwise(c).alias("source"), (k % 40).alias("frames"))
    maps = orders.where(k % 37 != 0).select(k.alias("output"), F.when(k % 29 == 0, 99).otherwise(k % 40).alias("frames"), F.when(k % 31 == 0, 99).otherwise(c % 9).alias("digest"))
    return review.receipt_errors(receipts, plans, maps)


@query("""WITH r AS (SELECT c_custkey AS ep, c_custkey % 10 AS digest, c_nationkey AS value FROM customer), n AS (SELECT c_custkey AS ep, (c_custkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS digest, c_nationkey + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS old, 100 + c_nationkey AS new FROM customer WHERE c_custkey % 3 = 0),
l AS (SELECT r.ep, value, new, CASE WHEN n.digest IS NULL THEN 'none' WHEN r.digest = n.digest AND value IS NOT DISTINCT FROM old THEN 'applied' WHEN r.digest <> n.digest THEN 'stale' ELSE 'changed' END AS ledger FROM r LEFT JOIN n USING (ep)) SELECT ep, CASE WHEN ledger = 'applied' THEN new ELSE value END AS value, value AS before, ledger FROM l""")
def reviewed_overrides(spark, d):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    customers = table(spark, d, "customer")
    notes = customers.where(c % 3 == 0).select(c.alias("ep"), ((c + F.when(c % 7 == 0, 1).otherwise(0)) % 10).alias("digest"), (n + F.when(c % 5 == 0, 1).otherwise(0)).alias("old"), (n + 100).alias("new"))
    return review.overridden(customers.select(c.alias("ep"), (c % 10).alias("digest"), n.alias("value")), notes)


@query(f"WITH {S} SELECT ep, event_id, (r - 1) // 4 AS page, (r - 1) % 4 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY v DESC, f) AS r FROM s WHERE kind = 'error')")
def worst_first_pages(spark, d):
    return review.pages_by_worst(user_frames(spark, d).where("kind = 'error'"), "v", 4, "f").select("ep", "event_id", "page", "slot")


@query("SELECT user_id AS batch, count(*) AS runs, count_if(value > 99) AS failed, round(sum(value), 4) AS seconds, CASE WHEN count_if(value > 99) > 0 THEN 1 ELSE 0 END AS exit FROM events GROUP BY 1")
def batch_ledger(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("item"), F.when(F.col("value") > 99, 1).otherwise(0).alias("code"), F.col("value").alias("seconds"))
    return review.batch_ledger(runs).withColumn("seconds", F.round("seconds", 4))


@query("SELECT source, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT source, 'doc-' || doc_id || ' ' || strlen(text) || ' ' || sha256(text) AS line FROM documents WHERE text IS NOT NULL AND doc_id % 10 = 0) GROUP BY source")
def input_fingerprints(spark, d):
    text = F.col("text").cast("binary")
    parts = table(spark, d, "documents").where("text is not null and doc_id % 10 = 0")
    return review.fingerprints(parts.select("source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256")), "source")


@query("WITH s AS (SELECT event_type, min(value) AS \"min\", max(value) AS \"max\", count(*) AS n FROM events GROUP BY 1) SELECT 'stats/' || event_type || '/' || k AS key, CASE k WHEN 'min' THEN \"min\" WHEN 'max' THEN \"max\" ELSE n END::DOUBLE AS value FROM s, (VALUES ('min'), ('max'), ('n')) t(k)")
def flattened_stats(spark, d):
    stats = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    return review.flattened(stats, "event_type", "min", "max", "n")


@query("WITH o AS (SELECT user_id, event_type AS k, max(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT user_id, event_type AS k, min(value) AS v FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.k, n.k) AS key, coalesce(n.v, o.v) AS value FROM o FULL JOIN n ON o.user_id = n.user_id AND o.k = n.k")
def merged_stat_keys(spark, d):
    e = table(spark, d, "events")
    as_map = lambda rows, v: rows.groupBy("user_id", "event_type").agg(v.alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    old, new = as_map(e, F.max("value")), as_map(e.where("event_type in ('click', 'error')"), F.min("value")).withColumnRenamed("m", "new")
    none = F.create_map().cast("map<string,double>")
    both = old.join(new, "user_id", "left").select("user_id", review.merged_keys(F.col("m"), F.coalesce("new", none)).alias("m"))
    return both.select("user_id", F.explode("m").alias("key", "value"))


@query(f"WITH {V} SELECT ep, f, CASE WHEN f % 5 = 0 THEN NULL WHEN f % 7 = 0 THEN NULL ELSE round(embedding[3]::DOUBLE, 6) END AS third, f % 5 = 0 OR f % 7 = 0 AS refused FROM e")
def coerced_vectors(spark, d):
    rows = label_frames(spark, d)
    value = F.when(F.col("f") % 5 == 0, F.slice("vec", 1, 13)).when(F.col("f") % 7 == 0, F.transform("vec", lambda x: F.when(x > 10, x))).otherwise(F.col("vec"))
    made = review.fixed_width(value, 14)
    return rows.select("ep", "f", F.round(F.element_at(made, 3), 6).alias("third"), made.isNull().alias("refused"))


# ---- masks and points


@query(f"""WITH {S}, p AS (SELECT ep, f // 4 AS f, event_id % 64 AS x, floor(v) AS y FROM s WHERE v > 60), fr AS (SELECT DISTINCT ep, f // 4 AS f FROM s)
SELECT fr.ep, fr.f, count(x) AS area, coalesce(round(avg(x), 6), 'nan'::DOUBLE) AS x, coalesce(round(avg(y), 6), 'nan'::DOUBLE) AS y FROM fr LEFT JOIN p USING (ep, f) GROUP BY 1, 2""")
def mask_centres(spark, d):
    rows = user_frames(spark, d).withColumn("f", F.floor(F.col("f") / 4).cast("long"))
    pixels = rows.where("v > 60").select("ep", "f", (F.col("event_id") % 64).alias("x"), F.floor("v").alias("y"))
    return review.mask_centres(pixels, rows.select("ep", "f").distinct()).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(f"""WITH RECURSIVE {S}, r AS (SELECT ep, f, v AS x, event_id % 9 AS area FROM s), a(ep, f, x, ok) AS (SELECT ep, f, x, area <= 6 FROM r WHERE f = 0 UNION ALL SELECT r.ep, r.f, r.x, r.area <= 6 AND NOT (a.ok AND abs(r.x - a.x) > 30) FROM a JOIN r ON r.ep = a.ep AND r.f = a.f + 1) SELECT ep, f, ok AS accepted FROM a""")
def accepted_masks(spark, d):
    rows = user_frames(spark, d).select("ep", "f", F.col("v").alias("x"), F.lit(0.0).alias("y"), (F.col("event_id") % 9).alias("area"))
    return review.accepted_masks(rows, 6, 30.0).select("ep", "f", "accepted")


@query(f"WITH {V} SELECT ep, round(sqrt(avg(dx * dx + dy * dy)), 6) AS rms, round(sqrt(avg(dx) ** 2 + avg(dy) ** 2), 6) AS shift FROM (SELECT ep, embedding[3]::DOUBLE - embedding[1]::DOUBLE AS dx, embedding[4]::DOUBLE - embedding[2]::DOUBLE AS dy FROM e) GROUP BY ep")
def fitted_shifts(spark, d):
    rows = label_frames(spark, d)
    corners = rows.select("ep", *(F.element_at("vec", k + 1).alias(c) for k, c in enumerate(("x", "y", "fx", "fy"))))
    return review.fitted_shift(corners, "ep").withColumns({"rms": F.round("rms", 6), "shift": F.round("shift", 6)})


@query(f"""WITH {S}, sp AS (SELECT ep, event_id AS id, f // 5 AS a, f // 5 + 3 AS b FROM s WHERE kind = 'purchase'), p AS (SELECT ep, f // 5 AS f, f % 5 AS part, v AS area FROM s)
SELECT sp.ep, id, f, part, area FROM sp JOIN p ON p.ep = sp.ep AND f >= a AND f < b QUALIFY row_number() OVER (PARTITION BY sp.ep, id, f ORDER BY area DESC, part) = 1 AND area >= 70""")
def destination_suspects(spark, d):
    rows = user_frames(spark, d)
    k = F.floor(F.col("f") / 5).cast("long")
    spans = rows.where("kind = 'purchase'").select("ep", F.col("event_id").alias("id"), k.alias("start"), (k + 3).alias("end"))
    return review.largest_in_spans(rows.select("ep", k.alias("f"), (F.col("f") % 5).alias("part"), F.col("v").alias("area")), spans, 70.0)


@query("SELECT user_id AS id, round(b / a, 9) AS coverage, round(c / a, 9) AS combined_coverage, c / a >= 0.6 AND c / a >= b / a + 0.15 AND entry = side AND cor <= greatest(4 * a, 2 * held) AS selected FROM (SELECT user_id, count(*)::DOUBLE AS a, count_if(value < 40)::DOUBLE AS b, count_if(value < 75)::DOUBLE AS c, user_id % 2 AS side, count(*) % 2 AS entry, sum(event_id) % 300 AS cor, count_if(value < 50) AS held FROM events GROUP BY 1)")
def reseed_verdicts(spark, d):
    v = F.col("value")
    areas = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count("*").alias("area"), F.count_if(v < 40).alias("before"), F.count_if(v < 75).alias("combined"), (F.sum("event_id") % 300).alias("corroborated"), F.count_if(v < 50).alias("held"), (F.count("*") % 2).alias("entry")
    )
    return review.reseeded(areas.withColumn("side", F.col("id") % 2)).withColumns({c: F.round(c, 9) for c in ("coverage", "combined_coverage")})


@query(f"""WITH {S}, p AS (SELECT ep, kind AS owner, floor(v) AS y, event_id AS x FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY ep, owner ORDER BY y, x) - 1 AS place, count(*) OVER (PARTITION BY ep, owner) AS n FROM p),
k AS (SELECT DISTINCT ep, owner, floor(i * (n - 1) / 4.0)::BIGINT AS place FROM r, range(0, 5) t(i)) SELECT ep, owner, place, y, x FROM r JOIN k USING (ep, owner, place)""")
def object_points(spark, d):
    rows = user_frames(spark, d)
    return review.sampled_points(rows.select("ep", F.col("kind").alias("owner"), F.floor("v").alias("y"), F.col("event_id").alias("x")), 5)


# ---- clocks and sets


CLOCK = f"{S}, c AS (SELECT ep, f AS t, (sum(CASE WHEN kind = 'click' THEN 0 ELSE 1 END) OVER {W})::BIGINT AS l, f AS r FROM s)"


def _clock(spark, d):
    rows = user_frames(spark, d)
    c = F.sum(F.when(F.col("kind") == "click", 0).otherwise(1)).over(series.rows_between(Window.unboundedPreceding, 0))
    return rows.select("ep", F.col("f").alias("t"), c.alias("left"), F.col("f").alias("right"))


@query(f"""WITH {CLOCK}, p AS (SELECT ep, max(l) // 2 AS peak, count(*) // 2 AS opened FROM c GROUP BY ep), u AS (SELECT *, coalesce((l - lag(l) OVER (PARTITION BY ep ORDER BY t) = 1)::INT, 0) AS u FROM c),
w AS (SELECT *, sum(u) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS k FROM u), g AS (SELECT w.ep, count(*) AS n, min(k) AS k, min(r) AS r, any_value(opened) AS o FROM w JOIN p ON p.ep = w.ep AND l = peak GROUP BY w.ep)
SELECT p.ep, coalesce(n = 1 AND k = 6 AND r >= o, false) AS uninterrupted FROM p LEFT JOIN g USING (ep)""")
def lone_lifts(spark, d):
    clock = _clock(spark, d)
    peaks = clock.groupBy("ep").agg(F.floor(F.max("left") / 2).cast("long").alias("peak"), F.floor(F.count("*") / 2).cast("long").alias("opened"))
    return review.lone_peaks(clock, peaks)


@query(f"""WITH {S}, sp AS (SELECT ep, f AS a, f + 4 AS b FROM s WHERE kind = 'view'), m AS (SELECT ep, f, EXISTS (SELECT 1 FROM sp WHERE sp.ep = s.ep AND s.f >= a AND s.f < b) AS idle, count(*) OVER (PARTITION BY ep) AS n FROM s),
g AS (SELECT ep, count_if(NOT idle AND f >= n // 2) AS supervised, count_if(NOT idle AND f >= n - 2) AS unmasked FROM m GROUP BY ep) SELECT * FROM g WHERE supervised > 6 OR unmasked > 0""")
def tail_audit(spark, d):
    rows = user_frames(spark, d)
    spans = rows.where("kind = 'view'").select("ep", F.col("f").alias("start"), (F.col("f") + 4).alias("end"))
    n = F.count("*")
    rests = rows.groupBy("ep").agg(F.floor(n / 2).cast("long").alias("start"), (n - 2).alias("mask_start"))
    return review.tail_errors(rows, spans, rests, 6)


@query("""WITH n AS (SELECT DISTINCT user_id AS ep FROM events), r AS (SELECT ep, row_number() OVER (ORDER BY ep) - 1 AS rank, count(*) OVER () AS n FROM n), x AS (SELECT rank, v AS variant, (rank + n * v)::DOUBLE / (2 * n) + CASE WHEN ep % 5 = 0 THEN 0.01 ELSE 0 END * v AS position, ep % 4 + CASE WHEN ep % 7 = 0 THEN v ELSE 0 END AS frames FROM r, range(0, 2) t(v)),
m AS (SELECT *, lead(position) OVER w - position AS step, lead(frames) OVER w - frames AS longer FROM x WINDOW w AS (PARTITION BY rank ORDER BY variant)) SELECT rank, variant, round(step, 6) AS step, longer FROM m WHERE abs(step - 0.5) > 1e-8 OR longer <> 0""")
def pair_spacing(spark, d):
    from .operators import clocks

    ep, v = F.col("ep"), F.col("variant")
    grid = clocks.grid(user_frames(spark, d), 2)
    samples = grid.select("rank", "variant", (F.col("u") + F.when(ep % 5 == 0, 0.01).otherwise(0.0) * v).alias("position"), (ep % 4 + F.when(ep % 7 == 0, v).otherwise(0)).alias("frames"))
    return review.spacing_errors(samples).withColumn("step", F.round("step", 6))


@query(f"WITH {S}, a AS (SELECT DISTINCT ep, f FROM s WHERE v > 70), p AS (SELECT ep, f FROM s WHERE kind = 'error'), k AS (SELECT DISTINCT p.ep, p.f + t.o AS f FROM p, range(-1, 3) t(o) WHERE p.f + t.o >= 0) SELECT ep, f FROM a UNION SELECT ep, f FROM k")
def restored_clock(spark, d):
    rows = user_frames(spark, d)
    near = rows.where("kind = 'error'").select("ep", F.explode(F.sequence(F.col("f") - 1, F.col("f") + 2)).alias("f")).where("f >= 0")
    return rows.where("v > 70").select("ep", "f").union(near).distinct()


@query("SELECT g, times, known FROM (SELECT coalesce(w.g, p.g) AS g, coalesce(times, 0) AS times, w.g IS NOT NULL AS known FROM (SELECT range AS g FROM range(0, 216)) w FULL JOIN (SELECT g, count(*) AS times FROM (SELECT o_orderkey AS g FROM orders WHERE o_orderkey < 220 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey < 216 AND o_orderkey % 2 = 1 UNION ALL SELECT 7 UNION ALL SELECT 7) GROUP BY g) p ON p.g = w.g) WHERE times <> 1 OR NOT known")
def grid_cover_audit(spark, d):
    k = F.col("o_orderkey").cast("long")
    orders = table(spark, d, "orders").select(k.alias("g"))
    odd = orders.where("g < 216 and g % 2 = 1").unionAll(spark.createDataFrame([(7,), (7,)], "g long"))
    return review.covers(spark.range(216).toDF("g"), orders.where("g < 220 and g % 2 = 0"), odd)


@query(f"WITH {S} SELECT ep, f, kind, v FROM s WHERE f % 3 = 0 AND ep % 2 = 0 UNION ALL SELECT ep, f, 'copy', v FROM s WHERE f % 3 = 0 AND ep % 2 = 1")
def third_frames(spark, d):
    """Every third frame of two sets of episodes, one set after the other."""
    rows = user_frames(spark, d).where("f % 3 = 0")
    return rows.where("ep % 2 = 0").select("ep", "f", "kind", "v").unionByName(rows.where("ep % 2 = 1").select("ep", "f", F.lit("copy").alias("kind"), "v"))


@query(f"WITH {S}, a AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY v DESC, f) AS r, count(*) OVER (PARTITION BY ep) AS n FROM s WHERE v > 40) SELECT ep, max(CASE WHEN r = 1 THEN event_id END) AS first, max(CASE WHEN r = n // 2 + 1 THEN event_id END) AS middle, list(event_id ORDER BY r)[:3] AS best FROM a GROUP BY ep")
def candidate_picks(spark, d):
    """The best, the middle and the three best accepted candidates of each episode, by score, then frame."""
    best = user_frames(spark, d).where("v > 40").groupBy("ep").agg(F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("s"), "f", "event_id"))).alias("r"))
    ids = F.transform("r", lambda x: x["event_id"])
    return best.select("ep", F.element_at(ids, 1).alias("first"), F.element_at(ids, F.floor(F.size("r") / 2).cast("int") + 1).alias("middle"), F.slice(ids, 1, 3).alias("best"))


@query(f"WITH {S} SELECT ep, f AS t, f * 0.75 AS c, f * 0.75 <> floor(f * 0.75) AS interpolated FROM s")
def interpolated_flags(spark, d):
    c = F.col("f") * F.lit(0.75)
    return user_frames(spark, d).select("ep", F.col("f").alias("t"), c.alias("c"), (c != F.floor(c)).alias("interpolated"))


@query("SELECT event_id, round_even(value * 30, 0)::BIGINT AS frame, (props->>'k')::BIGINT <> event_id % 100 AS differs, to_json({'k': (props->>'k')::BIGINT, 'v': event_id}) AS compact FROM events")
def decoded_props(spark, d):
    """Time in seconds to the nearest frame; JSON decoded, compared with what is computed anew, and encoded compactly."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", X.half_even(F.col("value") * 30).alias("frame"), (k != F.col("event_id") % 100).alias("differs"), F.to_json(F.struct(k.alias("k"), F.col("event_id").alias("v"))).alias("compact"))


# ---- profiles, frontiers, manifests, gates


@query("SELECT * FROM (VALUES ('drawer', 'observation.images.top', 1::BIGINT, 'saturated', NULL, ['open_before_insert', 'withdraw_before_close']), ('letters', 'observation.images.top', 4, 'saturated', 'left', []::VARCHAR[]), ('workpiece', 'observation.images.right_environment_1', 4, 'dark', 'alternating_pickups', []::VARCHAR[]), ('workpiece', 'observation.images.right_environment_1', 2, 'dark', 'left', []::VARCHAR[])) t(name, camera, expected_objects, object_kind, priority, dependencies)")
def task_profiles(spark, d):
    """The known tasks, and one with two fields changed."""
    return profiles.table(spark, *profiles.PROFILES, profiles.profile("workpiece", expected_objects=2, priority="left"))


@query(f"""WITH RECURSIVE {S}, n AS (SELECT ep, count(*) // 4 AS n FROM s GROUP BY ep), c AS (SELECT ep, f // 4 AS i, f % 4 AS j, v < 6 AS bad FROM s JOIN n USING (ep) WHERE f // 4 < n), ok AS (SELECT * FROM c WHERE NOT bad),
w(ep, i, j) AS (SELECT ep, i, j FROM ok WHERE i = 0 AND j = 0 UNION SELECT w.ep, ok.i, ok.j FROM w JOIN ok ON ok.ep = w.ep AND ok.i - w.i BETWEEN 0 AND 1 AND ok.j - w.j BETWEEN 0 AND 1 AND (ok.i, ok.j) <> (w.i, w.j)),
x AS (SELECT w.*, n, row_number() OVER (PARTITION BY w.ep ORDER BY w.i + w.j DESC, w.i DESC) - 1 AS place FROM w JOIN n USING (ep) WHERE NOT EXISTS (SELECT 1 FROM w z WHERE z.ep = w.ep AND z.i = n.n - 1 AND z.j = 3))
SELECT ep, place, i, j, CASE WHEN i + 1 >= n OR j + 1 >= 4 THEN 'outside' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.ep = x.ep AND ok.i = x.i + 1 AND ok.j = x.j + 1) THEN 'free' ELSE 'blocked' END AS "both",
CASE WHEN i + 1 >= n THEN 'outside' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.ep = x.ep AND ok.i = x.i + 1 AND ok.j = x.j) THEN 'free' ELSE 'blocked' END AS "left", CASE WHEN j + 1 >= 4 THEN 'outside' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.ep = x.ep AND ok.i = x.i AND ok.j = x.j + 1) THEN 'free' ELSE 'blocked' END AS "right" FROM x WHERE place < 4""")
def schedule_frontiers(spark, d):
    from .queries import _cells

    rows = user_frames(spark, d).select("ep", "f", "v")
    cells = _cells(spark, d).drop("blocked").join(rows.select("ep", F.floor(F.col("f") / 4).cast("long").alias("i"), (F.col("f") % 4).cast("long").alias("j"), (F.col("v") < 6).alias("blocked")), ["ep", "i", "j"])
    return solvers.frontiers(cells)


@query(f"""WITH {S}, l AS (SELECT ep, f, event_id AS id, v AS x, (event_id % 60)::DOUBLE AS y, 10.0::DOUBLE AS size FROM s WHERE kind <> 'error'), h AS (SELECT ep, f, v + event_id % 30 AS x, (event_id % 50)::DOUBLE AS y FROM s UNION ALL SELECT ep, f, v - event_id % 40, (event_id % 70)::DOUBLE FROM s)
SELECT ep, f, id, x FROM l WHERE f % 3 = 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.ep = l.ep AND h.f = l.f AND sqrt((l.x - h.x) ** 2 + (l.y - h.y) ** 2) < 15)""")
def template_observations(spark, d):
    rows, e, v = user_frames(spark, d), F.col("event_id"), F.col("v")
    looks = rows.where("kind <> 'error'").select("ep", "f", e.alias("id"), v.alias("x"), (e % 60).cast("double").alias("y"), F.lit(10.0).alias("size"))
    hands = rows.select("ep", "f", F.lit("left").alias("side"), (v + e % 30).alias("x"), (e % 50).cast("double").alias("y")).unionByName(rows.select("ep", "f", F.lit("right").alias("side"), (v - e % 40).alias("x"), (e % 70).cast("double").alias("y")))
    return review.template_looks(looks, hands).select("ep", "f", "id", "x")


@query(f"""WITH {S}, b AS (SELECT ep, v AS x0, (event_id % 40)::DOUBLE AS y0, v + event_id % 25 AS x1, event_id % 40 + v AS y1 FROM s), a AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM b), q AS (SELECT ep, quantile_cont(area, 0.9) AS q FROM a GROUP BY ep)
SELECT ep, min(x0) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, count(*) AS boxes FROM a JOIN q USING (ep) WHERE area >= 0.6 * q GROUP BY ep""")
def cabinet_regions(spark, d):
    rows, e, v = user_frames(spark, d), F.col("event_id"), F.col("v")
    boxes = rows.select("ep", v.alias("x0"), (e % 40).cast("double").alias("y0"), (v + e % 25).alias("x1"), (e % 40 + v).alias("y1"))
    return review.joint_regions(boxes).withColumns({"x1": F.round("x1", 6), "y1": F.round("y1", 6)})


def _manifest(spark, d):
    text, k = F.col("text").cast("binary"), F.col("doc_id")
    files = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("file-"), k.cast("string")).alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), k)
    manifest = files.where(k % 11 != 0).select("path", F.when(k % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), F.when(k % 17 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return files.where(k % 19 != 0).drop("doc_id"), manifest


MANIFEST = "SELECT 'file-' || doc_id AS path, CASE WHEN doc_id % 19 = 0 THEN 'gone' WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'size' ELSE 'content' END AS why FROM documents WHERE text IS NOT NULL AND (doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) AND NOT (doc_id % 19 = 0 AND doc_id % 11 = 0)"


@query(MANIFEST)
def manifest_audit(spark, d):
    return review.manifest_errors(*_manifest(spark, d))


@query(f"WITH {S} SELECT 'files' AS gate, count(*) AS violations, count(*) = 0 AS passed FROM ({MANIFEST}) UNION ALL SELECT 'keys', 0, true UNION ALL SELECT 'frames', 0, true UNION ALL SELECT 'totals', CASE WHEN count(*) = 10000 THEN 0 ELSE 1 END, count(*) = 10000 FROM s")
def final_gates(spark, d):
    """What must hold before a dataset is final: files as in their manifest, keys unique, frames without gaps, the expected total."""
    rows = user_frames(spark, d).select("ep", "f", "event_id")
    return review.final_gates(files=review.manifest_errors(*_manifest(spark, d)), keys=audit.repeated_keys(rows, "ep", "f"), frames=audit.frame_gaps(rows), totals=audit.total_errors(rows, 10000))
