"""Queries that write whole datasets to the shared folder, trim or retime them and read the result back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import datasets, sources
from .operators import series
from .queries import FPS, S, W, query, user_frames
from .session import scratch

FEATURES = {"action": {"dtype": "float64", "shape": [14]}, "extra": {"dtype": "int64", "shape": [1]}, "top": {"dtype": "video", "shape": [24, 32, 3]}}


def _source(spark, d) -> str:
    """A dataset of every user's events: the left arm's first joint follows the value in the first half, the right arm's in the second."""
    rows = user_frames(spark, d)
    n = F.count("*").over(series.EP())
    v, zero = F.col("v"), F.lit(0.0)
    sides = F.when(F.col("f") * 2 < n, F.array(v, zero)).otherwise(F.array(zero, v))
    rest = F.array_repeat(zero, 6)
    rows = rows.withColumn("_s", sides).withColumn("action", F.concat(F.array(F.col("_s")[0]), rest, F.array(F.col("_s")[1]), rest))
    offsets = series.global_offsets(rows.groupBy("ep").agg(F.count("*").alias("n")))
    rows = rows.join(offsets.select("ep", "from"), "ep")
    made = rows.select(F.col("ep").alias("episode_index"), F.col("f").alias("frame_index"), (F.col("from") + F.col("f")).alias("index"), (F.col("f") / FPS).cast("float").alias("timestamp"), F.lit(0).cast("long").alias("task_index"), "action", F.col("event_id").alias("extra"))
    episodes = offsets.select(F.col("ep").alias("episode_index"), F.array(F.lit("sort")).alias("tasks"))
    tasks = spark.createDataFrame([(0, "sort")], "task_index long, task string")
    folder = scratch(spark, "dataset")
    datasets.write_dataset(spark, folder, made, episodes, tasks, FPS, FEATURES)
    return folder


HALVES = f"{S}, b AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n FROM s), lr AS (SELECT *, CASE WHEN f * 2 < n THEN v ELSE 0 END AS l, CASE WHEN f * 2 >= n THEN v ELSE 0 END AS r FROM b)"


@query(f"""WITH {HALVES}, m AS (SELECT *, greatest(abs(l - lag(l) OVER {W}), abs(r - lag(r) OVER {W})) * {FPS} >= 80 AS moves FROM lr), st AS (SELECT *, NOT coalesce(moves, false) AND NOT coalesce(lead(moves) OVER {W}, false) AS still FROM m),
g AS (SELECT ep, count(*) AS n, min(CASE WHEN NOT still THEN f END) AS a, max(CASE WHEN NOT still THEN f END) AS b FROM st GROUP BY ep), ed AS (SELECT ep, CASE WHEN a IS NULL THEN greatest(n - 2, 0) ELSE a END AS start, CASE WHEN a IS NULL THEN n ELSE least(b + 3, n) END AS stop FROM g),
k AS (SELECT ep, start, stop, row_number() OVER (ORDER BY ep) - 1 AS e, coalesce(sum(stop - start) OVER (ORDER BY ep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM ed)
SELECT e AS episode_index, f - start AS frame_index, o + f - start AS "index", round((f - start) / {FPS}, 4) AS timestamp, l AS "left", r AS "right", event_id AS extra, ep AS source, stop - start AS length, true AS same FROM st JOIN k USING (ep) WHERE f >= start AND f < stop""")
def trimmed_dataset(spark, d):
    """Written, trimmed, read back and compared with its source."""
    source, output = _source(spark, d), scratch(spark, "trimmed")
    datasets.trim_dataset(spark, source, output, 80.0, 80.0, 1.0)
    wrong = datasets.trim_errors(spark, source, output).select("episode_index", "frame_index", F.lit(False).alias("same"))
    about = sources.episodes(spark, output).select("episode_index", F.col("`trim/source_episode`").alias("source"), "length")
    rows = sources.frames(spark, output).join(about, "episode_index").join(wrong, ["episode_index", "frame_index"], "left")
    return rows.select("episode_index", "frame_index", "index", F.round(F.col("timestamp").cast("double"), 4).alias("timestamp"), F.col("action")[0].alias("left"), F.col("action")[7].alias("right"), "extra", "source", "length", F.coalesce("same", F.lit(True)).alias("same"))


def _plan_sql() -> str:
    from .queries import SEG

    return f"""{SEG}, pl AS (SELECT ep, ls, le, rs, re, le - ls AS L, re - rs AS R, g AS grid_index, (2 * g * (le - ls + re - rs) + 4) // 8 AS position, (dense_rank() OVER (ORDER BY ep) - 1) * 4 + g AS output FROM seg, range(0, 4) t(g) WHERE NOT rejected),
pn AS (SELECT *, greatest(position - L, 0) AS left_start, greatest(L - position, 0) AS right_start FROM pl), pz AS (SELECT *, greatest(left_start + L, right_start + R) AS length FROM pn), pf AS (SELECT *, sum(length) OVER (ORDER BY output)::BIGINT - length AS a FROM pz),
ck AS (SELECT ep, output, a, t, least(greatest(t - left_start, 0), L - 1) + ls AS ls_, least(greatest(t - right_start, 0), R - 1) + rs AS rs_, t >= left_start AND t < left_start + L AS la, t >= right_start AND t < right_start + R AS ra FROM pf, LATERAL (SELECT unnest(range(0, length)) AS t))"""


@query(f"""WITH {_plan_sql()}, v AS (SELECT ep, f, CASE WHEN f * 2 < n THEN v ELSE 0 END AS l, CASE WHEN f * 2 >= n THEN v ELSE 0 END AS r FROM b)
SELECT output AS episode_index, t AS frame_index, a + t AS "index", ls_ AS left_source, rs_ AS right_source, NOT la AS left_idle, NOT ra AS right_idle, la AND ra AS overlap, x.l AS "left", y.r AS "right", c.ep AS source, 0 AS errors FROM ck c JOIN v x ON x.ep = c.ep AND x.f = ls_ JOIN v y ON y.ep = c.ep AND y.f = rs_""")
def retimed_dataset(spark, d):
    """Written, retimed with four onsets an episode, read back and validated."""
    source, output = _source(spark, d), scratch(spark, "retimed")
    datasets.retime_dataset(spark, source, output, 4, 12)
    errors = datasets.retime_errors(spark, source, output).groupBy("episode_index").agg(F.count("*").alias("errors"))
    about = sources.episodes(spark, output).select("episode_index", F.col("`retime/source_episode`").alias("source"))
    rows = sources.frames(spark, output).join(about, "episode_index").join(errors, "episode_index", "left")
    flags = [F.col(f"`retime.{c}`").alias(c) for c in ("left_idle", "right_idle", "overlap")]
    return rows.select("episode_index", "frame_index", "index", F.col("`retime.left_source_frame`").alias("left_source"), F.col("`retime.right_source_frame`").alias("right_source"), *flags, F.col("action")[0].alias("left"), F.col("action")[7].alias("right"), "source", F.coalesce("errors", F.lit(0)).alias("errors"))
