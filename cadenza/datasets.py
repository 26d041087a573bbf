"""Whole datasets: read, check, trim, retime, validate and publish.

A dataset is a folder with ``data`` (frames), ``meta/episodes``, ``meta/tasks`` (Parquet tables) and ``meta/info.json``, ``meta/stats.json``. A run writes to a
staging folder beside its output and renames that when all is there, through Hadoop's file system, so a reader sees a whole dataset or none. Tables
are written by Spark; the driver holds one row of totals and the statistics (a row a channel).

Nulls, empties, repeats: a frame vector that is null, has another width or isn't finite is an error, as are episodes that are there twice, without their frames,
or with frames that aren't 0, 1, ...; a dataset without episodes gives an empty one. Columns that are neither declared nor needed are left behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as X
from . import sources
from .operators import audit, clocks, series, stats
from .operators.review import reasons

WIDTH, ARM = 14, 7
IDS = ("episode_index", "frame_index", "index", "timestamp", "task_index")


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def put_json(spark: SparkSession, path: str, value: object) -> None:
    put_text(spark, path, json.dumps(value, indent=2, allow_nan=False))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(text.encode()))
    out.close()


def card(meta: dict, **about: object) -> str:
    """A short description of a dataset in Markdown: totals, features, how it was made."""
    rows = [f"| {k} | {f.get('dtype')} | {'x'.join(map(str, f.get('shape', ())))} |" for k, f in sorted(meta["features"].items())]
    made = [f"* {k}: {v}" for k, v in sorted(about.items())]
    lines = ["# Dataset", "", f"{meta['total_episodes']} episodes, {meta['total_frames']} frames at {meta['fps']} frames a second.", "", "| Feature | Type | Shape |", "|---|---|---|", *rows, "", *made]
    return "\n".join(lines).rstrip() + "\n"


def publish(spark: SparkSession, output: str, write) -> None:
    """``write(folder)`` into a staging folder, which is renamed to ``output``; on failure it is removed. An output that is there already is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(output).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(path(output)):
        raise FileExistsError(output)
    stage = f"{output}.stage-{uuid.uuid4().hex[:8]}"
    try:
        write(stage)
        if not files.rename(path(stage), path(output)):
            raise OSError(f"{output} could not be published")
    finally:
        if files.exists(path(stage)):
            files.delete(path(stage), True)


def checked_frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """(frames with ep and f, episodes, info) of a dataset whose counts and frame numbers agree; else an error that names what doesn't."""
    meta = get_json(spark, f"{root}/meta/info.json")
    episodes = sources.episodes(spark, root)
    rows = sources.frames(spark, root).withColumns({"ep": F.col("episode_index"), "f": F.col("frame_index")})
    lengths = rows.groupBy("ep").agg(F.count("*").alias("n"))
    both = episodes.select(F.col("episode_index").alias("ep"), F.col("length").alias("_n")).join(lengths, "ep", "full")
    bad = both.where(~F.col("n").eqNullSafe(F.col("_n"))).limit(5).collect()
    if bad:
        raise ValueError(f"episodes whose length differs from their frames: {[r['ep'] for r in bad]}")
    found = lengths.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("frames")).first()
    if (found["episodes"], found["frames"]) != (meta["total_episodes"], meta["total_frames"]):
        raise ValueError("totals differ from info.json")
    if not audit.frame_gaps(rows).isEmpty():
        raise ValueError("frame numbers aren't 0, 1, ... in every episode")
    return rows, episodes, meta


def _vectors(meta: dict) -> list[str]:
    return [k for k, f in meta["features"].items() if list(f.get("shape", ())) == [WIDTH]]


def _written(spark: SparkSession, stage: str, rows: DataFrame, episodes: DataFrame, tasks: DataFrame, meta: dict, vectors: list[str]) -> None:
    """All tables of a dataset. ``rows`` has its final columns; ``episodes`` lacks lengths and offsets, which come from the rows as written."""
    rows.repartition("episode_index").sortWithinPartitions("episode_index", "frame_index").write.parquet(f"{stage}/data")
    made = spark.read.parquet(f"{stage}/data")
    lengths = made.groupBy(F.col("episode_index").alias("ep")).agg(F.count("*").alias("n"))
    offsets = series.global_offsets(lengths).select(F.col("ep").alias("episode_index"), F.col("n").alias("length"), F.col("from").alias("dataset_from_index"), F.col("to").alias("dataset_to_index"))
    episodes.join(offsets, "episode_index").write.parquet(f"{stage}/meta/episodes")
    tasks.write.parquet(f"{stage}/meta/tasks")
    total = offsets.agg(F.count("*").alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")).first()
    found = {}
    for v in vectors:
        by_channel = sorted(stats.vector_stats(made, f"`{v}`", quantiles=False).collect(), key=lambda r: r["pos"])
        found[v] = {k: [r[k] for r in by_channel] for k in ("min", "max", "mean", "std")} | {"count": [by_channel[0]["count"]]} if by_channel else {}
    put_json(spark, f"{stage}/meta/stats.json", found)
    meta = meta | {"total_episodes": total["episodes"], "total_frames": total["frames"], "total_tasks": tasks.count(), "data_path": "data/*.parquet"}
    put_json(spark, f"{stage}/meta/info.json", meta)
    put_text(spark, f"{stage}/README.md", card(meta, **meta.get("made", {})))


def write_dataset(spark: SparkSession, output: str, rows: DataFrame, episodes: DataFrame, tasks: DataFrame, fps: float, features: dict[str, dict]) -> None:
    """A dataset of frames (episode_index, frame_index, index, timestamp, task_index and features) and episodes (episode_index, tasks, ...)."""
    meta = {"fps": fps, "features": features}
    publish(spark, output, lambda stage: _written(spark, stage, rows, episodes, tasks, meta, _vectors(meta)))


def _checked(v: str) -> Column:
    return X.checked_vector(X.doubles(F.col(f"`{v}`")), WIDTH)


def still_edges(rows: DataFrame, fps: float, joint: float = 0.1, grip: float = 0.1, tail_seconds: float = 2.0, vector: str = "action") -> DataFrame:
    """Per episode the interval that a trim keeps: any joint at ``joint`` degrees a second, or grip at ``grip`` millimetres, is motion."""
    marked = rows.select("ep", "f", _checked(vector).alias("vec"))
    limits = F.array(*map(F.lit, ([joint] * (ARM - 1) + [grip]) * 2))
    step = F.zip_with("vec", F.lag("vec").over(series.ORDER()), lambda a, b: F.abs(a - b) * fps)
    moves = F.exists(F.zip_with(step, limits, lambda s, t: s >= t), lambda x: x)
    return series.static_edges(series.still(marked, moves), fps, tail_seconds)


def trim_dataset(spark: SparkSession, source: str, output: str, joint: float = 0.1, grip: float = 0.1, tail_seconds: float = 2.0) -> dict:
    """Writes ``source`` without its still heads and tails; episodes, frames and index are numbered anew. Gives the totals."""
    sources.outside(output, source)
    rows, episodes, meta = checked_frames(spark, source)
    fps = float(meta["fps"])
    edges = still_edges(rows, fps, joint, grip, tail_seconds)
    keep = [c for c in sources.kept_features(meta["features"]) if c in rows.columns and c not in IDS]
    kept = series.trimmed(rows, edges, fps)
    task = F.col("task_index") if "task_index" in rows.columns else F.lit(0).cast("long")
    kept = kept.select(F.col("new_ep").alias("episode_index"), F.col("new_f").alias("frame_index"), "index", F.col("timestamp").cast("float").alias("timestamp"), task.alias("task_index"), *[F.col(f"`{c}`") for c in keep])
    numbers = series.global_offsets(edges.select("ep", F.lit(1).cast("long").alias("n"))).select("ep", F.col("from").alias("episode_index"))
    about = edges.join(numbers, "ep").join(episodes.select(F.col("episode_index").alias("ep"), "tasks"), "ep")
    about = about.select("episode_index", "tasks", F.col("ep").alias("trim/source_episode"), F.col("n").alias("trim/source_frames"), F.col("start").alias("trim/start"), F.col("stop").alias("trim/stop"), F.col("all_static").alias("trim/all_static"), F.col("shortfall").alias("trim/shortfall"))
    features = {c: f for c, f in meta["features"].items() if c in keep or c in IDS}
    publish(spark, output, lambda stage: _written(spark, stage, kept, about, tasks_of(spark, source), meta | {"features": features, "made": {"by": "trim", "joint": joint, "grip": grip, "tail_seconds": tail_seconds}}, [v for v in _vectors(meta) if v in keep]))
    made = get_json(spark, f"{output}/meta/info.json")
    return {"source_frames": meta["total_frames"], "output_frames": made["total_frames"], "episodes": made["total_episodes"]}


def tasks_of(spark: SparkSession, root: str) -> DataFrame:
    """The task table: a folder, or one file."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/meta/tasks")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{root}/meta/tasks" if there else f"{root}/meta/tasks.parquet")


def arm_energies(rows: DataFrame, vector: str = "action") -> DataFrame:
    """ep, i, left, right: motion energy of both arms on each edge, by the largest change of any of an arm's channels."""
    marked = rows.select("ep", "f", _checked(vector).alias("vec"))
    before = F.lag("vec").over(series.ORDER())
    step = lambda at: X.max_abs_step(F.slice("vec", at, ARM), F.slice(before, at, ARM))
    return series.energies(marked, left=step(1), right=step(ARM + 1))


def retime_plan(rows: DataFrame, outputs: int, least: int = 30) -> DataFrame:
    """A plan for each of ``outputs`` onsets of every episode whose segments weren't rejected."""
    good = series.segments(arm_energies(rows), least=least).where("not rejected")
    grid = good.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(outputs - 1).cast("long"))))
    return clocks.uniform_plan(grid, F.col("g"), F.lit(outputs))


def _gathered(rows: DataFrame, clock: DataFrame, vectors: list[str]) -> DataFrame:
    """The clock's frames with each vector's left half from the left source frame and right half from the right one."""
    half = lambda side, at: [F.slice(F.col(f"`{v}`"), at, ARM).alias(f"_{side}_{v}") for v in vectors]
    left = rows.select("ep", F.col("f").alias("left_src"), *half("left", 1))
    right = rows.select("ep", F.col("f").alias("right_src"), *half("right", ARM + 1))
    out = clock.join(left, ["ep", "left_src"]).join(right, ["ep", "right_src"])
    return out.select(*[F.col(f"`{c}`") for c in clock.columns], *[F.concat(F.col(f"`_left_{v}`"), F.col(f"`_right_{v}`")).alias(v) for v in vectors])


def retime_dataset(spark: SparkSession, source: str, output: str, outputs: int, least: int = 30) -> dict:
    """Writes ``outputs`` retimed episodes for each accepted one of ``source``, with idle flags, source clocks and each episode's plan. Gives the totals."""
    sources.outside(output, source)
    rows, episodes, meta = checked_frames(spark, source)
    fps, vectors = float(meta["fps"]), _vectors(meta)
    plan = retime_plan(rows, outputs, least)
    numbers = series.global_offsets(plan.select("ep").distinct().withColumn("n", F.lit(outputs).cast("long"))).select("ep", F.col("from").alias("_first"))
    plan = plan.join(numbers, "ep").withColumn("output", F.col("_first") + F.col("grid_index"))
    clock = clocks.clock_of(plan).join(plan.select("ep", "grid_index", "output"), ["ep", "grid_index"])
    clock = clock.withColumns({"retime.left_idle": ~F.col("left_active"), "retime.right_idle": ~F.col("right_active"), "retime.overlap": F.col("left_active") & F.col("right_active")})
    offsets = series.global_offsets(plan.select(F.col("output").alias("ep"), F.col("length").alias("n"))).select(F.col("ep").alias("output"), F.col("from").alias("_from"))
    made = _gathered(rows, clock, vectors).join(offsets, "output")
    flags = ("retime.left_idle", "retime.right_idle", "retime.overlap")
    made = made.select(
        F.col("output").alias("episode_index"), F.col("t").alias("frame_index"), (F.col("_from") + F.col("t")).alias("index"), (F.col("t") / fps).cast("float").alias("timestamp"), F.lit(0).cast("long").alias("task_index"),
        *[F.col(f"`{c}`") for c in (*vectors, *flags)], F.col("left_src").alias("retime.left_source_frame"), F.col("right_src").alias("retime.right_source_frame"),
    )
    about = plan.join(episodes.select(F.col("episode_index").alias("ep"), "tasks"), "ep").select(
        F.col("output").alias("episode_index"), "tasks", F.col("ep").alias("retime/source_episode"), F.col("grid_index").alias("retime/grid_index"), F.col("grid_size").cast("long").alias("retime/grid_size"),
        (F.col("left_start") / fps).alias("retime/left_start_seconds"), (F.col("right_start") / fps).alias("retime/right_start_seconds"),
        F.to_json(F.struct("position", "left_start", "right_start", F.col("L").alias("left_frames"), F.col("R").alias("right_frames"))).alias("retime/timing_json"),
        F.to_json(F.struct("ls", "le", "rs", "re", "right_before", "left_after")).alias("retime/detection_json"),
    )
    features = {v: meta["features"][v] for v in vectors} | {c: {"dtype": "bool", "shape": [1]} for c in flags} | {f"retime.{s}_source_frame": {"dtype": "int64", "shape": [1]} for s in ("left", "right")}
    publish(spark, output, lambda stage: _written(spark, stage, made, about, tasks_of(spark, source), meta | {"features": features, "made": {"by": "retime", "outputs": outputs, "least_frames": least}}, vectors))
    total = get_json(spark, f"{output}/meta/info.json")
    return {"source_episodes": meta["total_episodes"], "output_episodes": total["total_episodes"], "output_frames": total["total_frames"]}


def retime_errors(spark: SparkSession, source: str, output: str) -> DataFrame:
    """Frames of a retimed dataset (episode_index, frame_index, why) that break its rules: values that aren't the source's at the stored clocks, clocks that run back or skip,
    frame numbers, global index, times, and flags of both arms idle. None if it is right."""
    meta = get_json(spark, f"{output}/meta/info.json")
    vectors, fps = _vectors(meta), float(meta["fps"])
    made, episodes = sources.frames(spark, output), sources.episodes(spark, output)
    rows = sources.frames(spark, source).withColumns({"ep": F.col("episode_index"), "f": F.col("frame_index")}).select("ep", "f", *[F.col(f"`{v}`") for v in vectors])
    clock = made.join(episodes.select("episode_index", F.col("`retime/source_episode`").alias("ep"), F.col("dataset_from_index").alias("_from")), "episode_index")
    clock = clock.select("episode_index", "frame_index", "index", "timestamp", "ep", "_from", F.col("`retime.left_source_frame`").alias("left_src"), F.col("`retime.right_source_frame`").alias("right_src"), (F.col("`retime.left_idle`") & F.col("`retime.right_idle`")).alias("_both"), *[F.col(f"`{v}`").alias(f"_has_{v}") for v in vectors])
    left = rows.select("ep", F.col("f").alias("left_src"), *[F.slice(F.col(f"`{v}`"), 1, ARM).alias(f"_left_{v}") for v in vectors])
    right = rows.select("ep", F.col("f").alias("right_src"), *[F.slice(F.col(f"`{v}`"), ARM + 1, ARM).alias(f"_right_{v}") for v in vectors])
    w = series.Window.partitionBy("episode_index").orderBy("frame_index")
    both = clock.join(left, ["ep", "left_src"], "left").join(right, ["ep", "right_src"], "left")
    both = both.withColumns({"_l": F.col("left_src") - F.lag("left_src").over(w), "_r": F.col("right_src") - F.lag("right_src").over(w), "_place": F.row_number().over(w) - 1})
    same = F.lit(True)
    for v in vectors:
        same = same & F.col(f"`_has_{v}`").eqNullSafe(F.concat(F.col(f"`_left_{v}`"), F.col(f"`_right_{v}`")))
    step = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 1)
    why = reasons(
        values=~same, clock=step("_l") | step("_r"), frame=F.col("frame_index") != F.col("_place"), index=F.col("index") != F.col("_from") + F.col("frame_index"),
        timestamp=F.abs(F.col("timestamp") - F.col("frame_index") / fps) > 1e-5 * F.greatest(F.lit(1.0), F.col("frame_index") / fps), both_idle=F.col("_both"),
    )
    return both.select("episode_index", "frame_index", why.alias("why")).where(F.size("why") > 0)


def trim_errors(spark: SparkSession, source: str, output: str) -> DataFrame:
    """Frames of a trimmed dataset (episode_index, frame_index) that aren't the source's frames of their interval, and source frames of an interval that are missing."""
    made, episodes = sources.frames(spark, output), sources.episodes(spark, output)
    vectors = [v for v in _vectors(get_json(spark, f"{output}/meta/info.json"))]
    spans = episodes.select("episode_index", F.col("`trim/source_episode`").alias("ep"), F.col("`trim/start`").alias("_a"), F.col("`trim/stop`").alias("_b"))
    rows = sources.frames(spark, source).select(F.col("episode_index").alias("ep"), F.col("frame_index").alias("_f"), *[F.col(f"`{v}`").alias(f"_was_{v}") for v in vectors])
    want = rows.join(spans, "ep").where((F.col("_f") >= F.col("_a")) & (F.col("_f") < F.col("_b"))).withColumn("frame_index", F.col("_f") - F.col("_a"))
    both = made.select("episode_index", "frame_index", F.lit(True).alias("_there"), *[F.col(f"`{v}`") for v in vectors]).join(want, ["episode_index", "frame_index"], "full")
    same = F.col("_there").isNotNull() & F.col("_f").isNotNull()
    for v in vectors:
        same = same & F.col(f"`{v}`").eqNullSafe(F.col(f"`_was_{v}`"))
    return both.where(~same).select("episode_index", "frame_index")
