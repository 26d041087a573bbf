"""Small cases with known answers, and inputs that must fail."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import functions as X
from cadenza import sources
from cadenza.operators import audit, clocks, events, series, stats
from cadenza.plans import solvers


def frames(spark, values, col="v"):
    kind = "array<double>" if col == "vec" else "double"
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], f"ep long, f long, {col} {kind}")


def trim(spark, rows, fps, threshold, tail):
    step = X.max_abs_step(F.col("vec"), F.lag("vec").over(series.ORDER())) * fps >= threshold
    return series.static_edges(series.still(frames(spark, rows, "vec"), step), fps, tail).first()


def test_trim_two_ramps(spark):
    rows = [[20.0 * min(max(i - 10, 0), 20) / 20] + [0.0] * 6 + [30.0 * min(max(i - 20, 0), 30) / 30] + [0.0] * 6 for i in range(100)]
    got = trim(spark, rows, 10, 0.1, 2)
    assert (got.start, got.stop, got.shortfall) == (10, 71, 0)


def test_trim_short_tail(spark):
    got = trim(spark, [[float(min(i, 25))] * 14 for i in range(30)], 10, 0.1, 2)
    assert (got.stop, got.shortfall) == (30, 16)


def test_trim_gripper(spark):
    got = trim(spark, [[0.0] * 6 + [float(min(max(i - 5, 0), 10))] + [0.0] * 7 for i in range(50)], 10, 0.1, 0)
    assert (got.start, got.stop) == (5, 16)


@pytest.mark.parametrize("n,tail,start", [(100, 2, 80), (5, 2, 0), (1, 0, 0)])
def test_trim_static(spark, n, tail, start):
    got = trim(spark, [[0.0] * 14] * n, 10, 0.1, tail)
    assert (got.start, got.stop, got.all_static) == (start, n, True)


def test_trim_threshold_is_strict(spark):
    assert trim(spark, [[i / 10] + [0.0] * 13 for i in range(2)], 1, 0.1, 0).head_frames == 0


def ramps(left, right, n=240):
    ramp = lambda i, a, b, top: top * min(max((i - a) / (b - a), 0), 1)
    return [(0, i, ramp(i, *left), ramp(i, *right)) for i in range(n)]


def sides(spark, rows):
    df = spark.createDataFrame(rows, "ep long, f long, l double, r double")
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(series.ORDER()))
    left = series.energy(df, step("l")).withColumnRenamed("e", "left")
    return left.join(series.energy(df, step("r")).withColumnRenamed("e", "right"), ["ep", "i"])


def test_segments(spark):
    got = series.segments(sides(spark, ramps((10, 100, 70.0), (140, 220, 50.0)))).first()
    assert got.ls <= 10 and 101 <= got.le < got.rs <= 140 and got.re >= 221
    assert got.right_before == 0 and got.left_after == 0 and not got.rejected


def test_segments_rejected(spark):
    got = series.segments(sides(spark, ramps((10, 100, 70.0), (20, 79, 50.0))), most_cross=0.05).first()
    assert got is None or got.rejected


def test_uniform_plan(spark):
    seg = spark.createDataFrame([(0, 6, 103, 136, 225)], "ep long, ls long, le long, rs long, re long")
    plans = {}
    for g in (0, 108, 215):
        plan = clocks.uniform_plan(seg, F.lit(g).cast("long"), F.lit(216))
        plans[g] = plan.first()
        idle = clocks.clock_of(plan).where("not left_active and not right_active").count()
        assert idle == 0
    assert plans[0].right_start == 97 and plans[215].right_start == 0


def test_gather(spark):
    clock = spark.createDataFrame([(0, t, a, b) for t, (a, b) in enumerate(zip([0, 1, 2, 2, 4], [0, 0, 1, 2, 3]))], "ep long, t long, left_src long, right_src long")
    got = sorted(clocks.gather(clock, frames(spark, [1.0, 2.0, 3.0, 4.0, 5.0])).select("t", "left", "right").collect())
    assert [r.left for r in got] == [1, 2, 3, 3, 5] and [r.right + 5 for r in got] == [6, 6, 7, 8, 9]


def test_interpolation(spark):
    rows = frames(spark, [[14.0 * r + c for c in range(14)] for r in range(3)], "vec")
    clock = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.25), (0, 2, 0.5)], "ep long, t long, c double")
    got = {r.t: r.vec for r in clocks.interpolate(clock, rows).collect()}
    assert got[1][0] == 3.5 and got[2][7] == 14.0


def test_bad_positions(spark):
    clock = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.5), (0, 2, float("nan")), (0, 3, None), (0, 4, -1.0)], "ep long, t long, c double")
    lengths = spark.createDataFrame([(0, 3)], "ep long, n long")
    assert {r.t for r in clocks.bad_positions(clock, lengths).collect()} == {1, 2, 3, 4}


def test_hold(spark):
    clock = spark.createDataFrame([(0, 0, 5, 8), (0, 1, 6, 9)], "ep long, t long, left_src long, right_src long")
    got = clocks.hold(clock, 30, 2).orderBy("t").collect()
    assert len(got) == 62 and all((r.left_src, r.right_src, r.held) == (6, 9, True) for r in got[2:])


@pytest.mark.parametrize(
    "clock,idle",
    [([0, 0, 0, 1, 2, 2, 2, 3, 4, 4, 4], [1, 1, 0, 0, 1, 1, 0, 0, 0, 1, 1]), ([4, 4, 4], [1, 1, 1]), ([4], [0]), ([0, 0.01, 0.02], [0, 0, 0])],
)
def test_idle_mask(spark, clock, idle):
    got = clocks.idle_mask(frames(spark, [float(c) for c in clock]), "v").orderBy("f").collect()
    assert [int(r.idle) for r in got] == idle


def test_wait_masks(spark):
    rows = spark.createDataFrame([(i, left, i) for i, left in enumerate([0, 0, 1, 2, 2, 2, 2, 3, 4, 4])], "f long, l long, r long")
    got = rows.withColumn("w", clocks.required_wait(F.col("l"), F.col("r"), 2, 6)).where("w").collect()
    assert [r.f for r in got] == [3, 4, 5]
    must, excess = clocks.right_waits(F.col("f"), F.col("f"), 1, 3, 7)
    both = spark.range(10).withColumnRenamed("id", "f").select("f", must.alias("m"), excess.alias("e")).orderBy("f").collect()
    assert [r.f for r in both if r.m] == [1, 2] and [r.f for r in both if r.e] == [3, 4, 5, 6]


def test_lift_clock(spark):
    plan = spark.createDataFrame([(0, 100, 150, 200)], "ep long, start long, peak long, stop long")
    got = [r.c for r in clocks.lift_clock(plan, 30).orderBy("t").collect()]
    steps = np.diff(got)
    assert got[0] == 100 and got[-1] == 200 and 150 in got and (steps >= -1e-9).all() and (steps <= 1 + 1e-9).all()


def test_aperture(spark):
    values = [None] + [20.0] * 9 + list(np.linspace(20, 2, 10)) + [2.0] * 10 + list(np.linspace(2, 20, 10)) + [20.0] * 10
    rows = spark.createDataFrame([(0, i, None if v is None else float(v)) for i, v in enumerate(values)], "ep long, f long, v double")
    got = [r.state for r in series.aperture_states(rows, 10).orderBy("f").collect()]
    assert got[0] == "UNKNOWN" and got[5] == "OPEN" and got[25] == "CLOSED" and "CLOSING" in got[10:20] and "OPENING" in got[30:40]


def test_lift_peak_ignores_slow_heights_below(spark):
    got = series.lift_peak(frames(spark, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0, 4.0, 3.0]), 0.5).first()
    assert got.peak in (6, 7)


def test_retreat(spark):
    rows = frames(spark, [0.004 * max(0, i - 14) for i in range(40)])
    assert series.sustained_retreat(rows, 6, 0.002).first().retreat == 14


def test_terminal_rest(spark):
    values = [0.0] * 30 + list(np.linspace(0, 29, 30)) + [29.0] * 60
    got = series.terminal_rest(frames(spark, [float(v) for v in values]), 0.3, 30, after=10).first()
    assert (got.start, got.end) == (59, 120) and got.mask_start == 104


def test_object_state(spark):
    got = spark.createDataFrame([(9,), (14,), (15,), (30,), (31,)], "t long").select("t", events.object_state(F.col("t"), F.lit(10), F.lit(15), F.lit(30)).alias("s")).orderBy("t").collect()
    assert [r.s for r in got] == ["AT_ORIGIN", "GRASPING", "HELD", "RELEASING", "PLACED"]


def test_merged_stats_equal_stats_of_union(spark):
    rows = spark.createDataFrame([(0, i, [float(2 * i), float(2 * i + 1)]) for i in range(6)] + [(1, i, [float(2 * i), float(2 * i + 1)]) for i in range(10)], "ep long, f long, vec array<double>")
    one = {r.pos: r for r in stats.merged_stats(stats.vector_stats(rows, "vec", "ep", quantiles=False), "pos").collect()}
    for r in stats.vector_stats(rows, quantiles=False).collect():
        assert np.allclose([r.min, r.max, r.mean, r.std, r["count"]], [one[r.pos].min, one[r.pos].max, one[r.pos].mean, one[r.pos].std, one[r.pos]["count"]])


def test_static_spans():
    still = np.arange(30.0)[:, None]
    assert len(solvers.static_spans(still, np.array([0.3]), [(2, 28)], 15, 6)) == 30
    v = np.zeros((100, 7))
    v[30:50, 6], v[50:, 6] = 20, 10
    kept = solvers.static_spans(v, np.array([0.3] * 6 + [0.5]), [(20, 80)], 15, 6)
    assert {0, 19, 20, 30, 50, 79, 80, 99} <= set(kept) and len(kept) < 100


def steps(path):
    return len(path) if path else None


def test_scheduler_literals():
    free = lambda *a: True
    path = solvers.shortest_schedule(4, 6, free)
    assert [i for i, _ in path] == [0, 1, 2, 3, 3, 3] and [j for _, j in path] == list(range(6))
    bad = {(2, 1), (2, 2)}
    assert steps(solvers.shortest_schedule(5, 4, lambda i, j, a, b: (a, b) not in bad)) == 6
    assert steps(solvers.shortest_schedule(6, 7, free, lambda i, j: i <= 2 or j >= 5, left_priority=False)) == 8
    assert steps(solvers.shortest_schedule(3, 3, lambda i, j, a, b: a == i or b == j or (i, j) == (a, b), left_priority=False)) == 5


def test_scheduler_is_shortest():
    for seed in range(60):
        bad = {tuple(x) for x in np.argwhere(np.random.default_rng(seed).random((4, 4)) < 0.2)}
        path = solvers.shortest_schedule(4, 4, lambda i, j, a, b: (a, b) not in bad, left_priority=False)
        if (0, 0) in bad or (3, 3) in bad:
            continue
        level, seen = [(0, 0)], {(0, 0): 0}
        for i, j in level:
            for a, b in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
                if a < 4 and b < 4 and (a, b) not in bad and (a, b) not in seen:
                    seen[a, b] = seen[i, j] + 1
                    level.append((a, b))
        assert (path is None) == ((3, 3) not in seen) and (path is None or len(path) - 1 == seen[3, 3])


def test_selection():
    make = lambda o, a, b, s: dict(object=o, side="left", grasp=a, pickup=a, release=b, score=s)
    options = [make(0, 5, 80, 0.95), make(0, 5, 20, 0.85), make(1, 40, 60, 0.9)]
    assert [c["score"] for c in solvers.best_subset(options)] == [0.85, 0.9]


def test_assignment():
    assert solvers.assign(np.array([[1.0, 2.0], [2.0, 9.0]])) == [(0, 1), (1, 0)]
    assert solvers.assign(np.array([[3.0, 9.0]])) == []


def test_audits_find_what_is_wrong(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 2, 0.1), (1, 0, 0.0)], "ep long, f long, timestamp double")
    assert audit.frame_gaps(rows).count() == 1 and audit.timestamp_errors(rows, 10).count() == 1
    spans = spark.createDataFrame([(0, 0, 3), (0, 2, 5), (0, 8, 20)], "ep long, start long, end long")
    assert audit.interval_errors(spans, spark.createDataFrame([(0, 10)], "ep long, n long")).count() == 2
    assert audit.repeated_keys(rows, "ep").count() == 1


def test_guards(spark):
    one = spark.createDataFrame([([1.0, float("nan")],), ([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in one.select(X.is_vector(F.col("v"), 2)).collect()] == [False, True, False, False]
    with pytest.raises(Exception, match="finite values"):
        one.select(X.checked_vector(F.col("v"), 2)).collect()
    with pytest.raises(Exception, match="must be positive"):
        spark.range(1).select(X.checked_positive(F.col("id"), "total")).collect()
    uri = spark.createDataFrame([("zip://a/b.zip#x/1.png",), ("zip://a#../x",)], "u string")
    assert [tuple(r) for r in uri.select(*X.archive_member(F.col("u"))).collect()] == [("a/b.zip", "x/1.png"), ("", "")]
    r = spark.createDataFrame([("bytes=0-4",), ("bytes=-3",), ("bytes=20-",)], "h string").select(X.byte_range(F.col("h"), F.lit(10).cast("long")).alias("r")).collect()
    assert [x.r and tuple(x.r) for x in r] == [(0, 4), (7, 9), None]


def test_remap(spark):
    table = spark.createDataFrame([(0, i, [float(i)] * 2, i + 1, i + 6) for i in range(5)], "ep long, f long, vec array<double>, left_x long, right_x long")
    clock = spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(zip([0, 1, 2, 2, 4], [0, 0, 1, 2, 3]))], "ep long, t long, left_src double, right_src double")
    got = sources.remapped(table, clock, ["vec"]).orderBy("f").collect()
    assert [r.left_x for r in got] == [1, 2, 3, 3, 5] and [r.right_x for r in got] == [6, 6, 7, 8, 9] and got[4].vec == [4.0, 3.0]
    with pytest.raises(ValueError, match="no rule"):
        sources.remapped(table.withColumn("odd", F.lit(1)), clock, ["vec"])


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "a.json")
    sources.write_json(path, {"a": 1})
    with pytest.raises(ValueError):
        sources.write_json(path, {"a": float("nan")})
    assert json.load(open(path)) == {"a": 1} and len(list(tmp_path.iterdir())) == 1
    out = str(tmp_path / "t")
    sources.publish(spark.range(3), out)
    sources.publish(spark.range(5), out)
    assert spark.read.parquet(out).count() == 5 and len([p for p in tmp_path.iterdir() if p.name.startswith("t")]) == 1
    have = sources.inventory(spark, out)
    manifest = have.select("path", F.lit("0").alias("sha256")).limit(1)
    assert sources.changed(have, have.select("path", "sha256")).count() == 0 and sources.changed(have, manifest).count() == 1
    with pytest.raises(ValueError):
        sources.outside(str(tmp_path / "x/y"), str(tmp_path / "x"))


def test_episode_source(spark, tmp_path):
    rows = spark.createDataFrame([(3, 50), (7, 50)], "episode_index long, length long")
    rows.write.parquet(str(tmp_path / "meta/episodes/chunk-000"))
    assert sources.episodes(spark, str(tmp_path)).count() == 2
    rows.write.parquet(str(tmp_path / "meta/episodes/chunk-001"))
    with pytest.raises(ValueError, match="more than once"):
        sources.episodes(spark, str(tmp_path))


def test_stream_ingest_resumes(spark, tmp_path):
    from cadenza import streaming

    src, rec = str(tmp_path / "in"), str(tmp_path / "receipts")
    schema = "ep long, sha256 string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    for k in range(2):
        streaming.ingest(spark, src, schema, lambda df: df, rec, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(rec).count() == 2
