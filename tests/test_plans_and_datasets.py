"""Scored hypotheses, visits, clocks with ramps, stages, guards and whole datasets: cases with known answers, brute force, awkward and empty tables."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import datasets, sources
from cadenza.__main__ import main
from cadenza.functions import geometry as G
from cadenza.operators import clocks, events, motion, review, series
from cadenza.plans import solvers

# ---- hypotheses


def hypothesis(spark, x, gx, jaw, y=None, verified=None, frame=30):
    n = len(x)
    y = np.zeros(n) if y is None else y
    clean = lambda v: None if np.isnan(v) else float(v)
    rows = [(0, f, clean(x[f]), clean(x[f] * 0 + y[f]), float(gx[f]), 0.0, float(jaw[f])) for f in range(n)]
    track = spark.createDataFrame(rows, "ep long, f long, x double, y double, gx double, gy double, jaw double")
    found = spark.createDataFrame([(0, 7, frame, verified)], "ep long, id long, frame long, verified long")
    return motion.scored_hypotheses(track, found, 100.0).first()


def carried(n=100):
    x = np.zeros(n)
    x[30:65], x[65:] = np.arange(35), 34
    g = x.copy()
    g[65:] += np.arange(n - 65) * 2
    return x, g


def test_closing_without_motion_is_no_grasp(spark):
    got = hypothesis(spark, np.zeros(100), np.zeros(100), np.r_[np.full(30, 20), np.full(70, 2)])
    assert not got.accepted and "no_stable_correlated_pickup" in got.why


def test_without_a_moving_frame_there_is_no_onset(spark):
    got = hypothesis(spark, np.zeros(100), np.zeros(100), np.r_[np.full(30, 20), np.full(70, 2)])
    assert got.motion_onset == 0 and got.motion_correlation == 0 and "low_posterior_score" in got.why


@pytest.mark.parametrize("jaw", [np.r_[np.full(30, 20), np.full(35, 2), np.full(35, 20)], np.r_[np.full(30, 20), np.full(30, 2), np.linspace(2, 20, 20), np.full(20, 20)], np.full(100, 49.4)])
def test_motion_and_release_make_a_grasp(spark, jaw):
    x, g = carried()
    got = hypothesis(spark, x, g, jaw)
    assert got.accepted and 30 <= got.pickup <= 32 and 65 <= got.release <= 67 and (got.closure >= 0.1) == (jaw[0] == 20)


def test_what_is_not_seen_is_no_evidence(spark):
    x = np.zeros(100)
    x[30:70] = np.nan
    got = hypothesis(spark, x, np.zeros(100), np.r_[np.full(30, 20), np.full(70, 2)])
    assert not got.accepted and "insufficient_future_visibility" in got.why


def test_a_verified_release_comes_first(spark):
    x, g = carried(120)
    got = hypothesis(spark, x, g, np.full(120, 10), verified=95)
    assert got.accepted and got.release == 95


def test_a_visit_needs_a_stay_and_an_exit(spark):
    track = spark.createDataFrame([(e, f, 30.0 if 30 <= f < (50 if e == 0 else 32) else 80.0, 30.0 if 30 <= f < 50 else 70.0) for e in (0, 1) for f in range(90)], "ep long, f long, x double, y double")
    visits = spark.createDataFrame([(e, 10, 90, 0.0, 60.0, 0.0, 60.0) for e in (0, 1)], "ep long, pickup long, stop long, left double, right double, top double, bottom double")
    assert [(r.ep, r.entry, r.clearance) for r in motion.bin_visits(track, visits, 30.0, 0.6).collect()] == [(0, 30, 50)]


# ---- clocks


def test_speed_laws():
    """The way of each speed and of the bump: a half, a half, a thirtieth; full speed at one end, rest at the other."""
    way = lambda p: sum(c / (k + 1) for k, c in enumerate(p))
    assert (way(clocks._FASTER), way(clocks._SLOWER)) == (0.5, 0.5) and way(clocks._BUMP) == pytest.approx(1 / 30)
    assert [sum(p) for p in (clocks._FASTER, clocks._SLOWER, clocks._BUMP)] == [1, 0, 0]
    with pytest.raises(ValueError):
        clocks._ramps(3.0, 0.5, 0.3)


def test_approach_clock_rests_at_its_stops(spark):
    routes = spark.createDataFrame([(0, 0, [5, 60, 60], 130), (1, 10, [], 40), (2, 3, [3], 3)], "ep long, start long, stops array<long>, end long")
    rows = clocks.approach_clock(routes, 30.0).orderBy("ep", "t").collect()
    c = [r.c for r in rows if r.ep == 0]
    assert [r.c for r in rows if r.held] == [5, 60] and c[0] == 0 and c[-1] == 130
    step = np.diff(c)
    assert (step > 0).all() and step.max() < 1.05 and [r.t for r in rows if r.ep == 0] == list(range(len(c)))
    for stop in (5, 60):
        at = c.index(stop)
        assert step[at - 1] < 0.1 and step[at] < 0.1
    assert [r.c for r in rows if r.ep == 1] == list(range(10, 41)) and [r.c for r in rows if r.ep == 2] == [3]


def test_waits_are_eased_on_one_path(spark):
    left = [*range(21), *[20] * 12, *range(21, 45), *[44] * 12]
    clock = spark.createDataFrame([(0, t, float(x), float(t)) for t, x in enumerate(left)] + [(1, t, float(t), float(t)) for t in range(50)], "ep long, t long, left double, right double")
    rows = clocks.smoothed_waits(clock, 30.0).orderBy("ep", "t").collect()
    own = [r for r in rows if r.ep == 0]
    lefts, rights = np.array([r.left for r in own]), np.array([r.right for r in own])
    assert (np.diff(lefts) >= 0).all() and (np.diff(rights) >= 0).all() and (lefts[0], rights[0], lefts[-1], rights[-1]) == (0, 0, 44, len(left) - 1)
    assert np.allclose(lefts, np.interp(rights, np.arange(len(left)), left)) and (lefts[(rights >= 20) & (rights <= 32)] == 20).all()
    stops = [k for k, r in enumerate(own) if r.held]
    assert len(stops) == 3 and all(rights[k] - rights[k - 1] < 0.01 and rights[k + 1] - rights[k] < 0.015 for k in stops)
    assert [(r.left, r.right) for r in rows if r.ep == 1] == [(t, t) for t in range(50)]
    near = clocks.smoothed_waits(spark.createDataFrame([(0, t, float(a), float(b)) for t, (a, b) in enumerate(zip([0, 1, 1, 2, 2, 3], [0, 0, 1, 1, 2, 2]))], "ep long, t long, left double, right double"), 30.0).orderBy("t").collect()
    assert max(np.diff([r.left for r in near]).max(), np.diff([r.right for r in near]).max()) <= 1 and np.diff([r.t for r in near if r.held]).min() >= 24


def test_stage_cache_and_profiles(spark, tmp_path):
    from cadenza.plans import profiles

    made = []
    make = lambda n: lambda: (made.append(n), spark.range(n))[1]
    assert [sources.cached(spark, str(tmp_path), make(n), code="v1", n=k).count() for n, k in ((3, 1), (9, 1), (4, 2))] == [3, 3, 4] and made == [3, 4]
    assert profiles.profile("drawer", priority="right").priority == "right"
    with pytest.raises(KeyError):
        profiles.profile("none")
    with pytest.raises(TypeError):
        profiles.profile("drawer", wrong=1)


def test_stage_delays_and_profiles(spark):
    got = spark.createDataFrame([(157, 211, 0.0), (157, 211, 1.0)], "a long, b long, u double").select(*clocks.stage_delays(F.col("a"), F.col("b"), F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(0, 157), (211, 0)]
    stages = spark.createDataFrame([(k, 100, 300, 220, u) for k, u in enumerate((0.55, 0.65, 0.9, 0.0))], "ep long, start long, peak long, opening long, position double")
    assert [r.stops for r in clocks.lift_profiles(stages, 30.0).orderBy("ep").collect()] == [False, False, False, True]


def test_stage_audit(spark):
    right = [0, 1, 2, 3, 3, 3, 5]
    lefts = {0: [0, 1, 2, 2, 3, 4, 5], 1: [0, 1, 2, 3, 4, 5, 5], 2: [0, 1, 2, 2, 1, 4, 5]}
    clock = spark.createDataFrame([(e, t, float(a), float(b)) for e, left in lefts.items() for t, (a, b) in enumerate(zip(left, right))], "ep long, t long, left double, right double")
    stages = spark.createDataFrame([(e, 2, 3, 5, 4, 0, 2, 3) for e in lefts], "ep long, peak long, opened long, closing long, withdrawn long, ahead long, a long, b long")
    got = {r.ep: r.why for r in clocks.stage_errors(clock, stages).collect()}
    assert 0 not in got and "inserted_early" in got[1] and "runs_back" in got[2]


def test_bounds_never_exceed_the_way(spark):
    """On free grids with the drawer's gates, the bound is at most the number of steps that are left."""
    n, m, gate, opening, withdrawn, closing = 9, 10, 3, 4, 6, 7
    ok = np.array([[(i <= gate or j >= opening) and (j < closing or i >= withdrawn) for j in range(m)] for i in range(n)])
    left = {}
    for i, j in zip(*np.nonzero(ok)):
        far = solvers.wave(ok[i:, j:])[-1, -1]
        if far >= 0:
            left[int(i), int(j)] = int(far)
    rows = spark.createDataFrame([(*s, k) for s, k in left.items()], "i long, j long, left long")
    got = rows.select("left", clocks.remaining_bound(F.col("i"), F.col("j"), n, m, gate, opening, withdrawn, closing).alias("b")).collect()
    assert got and all(r.b <= r.left for r in got) and any(r.b == r.left > 8 for r in got)


# ---- schedules


def brute_steps(ok, lw, rw):
    n, m = ok.shape
    if not ok[0, 0]:
        return -1
    seen, front, steps = {(0, 0)}, [(0, 0)], 0
    while front:
        if (n - 1, m - 1) in front:
            return steps
        new = []
        for i, j in front:
            for a, b, may in ((i + 1, j + 1, True), (i + 1, j, rw[i, j]), (i, j + 1, lw[i, j])):
                if a < n and b < m and may and ok[a, b] and (a, b) not in seen:
                    seen.add((a, b))
                    new.append((a, b))
        front, steps = new, steps + 1
    return -1


def test_waves_and_paths_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 7, 2)
        ok, lw, rw = rng.random((n, m)) > 0.2, rng.random((n, m)) > 0.3, rng.random((n, m)) > 0.3
        want = brute_steps(ok, lw, rw)
        assert solvers.wave(ok, lw, rw)[-1, -1] == want
        path, why = solvers.shortest_path(ok, lw, rw)
        assert (path is None) == (want < 0) and (why is None) == (want >= 0)
        if path:
            assert len(path) == want + 1 and path[0] == (0, 0) and path[-1] == (n - 1, m - 1) and all(ok[s] for s in path)
            for (i, j), (a, b) in itertools.pairwise(path):
                assert (a - i, b - j) in ((1, 1), (1, 0), (0, 1)) and (a > i or lw[i, j]) and (b > j or rw[i, j])


def test_preference_decides_who_waits_later():
    free = np.ones((4, 6), bool)
    one, two = (solvers.shortest_path(free, prefer=p)[0] for p in ("left", "right"))
    assert one == [(0, 0), (1, 1), (2, 2), (3, 3), (3, 4), (3, 5)] or len(one) == len(two) == 6


# ---- guards and joins


def test_cohorts(spark):
    rows = [(c, k, i) for c, ids in enumerate(([1, 1], [3, 1], [-1], [10], [None], [0, 4, 9])) for k, i in enumerate(ids)]
    bad = review.cohort_errors(spark.createDataFrame(rows, "cohort long, place long, id long"), 10).collect()
    assert {r.cohort for r in bad} == {0, 1, 2, 3, 4}


def test_masks_alternate_like_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for ep in range(30):
        before = None
        for f in range(40):
            x, area = rng.choice([0.0, 0.0, 50.0, 100.0]), rng.choice([1, 1, 1, 9])
            ok = area <= 5 and not (before is not None and abs(x - before) > 30)
            rows.append((ep, f, area, x, 0.0))
            want[ep, f] = ok
            before = x if ok else None
    got = review.accepted_masks(spark.createDataFrame(rows, "ep long, f long, area long, x double, y double").repartition(5), 5, 30.0).collect()
    assert {(r.ep, r.f): r.accepted for r in got} == want


def test_bits_like_numpy(spark):
    rng = np.random.default_rng(3)
    flags = [rng.random(n) < 0.5 for n in (0, 1, 7, 8, 9, 40)]
    df = spark.createDataFrame([(k, [bool(x) for x in f]) for k, f in enumerate(flags)], "k int, flags array<boolean>")
    packed = G.packed_bits(F.col("flags"))
    for r in df.select("k", packed.alias("p"), G.unpacked_bits(packed, F.size("flags")).alias("u")).collect():
        assert r.p == np.packbits(flags[r.k]).tolist() and r.u == flags[r.k].tolist()


def test_overlaps_over_many_bins(spark):
    rng = random.Random(4)
    spans = [(e, k, a, a + rng.choice([0, 3, 64, 500])) for e in range(3) for k, a in enumerate(rng.sample(range(1000), 30))]
    got = {(r.ep, r.a, r.b) for r in events.overlapping(spark.createDataFrame(spans, "ep long, id long, grasp long, release long")).collect()}
    assert got == {(x[0], x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[1] < y[1] and x[2] <= y[3] and y[2] <= x[3]}


def test_offsets_over_ranges_of_episodes(spark, monkeypatch):
    monkeypatch.setattr(series, "EPISODES", 10)
    ids = sorted(random.Random(5).sample(range(-50, 10**12), 40) + [7, 8, 9, 10, 11])
    got = {r.ep: (r["from"], r["to"]) for r in series.global_offsets(spark.createDataFrame([(i, 1 + k % 3) for k, i in enumerate(ids)], "ep long, n long")).collect()}
    ends = list(itertools.accumulate(1 + k % 3 for k in range(len(ids))))
    assert got == {i: (e - 1 - k % 3, e) for k, (i, e) in enumerate(zip(ids, ends))}


def test_fingerprints_ignore_the_order_of_rows(spark):
    rows = [("a", f"f{k}", k, f"{k:064x}") for k in range(9)]
    one, two = (review.fingerprints(spark.createDataFrame(r, "key string, name string, bytes long, sha256 string").repartition(n), "key").first().fingerprint for r, n in ((rows, 1), (rows[::-1], 4)))
    other = review.fingerprints(spark.createDataFrame([*rows[:-1], ("a", "f8", 8, "0")], "key string, name string, bytes long, sha256 string"), "key").first().fingerprint
    assert one == two != other


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ep long, f long, t long, id long, v double, x double, y double, gx double, gy double, jaw double, area double, start long, end long, n long, left double, right double, grasp long, release long, frame long, verified long, n_ long, place long, cohort long, batch long, code long, seconds double, rank long, variant long, position double, frames long")
    for out in (
        motion.scored_hypotheses(none, none.select("ep", "id", "frame", "verified"), 100.0),
        events.interval_frames(none.select("ep", "f"), none.select("ep", "start", "end")),
        events.overlapping(none),
        series.global_offsets(none),
        review.cohort_errors(none, 5),
        review.accepted_masks(none, 5, 3.0),
        review.batch_ledger(none),
        review.spacing_errors(none),
        solvers.kept_frames(none, 1.0, 5, 1),
    ):
        assert out.isEmpty()


def test_times_without_a_zone_are_utc(spark):
    from cadenza.streaming import sessions, tumbling

    rows = spark.sql("select timestamp_ntz'2024-03-10 01:59:00' as ts, 1 as k, 2.0 as value union all select timestamp_ntz'2024-03-10 02:20:00', 1, 3.0 union all select timestamp_ntz'2024-03-11 00:00:00', 1, 4.0")
    before, found = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            days = tumbling(rows, "ts", "1 day").select(F.unix_timestamp("start").alias("s"), "n").collect()
            runs = sessions(rows, "k", "ts").select(F.unix_timestamp("start").alias("s"), "n").collect()
            found.append((sorted(map(tuple, days)), sorted(map(tuple, runs))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1] == found[2] and [n for _, n in found[0][0]] == [2, 1] and found[0][0][0][0] % 86400 == 0


def test_runs_go_on_over_micro_batches(spark, tmp_path):
    from cadenza import streaming

    rng = random.Random(6)
    flags = {k: [rng.choice([True, True, False, None]) for _ in range(60)] for k in range(4)}
    for part in range(3):
        rows = [(k, f, x[f]) for k, x in flags.items() for f in range(part * 20, part * 20 + 20)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "ep long, f long, flag boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ep long, f long, flag boolean").parquet(str(tmp_path / "in"))
        made = streaming.closed_runs(stream, "ep", "f", "flag").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        made.trigger(availableNow=True).start().awaitTermination()
    want = set()
    for k, x in flags.items():
        for on, run in itertools.groupby(enumerate(x), key=lambda p: bool(p[1])):
            run = [f for f, _ in run]
            if on and run[-1] < 59:
                want.add((k, run[0], run[-1], len(run)))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("ep", "start", "end", "n").collect()} == want


# ---- datasets


def make(spark, root, episodes, fps=10, length=None, **more):
    """A dataset of (id, actions [n x 14])."""
    at, rows = 0, []
    for ep, (key, a) in enumerate(episodes):
        for f, v in enumerate(a):
            rows.append((key, f, at, f / fps, ep % 2, [float(x) for x in v], [float(x) for x in v], at, b"depth"))
            at += 1
    schema = "episode_index long, frame_index long, index long, timestamp float, task_index long, action array<double>, `observation.state` array<double>, extra long, `observation.depth.top` binary"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/data")
    lengths = [(key, ["A"], length if length is not None else len(a)) for key, a in episodes]
    spark.createDataFrame(lengths, "episode_index long, tasks array<string>, length long").write.parquet(f"{root}/meta/episodes")
    spark.createDataFrame([(0, "A"), (1, "B")], "task_index long, task string").write.parquet(f"{root}/meta/tasks.parquet")
    shapes = {"action": [14], "observation.state": [14], "extra": [1]}
    features = {c: {"dtype": "float32", "shape": s} for c, s in shapes.items()} | {"observation.depth.top": {"dtype": "image", "shape": [24, 32, 1]}}
    info = {"fps": fps, "total_episodes": len(episodes), "total_frames": len(rows), "total_tasks": 2, "features": features} | more
    with open(f"{root}/meta/info.json", "w") as f:
        json.dump(info, f)
    return root


def still_moving_still():
    a = np.zeros((50, 14))
    a[5:16, 0], a[16:, 0] = np.arange(11), 10
    return a


def test_trim_whole_dataset(spark, tmp_path):
    source = make(spark, str(tmp_path / "source"), [(3, still_moving_still()), (7, still_moving_still())])
    output = str(tmp_path / "trimmed")
    assert datasets.trim_dataset(spark, source, output)["output_frames"] == 62
    rows = sources.frames(spark, output).orderBy("index").collect()
    assert [r.episode_index for r in rows] == [0] * 31 + [1] * 31 and [r.frame_index for r in rows] == [*range(31)] * 2
    assert [r.extra for r in rows] == [*range(5, 36), *range(55, 86)] and [r["index"] for r in rows] == [*range(62)]
    assert {r.task_index for r in rows[:31]} == {0} and {r.task_index for r in rows[31:]} == {1} and "observation.depth.top" not in rows[0]
    about = sources.episodes(spark, output).orderBy("episode_index").collect()
    assert [(r["trim/source_episode"], r.length, r.dataset_from_index, r.dataset_to_index) for r in about] == [(3, 31, 0, 31), (7, 31, 31, 62)]
    assert datasets.trim_errors(spark, source, output).isEmpty()
    found = datasets.get_json(spark, f"{output}/meta/stats.json")["action"]
    values = np.array([r.action for r in rows])
    assert np.allclose(found["mean"], values.mean(axis=0)) and np.allclose(found["std"], values.std(axis=0)) and found["count"] == [62]
    with pytest.raises(FileExistsError):
        datasets.trim_dataset(spark, source, output)
    with pytest.raises(ValueError, match="inside"):
        datasets.trim_dataset(spark, source, source + "/x")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["source", "trimmed"]
    other = make(spark, str(tmp_path / "other"), [(3, still_moving_still() + 1), (7, still_moving_still())])
    assert {(r.episode_index) for r in datasets.trim_errors(spark, other, output).collect()} == {0}


@pytest.mark.parametrize("fault", ["length", "total", "width"])
def test_datasets_that_do_not_agree_are_refused(spark, tmp_path, fault):
    a = still_moving_still()
    source = make(spark, str(tmp_path / "s"), [(0, a[:, :12] if fault == "width" else a)], length=49 if fault == "length" else None, **({"total_frames": 51} if fault == "total" else {}))
    with pytest.raises(Exception):
        datasets.trim_dataset(spark, source, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists() and [p.name for p in tmp_path.iterdir()] == ["s"]


def two_arms():
    a = np.zeros((240, 14))
    a[:, 0] = np.interp(np.arange(240), [10, 100], [0, 70])
    a[:, 7] = np.interp(np.arange(240), [140, 220], [0, 50])
    return a


def test_retime_validate_and_command_line(spark, tmp_path, capsys):
    source = make(spark, str(tmp_path / "source"), [(4, two_arms()), (9, two_arms())], fps=30)
    output = str(tmp_path / "retimed")
    assert main(["retime", source, output, "--outputs", "3"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["source_episodes"] == 2 and said["output_episodes"] == 6
    rows = sources.frames(spark, output)
    assert rows.count() == said["output_frames"] and rows.where("`retime.left_idle` and `retime.right_idle`").isEmpty()
    assert main(["validate", source, output]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"errors": 0}
    broken = str(tmp_path / "broken")
    bad = rows.withColumn("timestamp", F.when(F.col("index") == 5, F.lit(9.0).cast("float")).otherwise(F.col("timestamp")))
    bad = bad.withColumn("action", F.when(F.col("index") == 7, F.transform("action", lambda x: x + 1)).otherwise(F.col("action")))
    bad.write.parquet(f"{broken}/data")
    for t in ("episodes", "tasks"):
        spark.read.parquet(f"{output}/meta/{t}").write.parquet(f"{broken}/meta/{t}")
    datasets.put_json(spark, f"{broken}/meta/info.json", datasets.get_json(spark, f"{output}/meta/info.json"))
    found = {(r.episode_index, r.frame_index): r.why for r in datasets.retime_errors(spark, source, broken).collect()}
    assert sorted(found.values()) == [["timestamp"], ["values"]] and set(found) == {(0, 5), (0, 7)}
    assert main(["validate", source, broken]) == 1
    assert main(["trim", source, str(tmp_path / "x"), "--analyse"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["episodes"] == 2


def test_an_empty_dataset(spark, tmp_path):
    source = make(spark, str(tmp_path / "source"), [])
    assert datasets.trim_dataset(spark, source, str(tmp_path / "t")) == {"source_frames": 0, "output_frames": 0, "episodes": 0}


def test_publication_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sources.publish(spark.range(3), path)
    sources.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(ZeroDivisionError):
        datasets.publish(spark, str(tmp_path / "new"), lambda stage: 1 / 0)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


@pytest.mark.parametrize("a,b,want", [(2**53 + 1, 1, 2**53 + 1), (7, 2, 4), (5, 2, 3), (1, 3, 0), (2, 3, 1)])
def test_half_up_in_integers(spark, a, b, want):
    from cadenza import functions as X

    assert spark.createDataFrame([(a, b)], "a long, b long").select(X.half_up_div(F.col("a"), F.col("b"))).first()[0] == want


def test_slugs_match_as_a_whole(spark):
    from cadenza import functions as X

    got = spark.createDataFrame([("abc-1",), ("abc\n",), ("A",), ("",), (None,)], "s string").select(X.is_slug(F.col("s"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False]
