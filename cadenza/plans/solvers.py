"""Solvers of one episode, or one small decision, at a time; groups are independent.

Nulls aren't expected in keys and frames; a group without candidates, cells or frames has no row; ties are broken as each docstring says; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest_schedule(n: int, m: int, safe: Callable[[int, int, int, int], bool], gate: Callable[[int, int], bool] = lambda i, j: True, left_priority: bool = True) -> list[tuple[int, int]] | None:
    """The shortest monotone path of two clocks from (0, 0) to (n - 1, m - 1); None if there is none.

    An edge advances one clock or both by one frame. With ``left_priority`` left only waits once it is at its end.
    Best-first with the frames that are left as the bound.
    """
    goal = n - 1, m - 1
    if not (gate(0, 0) and gate(*goal) and safe(*goal, *goal)):
        return None
    cost, came, queue = {(0, 0): 0}, {}, [(max(goal), 0, 0)]
    while queue:
        bound, i, j = heapq.heappop(queue)
        here = cost[i, j]
        if bound > here + max(n - 1 - i, m - 1 - j):
            continue
        if (i, j) == goal:
            path = [goal]
            while path[-1] in came:
                path.append(came[path[-1]])
            return path[::-1]
        for a, b in ((i + 1, j + 1), (i + 1, j), (i, j + 1)):
            if a >= n or b >= m or (a == i and left_priority and i < n - 1) or not gate(a, b):
                continue
            if here + 1 < cost.get((a, b), 1 << 60) and safe(i, j, a, b):
                cost[a, b], came[a, b] = here + 1, (i, j)
                heapq.heappush(queue, (here + 1 + max(n - 1 - a, m - 1 - b), a, b))
    return None


def wave(ok: np.ndarray, left_waits: np.ndarray | None = None, right_waits: np.ndarray | None = None) -> np.ndarray:
    """Output frames, at least, from (0, 0) to each state (i, j) of two clocks; -1 where none leads. ``ok``: states that may be entered.

    Each frame, both advance or one does while the other waits, where it may (``left_waits``, ``right_waits``: by state; everywhere if None). All states that are
    as far are one boolean array, so a grid takes as many array steps as its longest way.
    """
    n, m = ok.shape
    far = np.full((n, m), -1, np.int32)
    front = np.zeros((n, m), bool)
    front[0, 0] = ok[0, 0]
    for steps in range(n + m):
        if not front.any():
            break
        far[front] = steps
        new = np.zeros((n, m), bool)
        new[1:, 1:] |= front[:-1, :-1]
        new[1:, :] |= (front if right_waits is None else front & right_waits)[:-1, :]
        new[:, 1:] |= (front if left_waits is None else front & left_waits)[:, :-1]
        front = new & ok & (far < 0)
    return far


def shortest_path(ok: np.ndarray, left_waits: np.ndarray | None = None, right_waits: np.ndarray | None = None, prefer: str = "left") -> tuple[list[tuple[int, int]] | None, str | None]:
    """(a shortest path over ``wave``, None) or (None, why there is none). Of equal ways both clocks advance where they can, and the ``prefer``-red side waits later."""
    n, m = ok.shape
    if not ok[0, 0] or not ok[-1, -1]:
        return None, "start" if not ok[0, 0] else "end"
    far = wave(ok, left_waits, right_waits)
    if far[-1, -1] < 0:
        return None, "no path"
    path = [(n - 1, m - 1)]
    while path[-1] != (0, 0):
        i, j = path[-1]
        one, other = (i, j - 1, left_waits), (i - 1, j, right_waits)
        for a, b, may in ((i - 1, j - 1, None), *((one, other) if prefer == "left" else (other, one))):
            if a >= 0 and b >= 0 and far[a, b] == far[i, j] - 1 and (may is None or may[a, b]):
                path.append((a, b))
                break
    return path[::-1], None


def _packed(rows: list[tuple], *kinds: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def _grids(cells: DataFrame) -> DataFrame:
    """ep, n, m and the places i * m + j of blocked cells: one array an episode."""
    bad = F.when(F.col("blocked"), F.col("i") * F.col("m") + F.col("j"))
    grids = cells.groupBy("ep").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.collect_list(bad).alias("bad"))
    return grids.select("ep", F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), "bad")


def _open(n: int, m: int, blocked: list[int]) -> np.ndarray:
    ok = np.ones(n * m, bool)
    ok[blocked] = False
    return ok.reshape(n, m)


def frontiers(cells: DataFrame, most: int = 4) -> DataFrame:
    """Of episodes without a schedule (``cells`` as for ``schedules``): the ``most`` reachable states that are furthest (i + j, then i), and what stops each move from there.

    ep, place, i, j, both, left, right: ``free``, ``blocked`` or ``outside`` for the move of both clocks and of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ep, n, m, blocked in zip(*(c.to_pylist() for c in batch.columns)):
                ok = _open(n, m, blocked)
                far = wave(ok)
                if far[-1, -1] >= 0:
                    continue
                states = sorted(zip(*(x.tolist() for x in np.nonzero(far >= 0))), key=lambda s: (-sum(s), -s[0]))[:most]
                for place, (i, j) in enumerate(states):
                    moves = ("outside" if a >= n or b >= m else "free" if ok[a, b] else "blocked" for a, b in ((i + 1, j + 1), (i + 1, j), (i, j + 1)))
                    rows.append((ep, place, i, j, *moves))
            yield _packed(rows, *[pa.int64()] * 4, *[pa.string()] * 3, names=["ep", "place", "i", "j", "both", "left", "right"])

    return _grids(cells).mapInArrow(run, "ep long, place long, i long, j long, both string, left string, right string")


def schedules(cells: DataFrame) -> DataFrame:
    """Per ep of ``cells`` (ep, n, m, i, j, blocked): the steps of the shortest schedule that enters no blocked cell, or why there is none (start, end, no path).

    Only blocked cells travel, as one array an episode; many episodes go through a task's Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ep, n, m, blocked in zip(*(c.to_pylist() for c in batch.columns)):
                ok = _open(n, m, blocked)
                far = wave(ok)[-1, -1]
                why = None if far >= 0 else "start" if not ok[0, 0] else "end" if not ok[-1, -1] else "no path"
                rows.append((ep, far >= 0, int(far) if far >= 0 else None, why))
            yield _packed(rows, pa.int64(), pa.bool_(), pa.int64(), pa.string(), names=["ep", "feasible", "steps", "why"])

    return _grids(cells).mapInArrow(run, "ep long, feasible boolean, steps long, why string")


def static_spans(values: np.ndarray, limits: np.ndarray, intervals: Iterable[tuple[int, int]], least: int, guard: int) -> np.ndarray:
    """Kept frames: within each interval, greedy spans whose range stays within ``limits`` lose what lies beyond ``guard`` frames of their ends, if they are long enough."""
    kept = np.ones(len(values), bool)
    for begin, end in intervals:
        at = begin
        while at < end:
            part = values[at:end]
            wide = (np.maximum.accumulate(part) - np.minimum.accumulate(part) > limits).any(axis=1)
            n = int(wide.argmax()) if wide.any() else len(part)
            if n >= max(least, 2 * guard + 1):
                kept[at + guard : at + n - guard] = False
            at += n
    return np.flatnonzero(kept)


def kept_frames(frames: DataFrame, limit: float, least: int, guard: int) -> DataFrame:
    """Per ep of ``frames`` (ep, f, v): frames that stay when static spans are shortened. An episode is one array."""
    tracks = frames.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("t"))
    tracks = tracks.select("ep", F.transform("t", lambda x: x["f"]).alias("f"), F.transform("t", lambda x: x["v"]).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ep, f, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                values = np.asarray(v.values, float)
                kept = static_spans(values[:, None], np.array([limit]), [(0, len(values))], least, guard)
                yield pa.record_batch({"ep": np.full(len(kept), ep, np.int64), "f": np.asarray(f.values, np.int64)[kept]})

    return tracks.mapInArrow(run, "ep long, f long")


def diverse(candidates: list[dict], apart: float, most: int = 6) -> list[dict]:
    """Best first, without those within ``apart`` frames of a kept one of the same side at both pickup and release."""
    out: list[dict] = []
    for c in sorted(candidates, key=lambda c: -c["score"]):
        if len(out) < most and not any(c["side"] == x["side"] and abs(c["pickup"] - x["pickup"]) < apart and abs(c["release"] - x["release"]) < apart for x in out):
            out.append(c)
    return out


def best_subset(options: list[dict], most_per_side: int = 2) -> list[dict]:
    """The options that cover most objects, and of those with the greatest score: one an object, few a side, none of a side overlapping in time."""
    objects = sorted({c["object"] for c in options})
    best: tuple[int, float, list[dict]] = 0, 0.0, []

    def go(k: int, chosen: list[dict], score: float) -> None:
        nonlocal best
        if (len(chosen), score) > best[:2]:
            best = len(chosen), score, chosen
        if k == len(objects) or len(chosen) + len(objects) - k < best[0]:
            return
        for c in (c for c in options if c["object"] == objects[k]):
            same = [x for x in chosen if x["side"] == c["side"]]
            if len(same) < most_per_side and all(x["release"] < c["grasp"] or c["release"] < x["grasp"] for x in same):
                go(k + 1, [*chosen, c], score + c["score"])
        go(k + 1, chosen, score)

    go(0, [], 0.0)
    return sorted(best[2], key=lambda c: c["pickup"])


COLUMNS = "ep long, object long, side string, grasp long, pickup long, release long, score double"


def top_diverse(candidates: DataFrame, apart: float, most: int = 6) -> DataFrame:
    """``diverse`` for each (ep, object)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "pickup", "release"], ascending=[False, True, True])
        return pd.DataFrame(diverse(pdf.to_dict("records"), apart, most), columns=pdf.columns)

    return candidates.select(*[c.split()[0] for c in COLUMNS.split(", ")]).groupBy("ep", "object").applyInPandas(solve, COLUMNS)


def selected(candidates: DataFrame, apart: float, most_per_side: int = 2) -> DataFrame:
    """``best_subset`` of the diverse candidates of each ep."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_subset(pdf.sort_values(["object", "score", "pickup"]).to_dict("records"), most_per_side), columns=pdf.columns)

    return top_diverse(candidates, apart).groupBy("ep").applyInPandas(solve, COLUMNS)


def assign(cost: np.ndarray, most: float = 2.5) -> list[tuple[int, int]]:
    """Pairs (row, column) of the cheapest one-to-one assignment, without pairs above ``most``.

    Rows enter one by one, each along the cheapest alternating path under prices of rows and columns: n * n * m steps.
    """
    n, m = cost.shape
    if n > m:
        return sorted((i, j) for j, i in assign(cost.T, most))
    price, owner = np.zeros(m), np.full(m, -1)
    pays = np.zeros(n)
    for row in range(n):
        far, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, length = row, -1, 0.0
        while True:
            over = length + cost[i] - pays[i] - price
            better = ~done & (over < far)
            far[better], via[better] = over[better], j
            j = int(np.where(done, np.inf, far).argmin())
            length, done[j] = far[j], True
            if owner[j] < 0:
                break
            i = owner[j]
        pays[row] += length
        for k in np.flatnonzero(done):
            if owner[k] >= 0:
                pays[owner[k]] += length - far[k]
            price[k] -= length - far[k]
        while j >= 0:
            owner[j] = row if via[j] < 0 else owner[via[j]]
            j = int(via[j])
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0 and cost[i, j] <= most)


def assignments(costs: DataFrame, most: float = 2.5) -> DataFrame:
    """``assign`` for each ep of ``costs`` (ep, a, b, cost: every pair of the ep's few items)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="a", columns="b", values="cost").sort_index(axis=0).sort_index(axis=1)
        found = assign(table.to_numpy(float), most)
        return pd.DataFrame([(pdf.ep.iloc[0], table.index[i], table.columns[j], table.iat[i, j]) for i, j in found], columns=["ep", "a", "b", "cost"])

    return costs.select("ep", "a", "b", "cost").groupBy("ep").applyInPandas(solve, "ep long, a long, b long, cost double")


def peak_order(height: np.ndarray, speed: np.ndarray, within: float) -> list[int]:
    """All frames in the order in which peaks are taken: each time the slowest, then first, of those within ``within`` of what is highest then."""
    falling, gone, band, out = np.argsort(-height, kind="stable"), np.zeros(len(height), bool), [], []
    top = seen = 0
    while len(out) < len(height):
        while gone[falling[top]]:
            top += 1
        while seen < len(falling) and height[falling[seen]] >= height[falling[top]] - within:
            heapq.heappush(band, (speed[falling[seen]], int(falling[seen])))
            seen += 1
        at = heapq.heappop(band)[1]
        gone[at] = True
        out.append(at)
    return out


def ranked_peaks(frames: DataFrame, within: float) -> DataFrame:
    """``peak_order`` for each ep of ``frames`` (ep, f, height, speed): ep, f, place."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("f")
        order = peak_order(pdf.height.to_numpy(float), pdf.speed.to_numpy(float), within)
        return pd.DataFrame({"ep": pdf.ep.iloc[0], "f": pdf.f.to_numpy()[order], "place": np.arange(len(order))})

    return frames.select("ep", "f", "height", "speed").groupBy("ep").applyInPandas(solve, "ep long, f long, place long")
