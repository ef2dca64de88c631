"""Pairing predictions with ground truth: one-to-one people matching and time joins."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assignment import assign_many
from ..functions.batches import whole_tables
from ..functions.joins import by_exchange
from ..functions.ordered import Ordered, lag
from ..schema import (AWAY, BALL, GOALKEEPER, HOME, OFFICIAL, OTHER, PLAYER, PLAYING, REFEREE, UNKNOWN,
                      finite)

PAIRS = "match_id string, frame_idx int, gt_track int, pred_track int, g int, p int, dist double"
# Roles and teams cross to Python as one small number and come back as text.
ROLES, TEAM_NAMES = (PLAYER, GOALKEEPER, REFEREE, BALL, OTHER), (HOME, AWAY, OFFICIAL, UNKNOWN)
FAR = 1e6
FRAMES_AT_ONCE = 512          # fixed value: frames whose distances are held together
FRAME = ["match_id", "frame_idx"]


def _prices(x, y, r0, rn, c0, cn, cols):
    """Prices of predictions to start from, in frames of as many predictions as people, else zeros.

    With all moved alike by t, the least sum of distances pairs each with its own, and lengths along t are prices of that pairing."""
    x0, y0 = np.append(0.0, x.cumsum()), np.append(0.0, y.cumsum())
    tx, ty = ((s[c0 + cn] - s[c0]) / cn - (s[r0 + rn] - s[r0]) / rn for s in (x0, y0))
    t = np.hypot(tx, ty)
    t = np.where((rn == cn) & (t > 0), t, np.inf)
    return x[cols] * (tx / t)[:, None] + y[cols] * (ty / t)[:, None]


def _pair_frames(x, y, start, mid, end, gate: float, gate_first: bool):
    """Row pairs (gt row, pred row, distance) of many frames: gt rows start..mid, pred rows mid..end."""
    ng, np_ = mid - start, end - mid
    flip = ng > np_                       # rows of a problem are its smaller side
    r0, rn = np.where(flip, mid, start), np.minimum(ng, np_)
    c0, cn = np.where(flip, start, mid), np.maximum(ng, np_)
    ri, ci = np.arange(rn.max()), np.arange(cn.max())
    rows, cols = np.minimum(r0[:, None] + ri, len(x) - 1), np.minimum(c0[:, None] + ci, len(x) - 1)
    d = np.hypot(x[rows][:, :, None] - x[cols][:, None, :], y[rows][:, :, None] - y[cols][:, None, :])
    d[np.broadcast_to((ci >= cn[:, None])[:, None, :], d.shape)] = np.inf
    # Frames without any two in reach have no pair, whatever the assignment.
    some = ((d <= gate) & (ri < rn[:, None])[:, :, None]).any(axis=(1, 2))
    flip, r0, rn, c0, cn, rows, cols, d = (a[some] for a in (flip, r0, rn, c0, cn, rows, cols, d))
    cost = np.where((d <= gate) | (d == np.inf), d, FAR) if gate_first else d
    got = assign_many(cost, rn, _prices(x, y, r0, rn, c0, cn, cols))
    b, r = np.nonzero(got >= 0)
    c = got[b, r]
    dist = d[b, r, c]
    near = dist <= gate
    b, one, two, dist = b[near], rows[b, r][near], cols[b, c][near], dist[near]
    return np.where(flip[b], two, one), np.where(flip[b], one, two), dist


def _located(df: DataFrame, roles) -> DataFrame:
    df = df.filter(finite(F.col("x")) & finite(F.col("y")))
    return df.filter(F.col("role").isin(*roles)) if roles else df


def match_people(gt: DataFrame, pred: DataFrame, max_dist: float = 2.0, roles=PLAYING,
                 gate_first: bool = False) -> DataFrame:
    """Minimum-distance one-to-one pairs per frame, as rows with both sides' attributes.

    With `gate_first` False the assignment ignores the gate and far pairs are dropped after it;
    with True they are ruled out before it, which can give other pairs. Both inputs share one
    exchange by (match, frame); tasks then stream sorted Arrow batches, a frame at a time."""
    code = (F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) * 8
            + F.array_position(F.array(*[F.lit(t) for t in TEAM_NAMES]), F.col("team"))).cast("int")
    cols = [F.col(c).cast(t).alias(c) for c, t in (("match_id", "string"), ("frame_idx", "int"), ("track_id", "int"))] + [
        code.alias("code"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    both = (_located(gt, roles).select(*cols, F.lit(0).alias("side"))
            .unionByName(_located(pred, roles).select(*cols, F.lit(1).alias("side"))))

    def solve(batches):
        for table, cuts in whole_tables(batches, FRAME):
            x, y, side = (table.column(c).to_numpy() for c in ("x", "y", "side"))
            preds = np.append(0, side.cumsum())
            start, end = cuts[:-1], cuts[1:]
            mid = end - (preds[end] - preds[start])
            both_there = np.flatnonzero((start < mid) & (mid < end))
            for k in range(0, len(both_there), FRAMES_AT_ONCE):
                f = both_there[k:k + FRAMES_AT_ONCE]
                g_rows, p_rows, dist = _pair_frames(x, y, start[f], mid[f], end[f], max_dist, gate_first)
                g, p = table.take(pa.array(g_rows)), table.take(pa.array(p_rows))
                yield from pa.table([*(g.column(c) for c in ("match_id", "frame_idx", "track_id")), p.column("track_id"), g.column("code"),
                                     p.column("code"), pa.array(dist)], ["match_id", "frame_idx", "gt_track", "pred_track", "g", "p", "dist"]).to_batches()
    # One number tells frames apart; the sort compares little else.
    m = (both.repartition(*FRAME).sortWithinPartitions(F.xxhash64(*FRAME), *FRAME, "side", "track_id", "x", "y")
         .mapInArrow(solve, PAIRS))
    name = lambda values, k: F.try_element_at(F.array(*[F.lit(v) for v in values]), k.cast("int"))
    role, team = (lambda c: name(ROLES, F.expr(f"{c} div 8"))), (lambda c: name(TEAM_NAMES, F.col(c) % 8))
    return m.select("match_id", "frame_idx", "gt_track", "pred_track", role("g").alias("gt_role"), role("p").alias("pred_role"),
                    team("g").alias("gt_team"), team("p").alias("pred_team"), "dist")


def match_people_gated(gt: DataFrame, pred: DataFrame, max_dist: float = 5.0, roles=PLAYING) -> DataFrame:
    return match_people(gt, pred, max_dist, roles, gate_first=True)


def id_switches(pairs: DataFrame) -> DataFrame:
    """Changes of predicted track along each ground-truth person, per match."""
    o = Ordered(pairs, ["match_id", "gt_track"], ["frame_idx"]).add(_p=lag(F.col("pred_track")))
    return o.done().groupBy("match_id").agg(
        F.count(F.when(F.col("_p") != F.col("pred_track"), 1)).alias("id_switches"),
        F.count_distinct("gt_track").alias("gt_players_seen"))


# ------------------------------------------------------------------ time joins

CELL = 8       # fixed value: tolerances in a time cell


def _near(frames: DataFrame, readings: DataFrame, tol_s: float, by: list[str]):
    """Frames with the readings within the tolerance, met in time cells: a frame is in one cell, a reading in those it reaches.

    Rows stay dealt by (*by, _cell), so grouping them by frame within its cell asks for no further exchange."""
    cell = lambda c: F.floor(c / F.lit(tol_s * CELL))
    # Rounding keeps a reading exactly at the tolerance inside it; the margin covers that.
    reach = tol_s * (1 + 1e-3) + 1e-6
    cells = F.sequence(cell(F.col("ts") - reach), cell(F.col("ts") + reach))
    r = readings.withColumn("_cell", F.explode(cells))
    near = frames.withColumn("_cell", cell(F.col("t"))).join(by_exchange(r), by + ["_cell"])
    return near.withColumn("_dt", F.round(F.abs(F.col("ts") - F.col("t")), 9)).filter(F.col("_dt") <= tol_s)


def asof_nearest(frames: DataFrame, readings: DataFrame, tol_s: float = 0.05, by=("match_id",)) -> DataFrame:
    """Each frame (columns *by, frame_idx, t) with the nearest reading time within the tolerance."""
    times = readings.select(*by, "ts").distinct()
    c = _near(frames, times, tol_s, list(by))
    return c.groupBy(*by, "_cell", "frame_idx", "t").agg(F.min_by("ts", F.struct("_dt", "ts")).alias("ts")).drop("_cell")


def interval_join_closest(frames: DataFrame, readings: DataFrame, tol_s: float = 0.05, by=("match_id",)) -> DataFrame:
    """Per frame and tag, the reading closest in time within the tolerance."""
    c = _near(frames, readings, tol_s, list(by))
    rest = [x for x in readings.columns if x not in by and x not in ("tag_id", "ts")]
    # The frame comes first: rows are sorted by these columns, and it settles most comparisons at once.
    return c.groupBy("frame_idx", "tag_id", "t", "_cell", *by).agg(
        F.min(F.struct("_dt", "ts", *rest)).alias("_r")).select(
        *by, "frame_idx", "t", "tag_id", "_r.ts", *[f"_r.{x}" for x in rest])
