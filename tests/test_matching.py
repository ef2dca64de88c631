"""Assignment by brute force, people matching, tracking scores, suppression."""
import itertools

import numpy as np
import pandas as pd
import pytest

from matchspark.functions.assignment import assign, assign_many
from matchspark.operators import matching as M
from matchspark.operators.detections import suppress
from matchspark.operators.matching import match_people, match_people_gated
from matchspark.operators.scoring import position_summary, tracking_score


def brute(c):
    n, m = c.shape
    if n > m:
        return brute(c.T)
    return min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for k in range(400):
        c = rng.random((int(rng.integers(1, 6)), int(rng.integers(1, 6))))
        c = np.round(c * 3) if k % 3 == 0 else c
        r, q = assign(c)
        assert len(set(q)) == len(q) == len(set(r)) == min(c.shape) and abs(c[r, q].sum() - brute(c)) < 1e-9
    stack = rng.random((50, 4, 6))
    rows = rng.integers(1, 5, 50)
    got = assign_many(stack, rows)
    for c, n, g in zip(stack, rows, got):
        assert abs(c[np.arange(n), g[:n]].sum() - brute(c[:n])) < 1e-9 and (g[n:] == -1).all()


def people(rng, frames, lo, hi):
    rows = [("m", f, i, "player", "home", float(x), float(y)) for f in range(frames)
            for i, (x, y) in enumerate(rng.uniform(0, 8, (int(rng.integers(lo, hi)), 2)))]
    return pd.DataFrame(rows, columns=["match_id", "frame_idx", "track_id", "role", "team", "x", "y"])


@pytest.mark.parametrize("gated", [False, True])
def test_people_matching_by_brute_force(spark, gated):
    rng = np.random.default_rng(1)
    g, p = people(rng, 60, 0, 6), people(rng, 60, 0, 6)
    got = (match_people_gated if gated else match_people)(spark.createDataFrame(g), spark.createDataFrame(p), 2.0).toPandas()
    for f in range(60):
        a, b = g[g.frame_idx == f][["x", "y"]].to_numpy(), p[p.frame_idx == f][["x", "y"]].to_numpy()
        o = got[got.frame_idx == f]
        if not len(a) or not len(b):
            assert o.empty
            continue
        d = np.linalg.norm(a[:, None] - b[None], axis=-1)
        if gated:
            n = len(o)
            assert abs(o["dist"].sum() + 1e6 * (min(d.shape) - n) - brute(np.where(d <= 2, d, 1e6))) < 1e-6
        assert (o["dist"] <= 2).all() and o["gt_track"].is_unique and o["pred_track"].is_unique
        for r in o.itertuples():
            assert abs(d[r.gt_track, r.pred_track] - r.dist) < 1e-9


def test_far_pairs_are_dropped_after_or_before(spark):
    row = lambda i, x: ("m", 0, i, "player", "home", x, 0.0)
    cols = "match_id string, frame_idx int, track_id int, role string, team string, x double, y double"
    g = spark.createDataFrame([row(0, 0.0), row(1, 3.0)], cols)
    p = spark.createDataFrame([row(0, 1.6), row(1, -4.0)], cols)
    # Without a gate 0-(-4) and 3-1.6 is cheapest; with it the same near pair survives.
    assert [(r.gt_track, r.pred_track) for r in match_people(g, p, 2.0).collect()] == [(1, 0)]
    assert [(r.gt_track, r.pred_track) for r in match_people_gated(g, p, 2.0).collect()] == [(1, 0)]


def test_injected_error_is_recovered(spark, mode):
    rng = np.random.default_rng(0)
    pos, vel, gt, pr = rng.uniform([-40, -25], [40, 25], (11, 2)), rng.normal(0, 1.2, (11, 2)), [], []
    for f in range(300):
        pos = pos + vel / 30
        for i in range(11):
            gt.append(("m", f, i, "player", "home", *map(float, pos[i])))
            if rng.random() >= .2:
                off = rng.normal(0, 1, 2)
                pr.append(("m", f, 500 + i, "player", "home", *map(float, pos[i] + .8 * off / np.linalg.norm(off))))
    cols = "match_id string, frame_idx int, track_id int, role string, team string, x double, y double"
    g, p = spark.createDataFrame(gt, cols), spark.createDataFrame(pr, cols)
    s = tracking_score(g, p).first()
    assert abs(s.err_median_m - .8) < .05 and abs(s.recall - .8) < .03 and s.band == "formation"
    pooled = position_summary(match_people(g, p, 5.0), g, by=()).first()
    assert abs(pooled.pos_err_median_m - .8) < .05


def test_suppression(spark):
    rows = [("m", 0, "a", 0, 0.0, 0.0, 10.0, 10.0, .9), ("m", 0, "a", 1, 1.0, 0.0, 10.0, 10.0, .8), ("m", 0, "a", 2, 20.0, 0.0, 10.0, 10.0, .3),
            ("m", 0, "b", 3, 0.0, 0.0, 10.0, 10.0, .5)]
    df = spark.createDataFrame(rows, "match_id string, frame_idx int, cls_name string, det int, bbox_x double, bbox_y double, bbox_w double, bbox_h double, conf double")
    assert sorted(r.det for r in suppress(df).collect()) == [0, 2, 3]


def test_nearest_readings_by_cells(spark):
    """Against plain Python on either side of the cells' borders, and without an exchange of the pairs."""
    rng = np.random.default_rng(4)
    edge = [0.4 * k + d for k in range(-2, 4) for d in (-0.05, -0.0500001, 0.0, 0.05, 0.0500001)]
    times = [("m", k, float(t)) for k, t in enumerate([*edge, *rng.uniform(-2, 3, 60)])]
    reads = [(m, float(t), tag, float(tag)) for m in ("m", "n") for tag in (1, 2) for t in [*edge, *rng.uniform(-2, 3, 40)]]
    frames = spark.createDataFrame(times, "match_id string, frame_idx int, t double")
    seen = spark.createDataFrame([*reads, ("m", None, 1, 0.0), ("m", float("nan"), 1, 0.0), ("m", float("inf"), 1, 0.0)],
                                 "match_id string, ts double, tag_id int, x double")
    want = {}
    for _, f, t in times:
        for m, ts, tag, _ in reads:
            d = round(abs(ts - t), 9)
            if m == "m" and d <= 0.05:
                want[f, tag] = min(want.get((f, tag), (d, ts)), (d, ts))
    df = M.interval_join_closest(frames, seen)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan
    assert {(r.frame_idx, r.tag_id): r.ts for r in df.collect()} == {k: ts for k, (_, ts) in want.items()}
    best = {}
    for (f, _), v in want.items():
        best[f] = min(best.get(f, v), v)
    assert {r.frame_idx: r.ts for r in M.asof_nearest(frames, seen).collect()} == {f: ts for f, (_, ts) in best.items()}


def test_prices_to_start_from_do_not_change_the_optimum():
    rng = np.random.default_rng(3)
    cost = np.round(rng.random((60, 5, 5)) * 4, 1)
    got = assign_many(cost, np.full(60, 5), rng.normal(0, 3, (60, 5)))
    for c, g in zip(cost, got):
        assert sorted(g) == list(range(5)) and abs(c[np.arange(5), g].sum() - brute(c)) < 1e-9


@pytest.mark.parametrize("gate_first", [False, True])
def test_frames_moved_alike_need_no_search(monkeypatch, gate_first):
    """A whole cast moved by 4 m once took as many searches as people; one moved out of reach has no pair and needs none at all."""
    rng = np.random.default_rng(4)
    g = rng.uniform(-40, 40, (50, 22, 2))
    seen, solve = [], M.assign_many
    monkeypatch.setattr(M, "assign_many", lambda cost, rows, prices: seen.append((cost, prices)) or solve(cost, rows, prices))
    for shift, n in ((4.0, 50), (300.0, 0)):
        xy = np.concatenate([g, g + [shift, 0.5]], axis=1).reshape(-1, 2)
        start = np.arange(50) * 44
        a, b, d = M._pair_frames(xy[:, 0], xy[:, 1], start, start + 22, start + 44, 5.0, gate_first)
        cost, prices = seen.pop()
        assert len(cost) == n and len(a) == 22 * n and (b - a == 22).all()
        assert ((cost - prices[:, None]).argmin(axis=2) == np.arange(22)).all()


def test_whole_tables_keep_a_group_over_many_batches():
    import pyarrow as pa
    from matchspark.functions.batches import whole_tables
    rows = pa.table({"k": ["a"] * 7 + ["b"] + [None] * 2 + ["c"] * 4, "v": list(range(14))})
    for size, least in ((1, 1), (2, 3), (3, 1), (5, 6), (14, 100)):
        got = [(t.column("k")[i].as_py(), t.column("v").to_pylist()[i:j]) for t, cuts in whole_tables(iter(rows.to_batches(size)), ["k"], least)
               for i, j in zip(cuts[:-1], cuts[1:])]
        assert got == [("a", list(range(7))), ("b", [7]), (None, [8, 9]), ("c", [10, 11, 12, 13])]


def test_distances_are_written_once(spark):
    """Three aggregates each found the pairs anew."""
    p = spark.createDataFrame([("m", 0, 1, "player", "home", 0.0, 0.0)], "match_id string, frame_idx int, track_id int, role string, team string, x double, y double")
    plan = position_summary(match_people_gated(p, p), p)._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and position_summary(match_people_gated(p, p), p).first().recall_2m == 1.0
