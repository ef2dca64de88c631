"""Sparse assignment, components, and stitching over many partitions."""
import itertools

import numpy as np
import pandas as pd

from matchspark.functions.assignment import assign_edges
from matchspark.functions.batches import whole_groups
from matchspark.functions.components import components
from matchspark.operators import identity as I


def best(a, b, cost, skip):
    """Least cost over all one-to-one choices, by trying them all."""
    low = np.inf
    for n in range(len(a) + 1):
        for pick in itertools.combinations(range(len(a)), n):
            if len({a[k] for k in pick}) == n == len({b[k] for k in pick}):
                low = min(low, sum(cost[k] for k in pick) + skip * (len(set(a)) - n))
    return low


def test_sparse_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for k in range(300):
        full = list(itertools.product(range(4), range(4)))
        pick = rng.permutation(len(full))[:int(rng.integers(1, 10))]
        a, b = np.array([full[i] for i in sorted(pick)]).T
        cost = np.round(rng.random(len(a)) * (3 if k % 2 else 1), 0 if k % 3 == 0 else 6)
        for skip in (1e6, 0.5):
            got = assign_edges(a, b, cost, skip)
            assert len(set(a[got])) == len(got) == len(set(b[got]))
            assert abs(cost[got].sum() + skip * (len(set(a)) - len(got)) - best(a, b, cost, skip)) < 1e-6
    assert len(assign_edges(np.array([], int), np.array([], int), np.array([]))) == 0


def test_sparse_assignment_of_a_long_chain():
    n = 20_000
    a, b = np.repeat(np.arange(n), 2), (np.arange(n)[:, None] + [0, 1]).ravel()
    got = assign_edges(a, b, np.random.default_rng(0).random(2 * n))
    assert len(got) == n == len(set(b[got]))


def test_components_of_chains_rings_and_loops(spark):
    edges = [("m", i, i + 1) for i in range(0, 60) if i != 30] + [("m", 100, 101), ("m", 101, 102), ("m", 102, 100), ("m", 7, 7), ("m", 200, 200),
             ("n", 1, 2), ("n", 1, None)]
    got = {(r.match_id, r.node): r.component for r in components(spark.createDataFrame(edges, "match_id string, a int, b int"), ["match_id"]).collect()}
    want = {**{("m", i): 0 if i <= 30 else 31 for i in range(61)}, **{("m", i): 100 for i in (100, 101, 102)}, ("m", 200): 200, ("n", 1): 1, ("n", 2): 1}
    assert got == want
    empty = spark.createDataFrame([], "match_id string, a int, b int")
    assert components(empty, ["match_id"]).count() == 0


def test_whole_groups_keeps_a_group_over_many_batches():
    rows = pd.DataFrame({"k": ["a"] * 7 + ["b"] + ["c"] * 4, "v": range(12)})
    for size in (1, 2, 3, 5, 12):
        got = [(d["k"].iloc[i], list(d["v"].iloc[i:j])) for d, cuts in whole_groups((rows.iloc[i:i + size] for i in range(0, 12, size)), ["k"])
               for i, j in zip(cuts[:-1], cuts[1:])]
        assert got == [("a", list(range(7))), ("b", [7]), ("c", [8, 9, 10, 11])]


def test_stitching_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows, tid = [], 0
    for runner in range(4):
        f = 0
        while f < 300:
            stop = f + int(rng.integers(8, 30))
            for g in range(f, stop):
                rows.append(("m", g, tid, "player", "unknown", 0.2 * g + float(rng.normal(0, 0.05)), 2.0 * runner))
            tid, f = tid + 1, stop + int(rng.integers(1, 20))
    t = spark.createDataFrame(rows, "match_id string, frame_idx int, track_id int, role string, team string, x double, y double")

    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = I.stitch_tracklets(I.build_tracklets(t.repartition(parts))).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return sorted((r.tracklet_id, tuple(r.track_ids), r.start, r.end, r.n_frames) for r in got)
    one = run(1)
    assert one == run(7) and len(one) < tid and sorted(i for r in one for i in r[1]) == list(range(tid))


def fragments(spark, seed):
    """Fragments of five runners in each of three matches, with gaps."""
    rng = np.random.default_rng(seed)
    rows, tid = [], 0
    for m, runner in itertools.product("mno", range(5)):
        f = 0
        while f < 250:
            stop = f + int(rng.integers(5, 30))
            rows += [(m, g, tid, "player", "unknown", 0.2 * g + float(rng.normal(0, 0.3)), 1.5 * runner) for g in range(f, stop)]
            tid, f = tid + 1, stop + int(rng.integers(1, 25))
    return spark.createDataFrame(rows, "match_id string, frame_idx int, track_id int, role string, team string, x double, y double")


def test_matches_solved_whole_or_by_components_agree(spark, monkeypatch):
    t = I.build_tracklets(fragments(spark, 5)).cache()
    got = []
    for edges in (1 << 20, 0):
        monkeypatch.setattr(I, "EDGES_PER_TASK", edges)
        got.append(sorted((r.match_id, r.tracklet_id, tuple(r.track_ids), r.n_frames) for r in I.stitch_tracklets(t).collect()))
    assert got[0] == got[1] and len(got[0]) < t.count()


def test_stitching_runs_no_rounds_for_matches_that_fit_a_task(spark, monkeypatch):
    """Rounds of joins over tiny tables once took most of the time."""
    seen, cut = [], I.cut_lineage
    monkeypatch.setattr(I, "cut_lineage", lambda df: seen.append(0) or cut(df))
    monkeypatch.setattr("matchspark.functions.components.cut_lineage", lambda df: seen.append(0) or cut(df))
    I.stitch_tracklets(I.build_tracklets(fragments(spark, 6)))
    assert len(seen) <= 2 + 3 * 8
