"""Ball path by exhaustive search, split stretches, tracker behaviour, identity steps."""
import itertools

import numpy as np
import pandas as pd

from matchspark.functions.tracking import BallWatch, Tracks, best_path
from matchspark.operators import identity as I
from matchspark.operators.teams import assign_tracks, kit_clusters, mean_descriptors, split_officials, team_scores_by_track, track_scores
from matchspark.operators.tracking import link_ball_path, track_detections


def path_score(idx, frames, xy, score, fps=25.0):
    total = 0.0
    for n, i in enumerate(idx):
        if score[i] <= 0:
            return -np.inf
        total += score[i]
        if n:
            j = idx[n - 1]
            dt, d = frames[i] - frames[j], np.linalg.norm(xy[i] - xy[j])
            if dt <= 25 and d <= 35 * dt / fps + 1:
                total -= min(0.005 * (dt - 1) + 0.3 * ((d * fps / dt) / 35) ** 2, 0.25)
            else:
                total -= 0.25
    return total


def test_best_path_is_exhaustively_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        frames = np.sort(rng.choice([0, 1, 2, 3, 4, 40, 41], 7))
        xy, score = rng.uniform(0, 4, (7, 2)), np.round(rng.uniform(-.1, .6, 7), 3)
        best = 0.0
        for k in range(1, 8):
            for idx in itertools.combinations(range(7), k):
                if len(set(frames[list(idx)])) == k:
                    best = max(best, path_score(idx, frames, xy, score))
        path, value = best_path(frames, xy, score, 25.0)
        assert abs(value - best) < 1e-9 and (not path or abs(path_score(path, frames, xy, score) - best) < 1e-9)


def test_linking_in_stretches_equals_the_whole(spark):
    rng = np.random.default_rng(2)
    rows = []
    for f in [*range(0, 20), *range(60, 75), *range(200, 203), *range(300, 330)]:
        rows += [("m", f, c, float(x), float(y), float(s)) for c, (x, y, s) in enumerate(rng.uniform([0, 0, .01], [6, 6, .4], (2, 3)))]
    cols = ["match_id", "frame_idx", "cand", "x", "y", "conf"]
    t = pd.DataFrame(rows, columns=cols)
    people = spark.createDataFrame([("m", 0, 0.0, 0.0)], "match_id string, frame_idx int, x double, y double")
    got = link_ball_path(spark.createDataFrame(t), people).toPandas().sort_values("frame_idx")
    path, _ = best_path(t["frame_idx"].to_numpy(), t[["x", "y"]].to_numpy(), t["conf"].to_numpy(), 25.0)
    assert list(zip(got["frame_idx"], got["cand"])) == list(zip(t.iloc[path]["frame_idx"], t.iloc[path]["cand"]))


def test_tracker_keeps_identity_and_separates_the_ball(spark):
    rng, rows = np.random.default_rng(1), []
    start, vel = rng.uniform([-40, -25], [40, 25], (8, 2)), rng.normal(0, 2, (8, 2))
    for m in ("a", "b"):
        for f in range(120):
            for i in range(8):
                if rng.random() < .9:
                    p = start[i] + vel[i] * f / 25 + rng.normal(0, .05, 2)
                    rows.append((m, f, i, float(p[0]), float(p[1]), "ball" if i == 7 else "player"))
    df = spark.createDataFrame(rows, "match_id string, frame_idx int, det int, x double, y double, role string")
    got = track_detections(df).toPandas()
    assert len(got) == len(rows)
    ball = got[got.det == 7].groupby("match_id")["track_id"].agg(set)
    others = got[got.det != 7].groupby("match_id")["track_id"].agg(set)
    assert all(not (ball[m] & others[m]) for m in "ab")
    per = got.groupby(["match_id", "det"])["track_id"].nunique()
    assert (per == 1).mean() >= 0.8


def test_tracker_appearance_and_retirement():
    t = Tracks()
    a, b = np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 0.0]])
    e = np.eye(2)
    first, _ = t.step(a, np.zeros(2, bool), e)
    second, _ = t.step(b, np.zeros(2, bool), e)          # they swapped places but not shirts
    assert first.tolist() == second.tolist()
    for _ in range(31):
        t.step(np.array([[30.0, 30.0]]), np.zeros(1, bool), e[:1])
    assert set(t.ids.tolist()).isdisjoint(first.tolist())


def test_ball_picker_ignores_a_lone_still_ball():
    p, picks = BallWatch(), []
    for f in range(120):
        xy = np.array([[20.0, 5.0], [0.2 * f, 0.0]])
        picks.append(p.pick(f, xy, np.array([.9, .3]), np.array([[0.2 * f, 1.0]]))[0])
    assert picks[0] == 0 and picks[-1] == 1        # the bright decoy is let go once it is known to be still


# ------------------------------------------------------------------ identity

def _tracks(spark, rows):
    return spark.createDataFrame(rows, "match_id string, track_id int, frame_idx int, role string, team string, x double, y double")


def test_stitching_joins_fragments_of_one_runner(spark):
    rows = []
    for piece in range(4):                                      # a runner cut into four
        rows += [("m", 10 + piece, f, "player", "home", 0.2 * f, 0.0) for f in range(piece * 60, piece * 60 + 50)]
    rows += [("m", 50, f, "player", "away", 0.0, 30.0) for f in range(240)]
    got = {r.tracklet_id: r for r in I.stitch_tracklets(I.build_tracklets(_tracks(spark, rows))).collect()}
    assert sorted(got) == [10, 50] and got[10].track_ids == [10, 11, 12, 13] and got[10].n_frames == 200


def test_numbers_join_and_veto(spark):
    rows = [("m", t, f, "player", "home", 0.0, 0.0) for t, a in ((1, 0), (2, 500), (3, 520), (4, 900)) for f in range(a, a + 40)]
    reads = [("m", t, n, .8) for t, n in ((1, 9), (2, 9), (3, 9), (4, 7)) for _ in range(4)]
    t = I.add_jersey_reads(I.build_tracklets(_tracks(spark, rows)), spark.createDataFrame(reads, "match_id string, track_id int, number int, confidence double"))
    got = {r.tracklet_id: r for r in I.merge_by_jersey(t.withColumn("team", t.role)).collect()}
    # 2 and 3 overlap, so only one of them can be the man with 1's number.
    assert sorted(len(r.track_ids) for r in got.values()) == [1, 1, 2] and got[4].jersey == 7
    near = [("m", t, f, "player", "home", 0.0, 0.0) for t, a in ((1, 0), (2, 45)) for f in range(a, a + 40)]
    two = I.add_jersey_reads(I.build_tracklets(_tracks(spark, near)), spark.createDataFrame(
        [("m", t, n, .8) for t, n in ((1, 9), (2, 7)) for _ in range(3)], "match_id string, track_id int, number int, confidence double"))
    assert I.candidate_successors(two).count() == 0 and I.candidate_successors(two, jersey_veto=False).count() == 1


def test_roster_quota_and_keeper(spark):
    rows = []
    for i in range(23):
        x = -50.0 if i == 0 else -30.0 + i
        rows += [("m", i + 1, f, "player", "home", x, 0.5 * i) for f in range(50)]
    tracks = _tracks(spark, rows)
    t = I.build_tracklets(tracks).withColumn("team_score", (I.F.col("tracklet_id") - 15) / 20.0)
    teams = [r.team for r in I.assign_teams_with_roster(t).collect()]
    assert sorted((teams.count("home"), teams.count("away"))) == [11, 12]
    keepers = I.goalkeeper_tracklets(tracks, t).collect()
    assert [(k.tracklet_id, k.end) for k in keepers] == [(1, -1)]


def test_kit_splits(spark):
    rng, rows = np.random.default_rng(0), []
    for tid in range(24):
        kit = 2 if tid >= 22 else tid % 2
        rows += [("m", tid, f, [float(v) for v in np.eye(3)[kit] + rng.random(3) * .05]) for f in range(20)]
    d = spark.createDataFrame(rows, "match_id string, track_id int, frame_idx int, descriptor array<double>")
    m = mean_descriptors(d)
    s = {r.track_id: r.score for r in team_scores_by_track(m).collect()}
    assert len({np.sign(s[t]) for t in range(0, 22, 2)}) == 1 and np.sign(s[0]) != np.sign(s[1])
    assert sorted(r.track_id for r in split_officials(m).collect()) == [22, 23]
    assert kit_clusters(d).first().balance > 0.8


def test_tracks_without_a_kit_keep_a_row(spark):
    d = spark.createDataFrame([("m", t, f, [float(t % 2), float(t % 2 == 0)] if t < 4 else [0.0, 0.0]) for t in range(6) for f in range(6)],
                              "match_id string, track_id int, frame_idx int, descriptor array<double>")
    s = {r.track_id: r.score for r in team_scores_by_track(mean_descriptors(d), k=2, tracks=d).collect()}
    assert set(s) == set(range(6)) and s[4] == s[5] == 0.0 and s[0] == s[2] == -s[1] == -s[3] != 0
    labels = d.filter("track_id < 4").selectExpr("match_id", "track_id", "frame_idx", "track_id % 2 as cluster", "0.5D as gap")
    for balanced in (False, True):
        a = {r.track_id: (r.team, r.confidence) for r in assign_tracks(labels, balanced=balanced, tracks=d).collect()}
        assert set(a) == set(range(6)) and a[4] == a[5] == ("unknown", 0.0) and {a[t][0] for t in (0, 2)} == {"home"} and {a[t][0] for t in (1, 3)} == {"away"}
    assert {r.track_id: r.score for r in track_scores(labels, d).collect()} == {0: -1.0, 1: 1.0, 2: -1.0, 3: 1.0, 4: 0.0, 5: 0.0}
    assert track_scores(labels).count() == 4
