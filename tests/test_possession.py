"""Possession without a loop equals a frame-by-frame loop; turnovers; the streaming form."""
import numpy as np
import pandas as pd
import pytest

from matchspark.operators.possession import possession_from_control, transitions
from matchspark.streaming.live import _Holder

HOLD, GAP = 13, 50


def loop(control):
    """The rule, one frame at a time."""
    status, current, who, since, n, gap = [], "UNKNOWN", None, 0, 0, 0
    for i, c in enumerate(control):
        if c == "NONE":
            gap += 1
            if gap > GAP:
                status[i - gap + 1:] = ["UNKNOWN"] * (gap - 1)
                current, who = "UNKNOWN", None
            status.append(current)
            continue
        gap = 0
        if c == "BALLOUT":
            current, who = "BALLOUT", None
        elif c == current:
            who = None
        elif c != "FREE":
            if c != who:
                who, since, n = c, i, 0
            n += 1
            if n >= HOLD:
                status[since:] = [c] * (i - since)
                current, who = c, None
        status.append(current)
    return status


def random_control(rng, n):
    out = []
    while len(out) < n:
        out += [str(rng.choice(["HOME", "AWAY", "FREE", "NONE", "BALLOUT"], p=[.3, .3, .2, .17, .03]))] * int(rng.integers(1, 30 if rng.random() < .9 else 90))
    return out[:n]


def test_random_sequences(spark, mode):
    rng = np.random.default_rng(3)
    seqs = {str(m): random_control(rng, int(rng.integers(1, 400))) for m in range(60 if mode == "plain" else 20)}
    rows = [(m, f, 1, f / 25.0, c) for m, s in seqs.items() for f, c in enumerate(s)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["match_id", "frame_idx", "period", "timestamp", "control"]))
    got = possession_from_control(df).toPandas().sort_values(["match_id", "frame_idx"])
    for m, s in seqs.items():
        assert got[got.match_id == m]["ball_status"].tolist() == loop(s), m


def test_streaming_state_agrees_with_the_loop():
    rng = np.random.default_rng(5)
    for _ in range(300):
        s = random_control(rng, int(rng.integers(1, 300)))
        h, got = _Holder(HOLD, GAP), []
        for f, c in enumerate(s):
            got += h.step(f, c)
        got += [(o[0], o[1]) for o in h.open]
        assert [f for f, _ in got] == list(range(len(s)))
        assert [x for _, x in got] == loop(s)


@pytest.mark.parametrize("gone", [False, True])
def test_turnover_needs_a_ball_at_its_start(spark, gone):
    poss = [("m", f, 1, f / 25, "HOME" if f < 100 else "AWAY") for f in range(200)]
    ball = [("m", f, -1, "ball", 0.5 * f, 1.0) for f in range(200) if not (gone and f == 100)]
    p = spark.createDataFrame(poss, "match_id string, frame_idx int, period int, timestamp double, ball_status string")
    b = spark.createDataFrame(ball, "match_id string, frame_idx int, track_id int, role string, x double, y double")
    got = transitions(b, p).collect()
    if gone:
        assert got == []
    else:
        r = got[0]
        assert (r.frame_idx, r.won_by, r.won_at_x) == (100, "away", -50.0) and r.gain_m == -(199 - 100) * 0.5
