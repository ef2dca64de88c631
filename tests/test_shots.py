"""Shot segmentation against straightforward loops on random signals."""
import numpy as np
import pandas as pd

from matchspark.operators.shots import live_wide_segments


def runs(mask):
    out, s = [], None
    for i, m in enumerate(list(mask) + [False]):
        if m and s is None:
            s = i
        if not m and s is not None:
            out.append((s, i - 1))
            s = None
    return out


def filled(mask, n, blocked=None):
    out = mask.copy()
    for s, e in runs(~mask):
        if s > 0 and e < len(mask) - 1 and e - s + 1 <= n and not (blocked is not None and blocked[s:e + 2].any()):
            out[s:e + 1] = True
    return out


def expected(t):
    n = len(t)
    st = [(s, e) for s, e in runs(filled(t["stinger"].to_numpy(bool), 10)) if e - s + 1 >= 12]
    stinger, replay, i = np.zeros(n, bool), np.zeros(n, bool), 0
    for s, e in st:
        stinger[s:e + 1] = True
    while i < len(st) - 1:
        if st[i + 1][0] - st[i][1] <= 1125:
            replay[st[i][0]:st[i + 1][1] + 1] = True
            i += 2
        else:
            i += 1
    cut = np.r_[False, t["hot"].to_numpy()[1:] != t["hot"].to_numpy()[:-1]]
    ok = ~stinger & ~replay
    wide = (t["grass"].to_numpy() >= .55) & ~t["stinger"].to_numpy(bool) & ~(t["person_h"].to_numpy() > .22) & ok
    wide = filled(wide, 12, cut) & ok
    live = wide.copy()
    for s, e in runs(wide):
        if e - s + 1 < 50:
            live[s:e + 1] = False
    return stinger, replay, live, np.cumsum(cut | np.r_[False, live[1:] != live[:-1]])


def test_random_signals(spark, mode):
    rng = np.random.default_rng(4)
    parts = []
    for m in range(5 if mode == "plain" else 2):
        n, pick = 2500, lambda p, lo, hi: np.concatenate([[v] * int(rng.integers(lo, hi)) for v in rng.choice(p, 400)])
        parts.append(pd.DataFrame({
            "match_id": str(m), "frame_idx": np.arange(n), "grass": pick([.8, .8, .8, .8, .2], 1, 60)[:n], "blob": 0.1,
            "stinger": pick([False] * 12 + [True], 5, 45)[:n].astype(bool), "hot": pick([0, 1, 2], 40, 300)[:n],
            "person_h": pick([.1] * 9 + [.3], 1, 40)[:n]}))
    t = pd.concat(parts)
    t["hist"] = [[1.0 if k == h else 0.0 for k in range(3)] for h in t["hot"]]
    df = spark.createDataFrame(t, "match_id string, frame_idx int, grass double, blob double, stinger boolean, hot int, person_h double, hist array<double>")
    got = live_wide_segments(df).toPandas().sort_values(["match_id", "frame_idx"])
    for m, g in t.groupby("match_id"):
        o = got[got.match_id == m]
        for name, want in zip(("is_stinger", "replay", "live", "shot"), expected(g)):
            np.testing.assert_array_equal(o[name].to_numpy(), want, err_msg=f"{m} {name}")
