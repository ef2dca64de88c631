"""Replays, live wide play and shot ids from per-frame image signals."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import whole_groups
from ..functions.intervals import at_least, closed, joined, minus, union, within
from ..functions.joins import by_exchange
from ..functions.ordered import Ordered, lag, lead
from ..functions.vectors import l1
from ..schema import FPS

# Default thresholds of the shot filter.
GRASS_MIN, BLOB_MAX, PERSON_H_MAX = 0.55, 0.25, 0.22
STINGER_MIN_S, STINGER_GAP_S, REPLAY_MAX_S = 0.5, 0.4, 45.0
BRIDGE_S, MIN_WIDE_S, CUT = 0.5, 2.0, 0.35


def _by_start():
    """A match's runs or events in order; never its frames."""
    return Window.partitionBy("match_id").orderBy("s")


def _frames(seconds: float, fps: float) -> int:
    return int(round(seconds * fps))


def run_table(frames: DataFrame, flags: list[str], marks: Column | None = None) -> DataFrame:
    """match_id, s, e, the flags, and how many `marks` lie from s to one past e: the runs of frames whose flags are all equal.

    Expects one row per consecutive frame. Only run starts, marked frames and a match's last frame leave the frame table.
    """
    mark = marks if marks is not None else F.lit(False)
    o = Ordered(frames, ["match_id"], ["frame_idx"]).add(_was=lag(F.struct(*flags)), _then=lead(F.lit(True)))
    starts = F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.struct(*flags))
    events = o.done().select("match_id", F.col("frame_idx").alias("s"), starts.alias("_start"), F.col("_then").isNull().alias("_last"), mark.alias("_mark"), *flags)
    events = events.filter(F.col("_start") | F.col("_mark") | F.col("_last"))
    seen, whole = F.sum(F.col("_mark").cast("int")).over(_by_start()), Window.partitionBy("match_id")
    runs = events.select("*", seen.alias("_seen"), F.max("s").over(whole).alias("_end"), F.sum(F.col("_mark").cast("int")).over(whole).alias("_total")).filter("_start")
    before = F.col("_seen") - F.col("_mark").cast("int")
    runs = runs.withColumn("marks", F.coalesce(F.lead("_seen").over(_by_start()), F.col("_total")) - before)
    return runs.select("match_id", "s", F.coalesce(F.lead("s").over(_by_start()) - 1, F.col("_end")).alias("e"), *flags, "marks")


def joined_runs(runs: DataFrame, flag: str) -> DataFrame:
    """Adds from and to: the bounds of the stretch of neighbouring runs with an equal flag."""
    new = F.coalesce(F.lag(flag).over(_by_start()) != F.col(flag), F.lit(True))
    ids = runs.withColumn("_new", new).withColumn("_id", F.sum(F.col("_new").cast("int")).over(_by_start()))
    same = Window.partitionBy("match_id", "_id")
    return ids.select(*runs.columns, F.min("s").over(same).alias("from"), F.max("e").over(same).alias("to"), F.sum("marks").over(same).alias("in_marks"))


def fill_gaps(runs: DataFrame, flag: str, max_gap: int) -> DataFrame:
    """Turn interior false stretches of at most `max_gap` frames true, unless a mark lies in one or on the frame after it."""
    found = joined_runs(runs, flag)
    inside = Window.partitionBy("match_id")
    ok = (~F.col(flag) & (F.col("from") > F.min("s").over(inside)) & (F.col("to") < F.max("e").over(inside))
          & (F.col("to") - F.col("from") + 1 <= max_gap) & (F.col("in_marks") == 0))
    return found.withColumn("_filled", F.col(flag) | ok).select(*[F.col("_filled" if c == flag else c).alias(c) for c in runs.columns])


# ------------------------------------------------------------------ one run table, one pass over it, one way back

def is_wide() -> Column:
    """Wide play by the picture alone."""
    return ((F.col("grass") >= GRASS_MIN) & (F.col("blob") <= BLOB_MAX) & ~F.col("stinger")
            & ~F.coalesce(F.col("person_h") > PERSON_H_MAX, F.lit(False)))


def signal_runs(signals: DataFrame, cuts: bool = True) -> DataFrame:
    """match_id, s, stinger, wide, cut, last: the frames where stinger or wide changes or the colour histogram jumps, and each match's last frame.

    Expects one row per consecutive frame. One step in order; all that follows works on these rows, far fewer than the frames.
    """
    state = F.struct(F.coalesce("stinger", F.lit(False)).alias("stinger"), F.coalesce(is_wide(), F.lit(False)).alias("wide")) if cuts else F.struct(
        F.coalesce("stinger", F.lit(False)).alias("stinger"), F.lit(False).alias("wide"))
    hist = [F.col("hist")] if cuts else []
    o = Ordered(signals.select("match_id", "frame_idx", state.alias("now"), *hist), ["match_id"], ["frame_idx"]).add(
        _was=lag(F.struct("now", *hist)), _then=lead(F.lit(True)))
    cut = F.coalesce(0.5 * l1(F.col("hist"), F.col("_was.hist")) > CUT, F.lit(False)) if cuts else F.lit(False)
    rows = o.done().select("match_id", F.col("frame_idx").alias("s"), "now.stinger", "now.wide", cut.alias("cut"), F.col("_then").isNull().alias("last"),
                           (F.col("_was").isNull() | (F.col("_was.now") != F.col("now"))).alias("_new"))
    return rows.filter(F.col("_new") | F.col("cut") | F.col("last")).drop("_new")


def replay_spans(stingers: np.ndarray, reach: float) -> np.ndarray:
    """From each stinger to the next one if that starts at most `reach` later; a stinger closes one replay at most."""
    out, i = [], 0
    while i < len(stingers) - 1:
        if stingers[i + 1, 0] - stingers[i, 1] <= reach:
            out.append((stingers[i, 0], stingers[i + 1, 1]))
            i += 1
        i += 1
    return np.array(out, np.int64).reshape(-1, 2)


def match_spans(s: np.ndarray, stinger: np.ndarray, wide: np.ndarray, cut: np.ndarray, fps: float, min_s: float) -> dict[str, np.ndarray]:
    """A match's stretches of equal stinger, replay, live and shot, from its changes (the last row is its last frame)."""
    end = np.append(s[1:] - 1, s[-1])

    def spans(flag):
        return joined(s[flag], end[flag])
    stingers = at_least(joined(s[stinger], end[stinger], _frames(STINGER_GAP_S, fps)), _frames(STINGER_MIN_S, fps))
    replays, cuts = replay_spans(stingers, REPLAY_MAX_S * fps), s[cut]
    blocked = union(stingers, replays)
    bridged = minus(closed(minus(spans(wide), blocked), _frames(BRIDGE_S, fps), cuts), blocked)
    live = at_least(bridged, min_s * fps)
    bounds = [x for span in (stingers, replays, live) for x in (span[:, 0], span[:, 1] + 1)]
    first = np.unique(np.concatenate([s[:1], cuts, *bounds]))
    first = first[first <= s[-1]]
    on, is_cut = within(live, first), np.isin(first, cuts)
    shot = np.cumsum(is_cut | np.append(False, on[1:] != on[:-1]))
    return {"s": first, "e": np.append(first[1:] - 1, s[-1]), "is_stinger": within(stingers, first), "replay": within(replays, first), "cut": is_cut,
            "live": on, "shot": shot}


def spans_per_match(signals: DataFrame, fps: float = FPS, min_s: float = MIN_WIDE_S, cuts: bool = True) -> DataFrame:
    """match_id, s, e, is_stinger, replay, cut (of the first frame), live, shot: the stretches of every match. A match's changes, not
    its frames, are held together."""
    def run(batches):
        for df, at in whole_groups(batches, ["match_id"]):
            for a, b in zip(at[:-1], at[1:]):
                g = df.iloc[a:b]
                out = match_spans(*(g[c].to_numpy() for c in ("s", "stinger", "wide", "cut")), fps, min_s)
                yield pd.DataFrame({"match_id": [g["match_id"].iloc[0]] * len(out["s"]), **out})
    schema = "match_id string, s int, e int, is_stinger boolean, replay boolean, cut boolean, live boolean, shot int"
    return signal_runs(signals, cuts).repartition("match_id").sortWithinPartitions("match_id", "s").mapInPandas(run, schema)


def _onto_frames(signals: DataFrame, spans: DataFrame, *names: str) -> DataFrame:
    values = [(F.col("cut") & (F.col("frame_idx") == F.col("s"))).alias("cut") if n == "cut" else F.col(n) for n in names]
    each = spans.select("match_id", *dict.fromkeys(["s", *names]), F.explode(F.sequence("s", "e")).alias("frame_idx")).select("match_id", "frame_idx", *values)
    return signals.join(by_exchange(each), ["match_id", "frame_idx"]).select(*signals.columns, *names)


def stinger_and_replay(signals: DataFrame, fps: float = FPS) -> DataFrame:
    """Adds is_stinger and replay. A replay spans two stingers at most 45 s apart, both included."""
    return _onto_frames(signals, spans_per_match(signals, fps, cuts=False), "is_stinger", "replay")


def with_cuts(signals: DataFrame) -> DataFrame:
    """Adds cut: the colour histogram jumps from the frame before."""
    o = Ordered(signals, ["match_id"], ["frame_idx"]).add(_ph=lag(F.col("hist")))
    return o.done().select(*signals.columns, F.coalesce(0.5 * l1(F.col("hist"), F.col("_ph")) > CUT, F.lit(False)).alias("cut"))


def live_wide_segments(signals: DataFrame, fps: float = FPS) -> DataFrame:
    """Adds is_stinger, replay, cut, live and shot per frame. live: wide play outside stingers and replays, bridged over short gaps
    without a cut, of two seconds or more; a shot ends at every cut and where live changes."""
    return _onto_frames(signals, spans_per_match(signals, fps), "is_stinger", "replay", "cut", "live", "shot")
