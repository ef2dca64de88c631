"""Ball control, inferred possession and turnovers."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import by_exchange
from ..functions.ordered import Ordered, lag, lead, running_sum
from ..schema import AWAY, FPS, HOME, PITCH_LENGTH, PITCH_WIDTH, TEAMS, ball, is_playing
from ..sources.scratch import written
from .shape import with_ball


def control_frames(tracks: DataFrame, radius_m: float = 2.0, out_margin_m: float = 1.0,
                   length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """One row per frame: control = HOME, AWAY, BALLOUT, FREE, or NONE without a ball."""
    t = with_ball(tracks)
    d = F.hypot(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y"))
    near = F.when(is_playing() & F.col("team").isin(*TEAMS) & F.col("ball_x").isNotNull(),
                  F.struct(d.alias("d"), "track_id", "team"))
    g = t.groupBy("match_id", "frame_idx").agg(
        F.min_by("period", "track_id").alias("period"), F.min_by("timestamp", "track_id").alias("timestamp"),
        F.max("ball_x").alias("ball_x"), F.max("ball_y").alias("ball_y"), F.min(near).alias("_n"))
    outside = (F.abs("ball_x") > length / 2 + out_margin_m) | (F.abs("ball_y") > width / 2 + out_margin_m)
    control = (F.when(F.col("ball_x").isNull(), "NONE").when(outside, "BALLOUT")
               .when(F.col("_n.d") <= radius_m, F.upper("_n.team")).otherwise("FREE"))
    return g.select("match_id", "frame_idx", "period", "timestamp", control.alias("control"))


def infer_possession(tracks: DataFrame, radius_m: float = 2.0, min_hold_s: float = 0.5,
                     max_gap_s: float = 2.0, out_margin_m: float = 1.0, fps: float = FPS,
                     length: float = PITCH_LENGTH, width: float = PITCH_WIDTH,
                     by_period: bool = False) -> DataFrame:
    """Possession per frame, without a loop: a team's island of control frames takes the ball at
    its first frame once it holds enough of them; long ball gaps are UNKNOWN and reset."""
    control = control_frames(tracks, radius_m, out_margin_m, length, width)
    return possession_from_control(control, min_hold_s, max_gap_s, fps, by_period)


def possession_from_control(control: DataFrame, min_hold_s: float = 0.5, max_gap_s: float = 2.0,
                            fps: float = FPS, by_period: bool = False) -> DataFrame:
    hold_n, max_gap_n = max(1, math.ceil(min_hold_s * fps)), int(max_gap_s * fps)
    keys = ["match_id"] + (["period"] if by_period else [])
    control = written(control)                  # one narrow row a frame, read by every step below
    o = Ordered(control, keys, ["frame_idx"]).add(_pos=running_sum(F.lit(1)), _was=lag(F.col("control")), _then=lead(F.col("control")))
    frames = o.done()
    # From here on the first rows of the runs of equal control, and a match's last row; the windows below hold these, not the frames.
    start, end = F.col("_was").isNull() | (F.col("_was") != F.col("control")), F.col("_then").isNull()
    edges = frames.filter(start | end).select(*keys, "_pos", "control", start.alias("_start"))
    w = Window.partitionBy(*keys).orderBy("_pos")
    upto, before = (w.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    size = F.max("_pos").over(Window.partitionBy(*keys))
    runs = edges.withColumn("_size", size).filter("_start")
    runs = runs.withColumn("_len", F.coalesce(F.lead("_pos").over(w), F.col("_size") + 1) - F.col("_pos"))
    marker = (F.when(F.col("control").isin("HOME", "AWAY", "BALLOUT"), F.col("control"))
              .when((F.col("control") == "NONE") & (F.col("_len") > max_gap_n), "UNKNOWN"))
    runs = runs.withColumn("_m", marker).withColumn("_prev", F.last("_m", ignorenulls=True).over(before))
    new = F.coalesce(F.col("_m").isNotNull() & (F.col("_prev").isNull() | (F.col("_m") != F.col("_prev"))), F.lit(False))
    runs = runs.withColumn("_new", new).withColumn("_island", F.sum(F.col("_new").cast("int")).over(upto))
    held = F.sum(F.when(F.col("_m").isin("HOME", "AWAY"), F.col("_len"))).over(Window.partitionBy(*keys, "_island"))
    runs = runs.withColumn("_held", held)
    taken = (F.when(F.col("_m").isin("BALLOUT", "UNKNOWN"), F.col("_m"))
             .when(F.col("_new") & (F.col("_held") >= hold_n), F.col("_m")))
    state = F.coalesce(F.last(taken, ignorenulls=True).over(upto), F.lit("UNKNOWN"))
    spread = runs.select(*keys, state.alias("ball_status"), F.explode(F.sequence(F.col("_pos"), F.col("_pos") + F.col("_len") - 1)).alias("_pos"))
    return frames.join(by_exchange(spread), [*keys, "_pos"]).select("match_id", "frame_idx", "period", "timestamp", "ball_status")


def possession_runs(possession: DataFrame, fps: float = FPS, by_period: bool = False) -> DataFrame:
    """Runs of HOME or AWAY frames; other statuses are dropped first, so runs merge across them."""
    keys = ["match_id"] + (["period"] if by_period else [])
    held = possession.filter(F.col("ball_status").isin("HOME", "AWAY"))
    o = Ordered(held, keys, ["frame_idx"]).add(_prev=lag(F.col("ball_status")))
    new = F.col("_prev").isNull() | (F.col("_prev") != F.col("ball_status"))
    o = o.add(_run=running_sum(new.cast("int")))
    return o.df.groupBy(*keys, "_run").agg(
        F.first("ball_status").alias("team"), F.min("frame_idx").alias("start"),
        F.max("frame_idx").alias("end"), F.min("timestamp").alias("t0"),
        *([] if by_period else [F.min_by("period", "frame_idx").alias("period")])
    ).withColumn("len_s", (F.col("end") - F.col("start")) / F.lit(fps))


def transitions(tracks: DataFrame, possession: DataFrame, min_hold_s: float = 1.5,
                window_s: float = 5.0, fps: float = FPS, by_period: bool = False) -> DataFrame:
    """Turnovers with where the ball was won and how far it went in the next seconds."""
    keys = ["match_id"] + (["period"] if by_period else [])
    runs = written(possession_runs(possession, fps, by_period).filter(F.col("len_s") >= min_hold_s))
    o = Ordered(runs, keys, ["start"]).add(_prev=lag(F.col("team")))
    won = o.done().filter(F.col("_prev") != F.col("team"))
    # The look-ahead is a bounded number of frames, so the range becomes an equi-join.
    ahead = F.explode(F.sequence(F.col("start"), (F.col("start") + F.lit(int(window_s * fps)))))
    b = ball(tracks).groupBy("match_id", "frame_idx").agg(
        F.min(F.struct("track_id", "x", "y")).alias("_b"))
    look = won.withColumn("frame_idx", ahead).join(b, ["match_id", "frame_idx"])
    later = F.when(F.col("frame_idx") > F.col("start"), F.col("frame_idx"))
    here = F.col("frame_idx") == F.col("start")
    g = look.groupBy("match_id", "start", "team", "period", "t0", "len_s").agg(
        F.max(F.when(here, F.col("_b.x"))).alias("x0"), F.max(F.when(here, F.col("_b.y"))).alias("y0"),
        F.max_by("_b.x", later).alias("x1")).filter(F.col("x0").isNotNull())
    sign = F.when(F.col("team") == "HOME", 1).otherwise(-1)
    return g.select("match_id", "period", F.col("t0").alias("timestamp"), F.col("start").alias("frame_idx"),
                    F.lower("team").alias("won_by"), (F.col("x0") * sign).alias("won_at_x"),
                    F.col("y0").alias("won_at_y"), F.col("len_s").alias("hold_s"),
                    ((F.col("x1") - F.col("x0")) * sign).alias("gain_m"))


def possession_orientation_check(tracks: DataFrame, possession: DataFrame) -> DataFrame:
    """Is the team nearer the ball the one said to hold it? Every frame votes; swap the labels when mostly not."""
    from .shape import one_status_per_frame
    held = one_status_per_frame(possession).filter(F.col("ball_status").isin("HOME", "AWAY"))
    balls = ball(tracks).groupBy("match_id", "frame_idx").agg(F.min(F.struct("track_id", "x", "y")).alias("_b"))
    picked = held.join(balls, ["match_id", "frame_idx"])
    p = tracks.filter(F.col("role") != "ball").join(picked, ["match_id", "frame_idx"])
    d = F.hypot(F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y"))
    g = p.groupBy("match_id", "frame_idx", "ball_status").agg(
        F.min(F.when(F.col("team") == HOME, d)).alias("h"), F.min(F.when(F.col("team") == AWAY, d)).alias("a"))
    g = g.filter(F.col("h").isNotNull() & F.col("a").isNotNull())
    agree = F.when(F.col("a") < F.col("h"), "AWAY").otherwise("HOME") == F.col("ball_status")
    out = g.groupBy("match_id").agg(F.count(F.when(agree, 1)).alias("agree"),
                                    F.count(F.when(~agree, 1)).alias("disagree"))
    return out.withColumn("swapped", F.col("disagree") > F.col("agree"))


def swap_team_labels(tracks: DataFrame, check: DataFrame) -> DataFrame:
    flags = check.select("match_id", "swapped")
    other = F.when(F.col("team") == HOME, AWAY).when(F.col("team") == AWAY, HOME).otherwise(F.col("team"))
    return (tracks.join(flags, "match_id", "left")
            .withColumn("team", F.when(F.col("swapped"), other).otherwise(F.col("team"))).drop("swapped"))


def swap_sheet_labels(sheet: DataFrame, check: DataFrame) -> DataFrame:
    """The same correction for the player -> team map that PPDA uses."""
    return swap_team_labels(sheet, check)
