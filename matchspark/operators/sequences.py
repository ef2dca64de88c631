"""Labelled tactical sequences: low block, high press, flank overload."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered, lag, running_sum
from ..schema import AWAY, FPS, HOME, PITCH_LENGTH, PITCH_WIDTH, TEAMS, attacking_sign, players
from ..sources.scratch import written
from .shape import goalkeepers, one_status_per_frame, press_distance, sample_every, team_block

SEQUENCE_COLUMNS = ("match_id", "label", "team", "period", "start_s", "end_s", "start_frame", "end_frame",
                    "duration_s", "def_line_x", "compactness_m", "n_within_10m", "flank",
                    "n_attackers", "n_defenders", "in_possession_share")


def live_only(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("live_wide"))


def flank_counts(tracks: DataFrame, every: int = 5, flank_y: float = PITCH_WIDTH / 6,
                 length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Per sampled frame and team: its better flank in the opponent's half and who is there."""
    p = sample_every(players(tracks), every).filter(
        F.col("team").isin(*TEAMS) & (F.abs("x") <= length / 2) & (F.abs("y") <= width / 2))
    aggs = []
    for t, s in ((HOME, 1.0), (AWAY, -1.0)):
        x, y, own = F.col("x") * s, F.col("y") * s, F.col("team") == t
        aggs.append(F.count(F.when(own, 1)).alias(f"{t}_seen"))
        for side, there in (("right", y >= flank_y), ("left", y <= -flank_y)):
            zone = there & (x >= 0)
            aggs.append(F.count(F.when(zone & own, 1)).alias(f"{t}_{side}_att"))
            aggs.append(F.count(F.when(zone & ~own, 1)).alias(f"{t}_{side}_def"))
    g = p.groupBy("match_id", "frame_idx").agg(*aggs)

    def row(t, opp):
        c = lambda n: F.col(f"{t}_{n}")
        left = c("left_att") - c("left_def") > c("right_att") - c("right_def")
        pick = lambda kind: F.when(left, c(f"left_{kind}")).otherwise(c(f"right_{kind}")).cast("int")
        return F.struct(F.lit(t).alias("team"), F.when(left, "left").otherwise("right").alias("flank"),
                        pick("att").alias("n_attackers"), pick("def").alias("n_defenders"),
                        c("seen").cast("int").alias("n_visible"),
                        F.col(f"{opp}_seen").cast("int").alias("n_visible_opp"))
    return (g.select("match_id", "frame_idx", F.explode(F.array(row(HOME, AWAY), row(AWAY, HOME))).alias("r"))
            .select("match_id", "frame_idx", "r.*"))


def frame_lookups(tracks: DataFrame, possession: DataFrame, every: int = 5,
                  flank_y: float | None = None, length: float = PITCH_LENGTH,
                  width: float = PITCH_WIDTH) -> DataFrame:
    """Block rows with status, press count, ball and flank evidence; missing counts are 0."""
    live, frame = live_only(tracks), ["match_id", "frame_idx"]
    keepers = goalkeepers(live)
    # The sampled rows, written once for the four branches below.
    live = written(sample_every(live, every).select(*frame, "period", "timestamp", "track_id", "role", "team", "x", "y", "shot"))
    block = team_block(live, every=every, keepers=keepers)
    per_frame = live.groupBy(*frame).agg(
        F.min_by("shot", "track_id").alias("shot"),
        F.min(F.when(F.col("role") == "ball", F.struct("track_id", "x"))).alias("_b"))
    status = one_status_per_frame(sample_every(possession, every))
    press = press_distance(live, possession, every).select(
        *frame, F.col("pressing_team").alias("team"), "n_within_10m")
    flanks = flank_counts(live, every, width / 6 if flank_y is None else flank_y, length, width)
    out = (block.join(per_frame, frame, "left").join(status, frame, "left")
           .join(press, frame + ["team"], "left").join(flanks, frame + ["team"], "left"))
    own = F.upper("team")
    opp = F.when(F.col("team") == HOME, "AWAY").otherwise("HOME")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        *block.columns, F.coalesce("shot", F.lit(0)).alias("shot"),
        F.coalesce(F.col("ball_status") == opp, F.lit(False)).alias("out_of_possession"),
        F.coalesce(F.col("ball_status") == own, F.lit(False)).alias("in_possession"),
        (F.col("_b.x") * attacking_sign()).alias("ball_x_own"), F.coalesce("flank", F.lit("")).alias("flank"),
        zero("n_within_10m"), zero("n_attackers"), zero("n_defenders"), zero("n_visible"), zero("n_visible_opp"))


def sequence_runs(hits: DataFrame, every: int, fps: float = FPS, min_s: dict[str, float] | None = None) -> DataFrame:
    """Consecutive hits of one label, team, period and flank; one missing sample is tolerated and a
    new shot always starts a new run. `min_s` drops runs shorter than the label's minimum."""
    keys = ["match_id", "label", "team", "period", "run_flank"]
    o = Ordered(written(hits), keys, ["frame_idx"])            # far fewer rows than what they are derived from
    o = o.add(_pf=lag(F.col("frame_idx")), _ps=lag(F.col("shot")))
    new = (F.col("_pf").isNull() | (F.col("frame_idx") - F.col("_pf") > 2 * every)
           | (F.col("shot") != F.col("_ps")))
    o = o.add(_run=running_sum(new.cast("int")))
    g = o.df.groupBy(*keys, "_run").agg(
        F.min("frame_idx").alias("_f0"), F.max("frame_idx").alias("_f1"),
        F.min_by("timestamp", "frame_idx").alias("start_s"), F.max_by("timestamp", "frame_idx").alias("_t1"),
        F.avg("def_line_x").alias("def_line_x"), F.avg("compactness_m").alias("compactness_m"),
        F.max("n_within_10m").alias("n_within_10m"), F.max("n_attackers").alias("n_attackers"),
        F.max("n_defenders").alias("n_defenders"),
        F.avg(F.col("in_possession").cast("double")).alias("in_possession_share"))
    g = g.withColumn("duration_s", (F.col("_f1") - F.col("_f0") + every) / F.lit(float(fps)))
    if min_s:
        least = F.coalesce(*[F.when(F.col("label") == k, F.lit(float(v))) for k, v in min_s.items()])
        g = g.filter(F.col("duration_s") >= least)
    return g.select(
        "match_id", "label", "team", "period", "start_s", (F.col("_t1") + every / fps).alias("end_s"),
        F.col("_f0").alias("start_frame"), (F.col("_f1") + every - 1).alias("end_frame"), "duration_s",
        "def_line_x", "compactness_m", "n_within_10m", F.col("run_flank").alias("flank"),
        "n_attackers", "n_defenders", "in_possession_share")


def sequence_hits(lookups: DataFrame, low_block_line=-22.5, low_block_compact_m=14.0,
                  high_press_line=7.5, high_press_n=3, overload_n=4, overload_max_defenders=3,
                  overload_min_visible=7, length: float = PITCH_LENGTH) -> DataFrame:
    """One row per rule a block row satisfies. The evidence is read once and fanned out."""
    oop = F.col("out_of_possession")
    low = oop & (F.col("def_line_x") <= low_block_line) & (F.col("compactness_m") <= low_block_compact_m)
    high = (oop & (F.col("def_line_x") >= high_press_line)
            & (F.col("ball_x_own") >= length / 2 - length / 3) & (F.col("n_within_10m") >= high_press_n))
    over = ((F.col("n_attackers") >= overload_n) & (F.col("n_defenders") <= overload_max_defenders)
            & (F.col("n_visible") >= overload_min_visible) & (F.col("n_visible_opp") >= overload_min_visible))
    hit = lambda cond, label, flank: F.when(cond, F.struct(F.lit(label).alias("label"), flank.alias("run_flank")))
    fan = F.array_compact(F.array(hit(low, "low_block", F.lit("")), hit(high, "high_press", F.lit("")),
                                  hit(over, "flank_overload", F.col("flank"))))
    return lookups.withColumn("_h", F.explode(fan)).select(*lookups.columns, "_h.*")


def detect_sequences(tracks: DataFrame, possession: DataFrame, every: int = 5, fps: float = FPS,
                     low_block_min_s: float = 8.0, high_press_min_s: float = 3.0,
                     overload_min_s: float = 3.0, flank_y: float | None = None,
                     length: float = PITCH_LENGTH, width: float = PITCH_WIDTH, **thresholds) -> DataFrame:
    """Sequences of normalised tracks; thresholds are keyword arguments of `sequence_hits`."""
    looked = frame_lookups(tracks, possession, every, flank_y, length, width)
    hits = sequence_hits(looked, length=length, **thresholds)
    return sequence_runs(hits, every, fps, {"low_block": low_block_min_s, "high_press": high_press_min_s,
                                            "flank_overload": overload_min_s})


def sequence_id():
    return F.concat_ws("-", "label", "team", F.col("period").cast("int"), F.col("start_frame").cast("int"))


def low_blocks_per_match(tracks: DataFrame, every: int = 5, line: float = -22.5, compact_m: float = 14.0,
                         min_s: float = 8.0, fps: float = FPS) -> DataFrame:
    """Deep, compact stretches per match and team from shape alone."""
    block = team_block(tracks, every=every)
    hits = block.filter((F.col("def_line_x") <= line) & (F.col("compactness_m") <= compact_m)).select(
        *block.columns, F.lit("low_block").alias("label"), F.lit("").alias("run_flank"), F.lit(0).alias("shot"),
        F.lit(0).alias("n_within_10m"), F.lit(0).alias("n_attackers"), F.lit(0).alias("n_defenders"),
        F.lit(False).alias("in_possession"))
    runs = sequence_runs(hits, every, fps, {"low_block": min_s})
    return runs.groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("n_low_blocks"),
                                                F.sum("duration_s").alias("seconds"))
