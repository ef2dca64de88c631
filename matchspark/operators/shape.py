"""Team shape: attacking direction, keepers, block, formation, pressing, zones."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import (AWAY, GOALKEEPER, HOME, PITCH_LENGTH, PITCH_WIDTH, TEAMS, attacking_sign,
                      finite, is_playing, players)
from ..sources.scratch import written

# Defenders, midfielders, forwards of each formation, in tie-break order.
FORMATIONS = (("4-4-2", 4, 4, 2), ("4-3-3", 4, 3, 3), ("4-2-3-1", 4, 5, 1), ("3-5-2", 3, 5, 2),
              ("5-3-2", 5, 3, 2), ("4-5-1", 4, 5, 1), ("3-4-3", 3, 4, 3), ("5-4-1", 5, 4, 1))
PASSES = ("PASS", "HIGH PASS", "CROSS")
DEFENSIVE = ("PLAYER SUCCESSFUL TACKLE", "BALL PLAYER BLOCK")


def on_pitch(df: DataFrame, margin: float = 2.0, ball_margin: float = 2.0,
             length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    m = F.when(F.col("role") == "ball", ball_margin).otherwise(margin)
    return df.filter(finite(F.col("x")) & finite(F.col("y"))
                     & (F.abs("x") <= length / 2 + m) & (F.abs("y") <= width / 2 + m))


def sample_every(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("frame_idx") % n == 0)


def stride(df: DataFrame, n: int, fps: float) -> tuple[DataFrame, float]:
    """Keep every n-th frame, number frames densely, and return the effective frame rate."""
    out = sample_every(df, n).withColumn("frame_idx", F.expr(f"cast(frame_idx div {n} as int)"))
    return out.withColumn("timestamp", F.col("frame_idx") * n / fps), fps / n


def inside_share(tracks: DataFrame, half_length: float = 54.5, half_width: float = 36.0) -> DataFrame:
    inside = (F.abs("x") <= half_length) & (F.abs("y") <= half_width)
    return players(tracks).groupBy("match_id").agg(F.avg(inside.cast("double")).alias("inside_share"))


def attacking_directions(tracks: DataFrame) -> DataFrame:
    """(match, period, team) -> +1 when the team attacks +x, from where its keeper stands."""
    keeper = F.col("role") == GOALKEEPER
    per = (players(tracks).filter(F.col("team").isin(*TEAMS))
           .groupBy("match_id", "period", "team", "track_id")
           .agg(F.avg("x").alias("mx"), F.sum(F.when(keeper, F.col("x"))).alias("kx"),
                F.count(F.when(keeper, F.col("x"))).alias("kn")))
    out = per.groupBy("match_id", "period", "team").agg(
        (F.sum("kx") / F.nullif(F.sum("kn"), F.lit(0))).alias("keeper_x"),
        F.max_by("mx", F.struct(F.abs("mx"), -F.col("track_id"))).alias("extreme_x"))
    at = F.coalesce("keeper_x", "extreme_x")
    return out.select("match_id", "period", "team",
                      F.when(at > 0, -1).otherwise(1).alias("direction"))


def normalise_direction(tracks: DataFrame) -> DataFrame:
    """Turn each period so that home attacks +x; every row turns, the ball too.

    The signs, one row per match and period, are written: their true size then decides how they are joined, and the tracks are not
    exchanged for them."""
    signs = attacking_directions(tracks).groupBy("match_id", "period").agg(
        F.max(F.when(F.col("team") == HOME, F.col("direction"))).alias("_h"),
        F.max(F.when(F.col("team") == AWAY, F.col("direction"))).alias("_a"))
    sign = F.coalesce(F.col("_h"), -F.col("_a"), F.lit(-1))
    return (tracks.join(written(signs), ["match_id", "period"], "left")
            .withColumn("x", F.col("x") * sign).withColumn("y", F.col("y") * sign)
            .select(*tracks.columns))


def goalkeepers(tracks: DataFrame) -> DataFrame:
    """(match, team) -> keeper_id; expects normalised directions."""
    per = (players(tracks).filter(F.col("team").isin(*TEAMS)).groupBy("match_id", "team", "track_id")
           .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"),
                F.count(F.when(F.col("role") == GOALKEEPER, 1)).alias("kn")))
    per = per.withColumn("most", F.max("n").over(Window.partitionBy("match_id", "team")))
    regular = F.col("n") > F.col("most") * 0.3
    return per.groupBy("match_id", "team").agg(F.coalesce(
        F.max_by("track_id", F.when(F.col("kn") > 0, F.struct("kn", -F.col("track_id")))),
        F.max_by("track_id", F.when(regular, F.struct(F.abs("mx"), -F.col("track_id"))))).alias("keeper_id"))


def _outfield_flag(tracks: DataFrame, exclude_gk: bool, keepers: DataFrame | None = None) -> DataFrame:
    p = players(tracks).filter(F.col("team").isin(*TEAMS))
    if not exclude_gk:
        return p.withColumn("_out", F.lit(True))
    p = p.join(goalkeepers(tracks) if keepers is None else keepers, ["match_id", "team"], "left")
    return p.withColumn("_out", F.col("keeper_id").isNull() | (F.col("track_id") != F.col("keeper_id")))


def block_of(outfield: DataFrame, *keys) -> DataFrame:
    """Shape of each group of rows flagged `_out` for outfielders; `keys` name a team's frame. Also over a stream."""
    sign = attacking_sign()
    mine = F.col("_out")
    b = outfield.groupBy(*keys).agg(
        F.min("timestamp").alias("timestamp"),
        F.count(F.when(mine, 1)).alias("n_outfield"),
        F.sort_array(F.collect_list(F.when(mine, F.col("x") * sign))).alias("_xs"),
        F.collect_list(F.when(mine, F.struct("x", "y"))).alias("_pts"),
        F.avg(F.when(mine, F.col("x"))).alias("_mx"), F.avg(F.when(mine, F.col("y"))).alias("_my"),
        F.max(F.when(mine, F.col("y"))).alias("_y1"), F.min(F.when(mine, F.col("y"))).alias("_y0"))
    b = b.filter(F.col("n_outfield") >= 6)
    xs = F.col("_xs")
    spread = F.aggregate("_pts", F.lit(0.0), lambda acc, q: acc + F.hypot(
        q["x"] - F.col("_mx"), q["y"] - F.col("_my")))
    return b.select(
        "match_id", "frame_idx", "period", "team", "timestamp",
        F.col("n_outfield").cast("int").alias("n_outfield"),
        ((xs[0] + xs[1] + xs[2] + xs[3]) / 4).alias("def_line_x"),
        ((F.element_at(xs, -1) + F.element_at(xs, -2)) / 2).alias("fwd_line_x"),
        (F.element_at(xs, -1) - xs[0]).alias("depth_m"),
        (F.col("_y1") - F.col("_y0")).alias("width_m"),
        (F.col("_mx") * sign).alias("centroid_x"), F.col("_my").alias("centroid_y"),
        (spread / F.col("n_outfield")).alias("compactness_m"), sign.alias("attacking_sign"))


def team_block(tracks: DataFrame, exclude_gk: bool = True, every: int = 25, keepers: DataFrame | None = None) -> DataFrame:
    """Per sampled frame and team with at least six outfielders: lines, depth, width, compactness.

    `keepers` (match, team, keeper_id) are those of the tracks unless given."""
    p = sample_every(_outfield_flag(tracks, exclude_gk, keepers), every)
    return block_of(p, "match_id", "frame_idx", "period", "team")


def formation_over_time(tracks: DataFrame, window_s: float = 300.0, every: int = 25) -> DataFrame:
    """Nearest formation per (period, team) window, from regulars' mean depth."""
    p = sample_every(_outfield_flag(tracks, True), every).filter("_out")
    group = Window.partitionBy("match_id", "period", "team")
    # Spans come from a small aggregate, so no window runs over a whole team's rows.
    spans = p.groupBy("match_id", "period", "team").agg(
        F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    p = p.join(spans, ["match_id", "period", "team"])
    idx = F.floor((F.col("timestamp") - F.col("t0")) / window_s)
    p = p.withColumn("w", idx).filter(F.col("t0") + F.col("w") * window_s < F.col("t1"))
    per = p.groupBy("match_id", "period", "team", "w", "t0", "track_id").agg(
        F.avg("x").alias("mx"), F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("match_id", "period", "team", "w"))
    per = per.withColumn("most", most).filter(F.col("n") >= F.col("most") * 0.5)
    g = per.groupBy("match_id", "period", "team", "w", "t0").agg(
        F.sort_array(F.collect_list(F.col("mx") * attacking_sign())).alias("xs"))
    n = F.size("xs")
    g = g.filter(n >= 8)
    gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.struct(
        F.round(F.get("xs", k + 1) - F.get("xs", k), 9).alias("gap"), k.alias("k")))
    g = g.withColumn("top", F.slice(F.sort_array(gaps, asc=False), 1, 2))
    a, b = F.col("top")[0]["k"], F.col("top")[1]["k"]
    g = g.withColumn("c0", F.least(a, b)).withColumn("c1", F.greatest(a, b))
    bands = [F.col("c0") + 1, F.col("c1") - F.col("c0"), n - F.col("c1") - 1]
    dist = lambda t: F.abs(F.lit(t[1]) - bands[0]) + F.abs(F.lit(t[2]) - bands[1]) + F.abs(F.lit(t[3]) - bands[2])
    best = F.array_min(F.array(*[F.struct(dist(t).alias("d"), F.lit(k).alias("k"), F.lit(t[0]).alias("name"))
                                 for k, t in enumerate(FORMATIONS)]))
    xs = F.col("xs")
    start = F.col("t0") + F.col("w") * window_s
    return g.select(
        "match_id", "period", "team", start.alias("start_s"), (start + window_s).alias("end_s"),
        n.alias("n_players"), F.concat_ws("-", *[b_.cast("string") for b_ in bands]).alias("bands"),
        best["name"].alias("formation"), best["d"].alias("template_distance"),
        ((xs[0] + xs[1] + xs[2] + xs[3]) / 4).alias("def_line_x"))


def ppda(events: DataFrame, player_team: DataFrame, press_zone: float | None = None) -> DataFrame:
    """Opponent passes per own defensive action, whole pitch, both teams of every period."""
    if press_zone is not None:
        raise NotImplementedError("events carry no location, so a press zone cannot be applied")
    sheet = player_team.select("match_id", "player_id", F.col("team").alias("_team"))
    ev = events.join(sheet, ["match_id", "player_id"], "left")
    hit = lambda team, labels: F.count(F.when((F.col("_team") == team) & F.col("label").isin(*labels), 1))
    g = ev.groupBy("match_id", "period").agg(
        hit(HOME, PASSES).alias("hp"), hit(AWAY, PASSES).alias("ap"),
        hit(HOME, DEFENSIVE).alias("hd"), hit(AWAY, DEFENSIVE).alias("ad"))
    both = F.explode(F.array(
        F.struct(F.lit(HOME).alias("team"), F.col("ap").alias("opp_passes"), F.col("hd").alias("def_actions")),
        F.struct(F.lit(AWAY).alias("team"), F.col("hp").alias("opp_passes"), F.col("ad").alias("def_actions"))))
    g = g.select("match_id", "period", both.alias("r")).select("match_id", "period", "r.*")
    return g.withColumn("ppda", F.col("opp_passes") / F.nullif(F.col("def_actions"), F.lit(0)))


def ppda_rollup(events: DataFrame, player_team: DataFrame) -> DataFrame:
    """PPDA per period with the whole match as period null."""
    p = ppda(events, player_team)
    both = p.withColumn("period", F.explode(F.array(F.col("period"), F.lit(None).cast("int"))))
    g = both.groupBy("match_id", "team", "period").agg(
        F.sum("opp_passes").alias("opp_passes"), F.sum("def_actions").alias("def_actions"))
    return g.withColumn("ppda", F.col("opp_passes") / F.nullif(F.col("def_actions"), F.lit(0)))


def with_ball(tracks: DataFrame) -> DataFrame:
    """Every row of a frame gets that frame's ball (lowest track id when several); one exchange."""
    b = F.when(F.col("role") == "ball", F.struct("track_id", "x", "y"))
    w = Window.partitionBy("match_id", "frame_idx")
    return (tracks.withColumn("_b", F.min(b).over(w))
            .withColumn("ball_x", F.col("_b.x")).withColumn("ball_y", F.col("_b.y")).drop("_b"))


def players_with_ball(tracks: DataFrame) -> DataFrame:
    """Players of frames that have a ball, with their distance to it."""
    t = with_ball(tracks).filter(is_playing() & F.col("ball_x").isNotNull())
    return t.withColumn("ball_dist", F.hypot(F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")))


def one_status_per_frame(possession: DataFrame) -> DataFrame:
    """The first status of a frame when a feed repeats it."""
    return possession.groupBy("match_id", "frame_idx").agg(
        F.min_by("ball_status", F.struct("timestamp", "ball_status")).alias("ball_status"))


def press_distance(tracks: DataFrame, possession: DataFrame, every: int = 25) -> DataFrame:
    """Distances of the team out of possession to the ball, per sampled frame."""
    t = players_with_ball(sample_every(tracks, every))
    p = t.join(one_status_per_frame(sample_every(possession, every))
               .filter(F.col("ball_status").isin("HOME", "AWAY")), ["match_id", "frame_idx"])
    pressing = F.when(F.col("ball_status") == "HOME", AWAY).otherwise(HOME)
    d = F.when(F.col("team") == pressing, F.col("ball_dist"))
    g = p.groupBy("match_id", "frame_idx", "ball_status").agg(
        F.min("timestamp").alias("timestamp"), F.min("period").alias("period"),
        F.min(d).alias("nearest_m"), F.sort_array(F.collect_list(d)).alias("_ds"),
        F.count(F.when(d <= 5, 1)).cast("int").alias("n_within_5m"),
        F.count(F.when(d <= 10, 1)).cast("int").alias("n_within_10m"))
    g = g.filter(F.col("nearest_m").isNotNull())
    return g.select(
        "match_id", "frame_idx", "timestamp", "period",
        F.when(F.col("ball_status") == "HOME", HOME).otherwise(AWAY).alias("in_possession"),
        pressing.alias("pressing_team"), "nearest_m",
        F.try_element_at("_ds", F.lit(2)).alias("second_nearest_m"), "n_within_5m", "n_within_10m")


def zone_occupancy(tracks: DataFrame, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> DataFrame:
    """Share of each team's positions per third of the length and channel of the width."""
    p = players(tracks).filter(F.col("team").isin(*TEAMS))
    s = attacking_sign()
    third = F.width_bucket(F.col("x") * s, F.lit(-length / 2), F.lit(length / 2), F.lit(3))
    channel = F.width_bucket(F.col("y") * s, F.lit(-width / 2), F.lit(width / 2), F.lit(3))
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(3)).cast("int")
    g = p.groupBy("match_id", "team", clamp(third).alias("third"), clamp(channel).alias("channel")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("match_id", "team")
    return g.withColumn("share", F.col("n") / F.sum("n").over(w))


def block_summary(block: DataFrame) -> DataFrame:
    return block.groupBy("match_id", "period", "team").agg(
        F.avg("def_line_x").alias("def_line"), F.avg("width_m").alias("width"),
        F.avg("depth_m").alias("depth"), F.avg("compactness_m").alias("compact"))


def formation_summary(formations: DataFrame) -> DataFrame:
    """Most common formation per period and team; ties go to the alphabetically first."""
    n = formations.groupBy("match_id", "period", "team", "formation").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("match_id", "period", "team").agg(
        F.min_by("formation", F.struct(-F.col("n"), "formation")).alias("formation"))


def press_summary(press: DataFrame) -> DataFrame:
    from ..functions.quantiles import exact_percentiles
    keys = ["match_id", "pressing_team"]
    means = press.groupBy(*keys).agg(F.avg("n_within_5m").alias("within5"), F.avg("n_within_10m").alias("within10"))
    return means.join(exact_percentiles(press, keys, "nearest_m", {"nearest": 0.5}), keys)


def transition_summary(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("match_id", "period", "won_by").agg(
        F.count(F.lit(1)).alias("n"), F.avg("won_at_x").alias("won_at_x"), F.avg("gain_m").alias("gain_m"))


def track_span(tracks: DataFrame) -> DataFrame:
    """Frame count and duration of each match."""
    return tracks.groupBy("match_id").agg((F.max("frame_idx") + 1).alias("n_frames"),
                                          F.max("timestamp").alias("duration_s"))


def distinct_frames(tracks: DataFrame) -> DataFrame:
    """(match_id, frame_idx, period, timestamp), one row per frame: those of its smallest track_id."""
    return tracks.groupBy("match_id", "frame_idx").agg(F.min_by("period", "track_id").alias("period"),
                                                       F.min_by("timestamp", "track_id").alias("timestamp"))
