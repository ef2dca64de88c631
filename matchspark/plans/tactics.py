"""Shape, pressing, possession and sequence queries."""
from __future__ import annotations

import re

from functools import wraps

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import possession as P
from ..operators import sequences as Q
from ..operators import shape as H
from . import derive as D
from .registry import CTE, define, query


def norm(spark, sf):
    return H.normalise_direction(D.tracks(spark, sf))


# ------------------------------------------------------------------ views, filters, direction

@query("conform_tracks", """SELECT match_id, frame_idx, period, "timestamp", track_id, role, team, jersey,
 x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y, z, interpolated, live_wide, shot FROM tracks""", "x y jersey z timestamp")
def conform_tracks(spark, sf):
    raw = D.tracks(spark, sf).select(
        "match_id", F.col("frame_idx").cast("string").alias("frame_idx"), "period", "timestamp", "track_id",
        F.when(F.col("role") != "unknown", F.col("role")).alias("role"),
        F.when(F.col("team") != "unknown", F.col("team")).alias("team"), "jersey", "x", "y",
        F.coalesce("z", F.lit(float("nan"))).alias("z"))
    c = S.conform(raw)
    return c.select("match_id", "frame_idx", "period", "timestamp", "track_id", "role", "team", "jersey",
                    "x", "y", "z", "interpolated", "live_wide", "shot")


@query("player_views", """SELECT match_id, team, count(*) AS n_players, count(*) FILTER (role = 'goalkeeper') AS n_keepers,
 max(frame_idx) AS last_frame FROM tracks WHERE role IN ('player','goalkeeper') GROUP BY ALL""")
def player_views(spark, sf):
    return S.players(D.tracks(spark, sf)).groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("n_players"), F.count(F.when(F.col("role") == "goalkeeper", 1)).alias("n_keepers"),
        F.max("frame_idx").alias("last_frame"))


@query("ball_view", "SELECT match_id, frame_idx, x, y FROM tracks WHERE role = 'ball'", "x y")
def ball_view(spark, sf):
    return S.ball(D.tracks(spark, sf)).select("match_id", "frame_idx", "x", "y")


@query("frame_view", "SELECT match_id, frame_idx, track_id, x, y FROM tracks WHERE frame_idx = 100", "x y")
def frame_view(spark, sf):
    return S.frame(D.tracks(spark, sf), 100).select("match_id", "frame_idx", "track_id", "x", "y")


@query("team_view", """SELECT match_id, frame_idx, count(*) AS n, avg(x) AS mx FROM tracks
 WHERE role IN ('player','goalkeeper') AND team = 'away' GROUP BY ALL""", "mx")
def team_view(spark, sf):
    return S.team(D.tracks(spark, sf), "away").groupBy("match_id", "frame_idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"))


@query("on_pitch", """SELECT match_id, role, count(*) AS n, sum(x) AS sx FROM tracks
 WHERE abs(x) <= 52.5 - 12.5 + CASE WHEN role = 'ball' THEN 10 ELSE 2 END
 AND abs(y) <= 34 - 14 + CASE WHEN role = 'ball' THEN 10 ELSE 2 END GROUP BY ALL""", "sx")
def on_pitch(spark, sf):
    return H.on_pitch(D.tracks(spark, sf), 2.0, 10.0, 80.0, 40.0).groupBy("match_id", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))


@query("stride_frames", """SELECT match_id, frame_idx // 3 AS frame_idx, (frame_idx // 3) * 3 / 25.0::DOUBLE AS "timestamp",
 count(*) AS n FROM tracks WHERE frame_idx % 3 = 0 GROUP BY ALL""", "timestamp")
def stride_frames(spark, sf):
    out, _ = H.stride(D.tracks(spark, sf), 3, S.FPS)
    return out.groupBy("match_id", "frame_idx", "timestamp").agg(F.count(F.lit(1)).alias("n"))


@query("live_only", """SELECT match_id, shot, count(*) AS n, min(frame_idx) AS first_frame FROM tracks_shots
 WHERE live_wide GROUP BY ALL""")
def live_only(spark, sf):
    return Q.live_only(D.tracks_shots(spark, sf)).groupBy("match_id", "shot").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_frame"))


@query("inside_share", """SELECT match_id, avg((abs(x) <= 54.5 AND abs(y) <= 36)::INT) AS inside_share FROM tracks
 WHERE role IN ('player','goalkeeper') GROUP BY ALL""", "inside_share")
def inside_share(spark, sf):
    return H.inside_share(D.tracks(spark, sf))


define("per_track_x", """SELECT match_id, period, team, track_id, avg(x) AS mx, sum(x) FILTER (role = 'goalkeeper') AS kx,
 count(*) FILTER (role = 'goalkeeper') AS kn FROM tracks WHERE role IN ('player','goalkeeper') GROUP BY ALL""")


@query("attacking_directions", """SELECT match_id, period, team, CASE WHEN coalesce(sum(kx)/nullif(sum(kn),0),
 arg_max(mx, abs(mx))) > 0 THEN -1 ELSE 1 END AS direction FROM per_track_x GROUP BY match_id, period, team""", cte=True)
def attacking_directions(spark, sf):
    return H.attacking_directions(D.tracks(spark, sf))


@query("attacking_directions_unlabelled", """SELECT match_id, period, team, CASE WHEN
 arg_max(mx, abs(mx)) > 0 THEN -1 ELSE 1 END AS direction FROM per_track_x GROUP BY match_id, period, team""")
def attacking_directions_unlabelled(spark, sf):
    return H.attacking_directions(D.tracks(spark, sf).withColumn(
        "role", F.when(F.col("role") == "goalkeeper", "player").otherwise(F.col("role"))))


define("period_sign", """SELECT match_id, period, coalesce(max(direction) FILTER (team = 'home'),
 -max(direction) FILTER (team = 'away'), -1) AS sgn FROM attacking_directions GROUP BY match_id, period""")
define("norm", """SELECT t.* REPLACE (x * coalesce(sgn, -1) AS x, y * coalesce(sgn, -1) AS y)
 FROM tracks t LEFT JOIN period_sign s USING (match_id, period)""")


@query("normalise_direction", """SELECT match_id, frame_idx, track_id, x, y FROM norm""", "x y")
def normalise_direction(spark, sf):
    return norm(spark, sf).select("match_id", "frame_idx", "track_id", "x", "y")


@query("attacking_sign", """SELECT match_id, team, CASE WHEN team = 'home' THEN 1 ELSE -1 END AS sgn,
 avg(x * CASE WHEN team = 'home' THEN 1 ELSE -1 END) AS mean_forward FROM norm WHERE role = 'player' GROUP BY match_id, team""",
       "mean_forward")
def attacking_sign(spark, sf):
    s = S.attacking_sign()
    return (norm(spark, sf).filter(F.col("role") == "player").withColumn("sgn", s)
            .groupBy("match_id", "team", "sgn").agg(F.avg(F.col("x") * F.col("sgn")).alias("mean_forward")))


define("keeper_stats", """SELECT match_id, team, track_id, count(*) AS n, avg(x) AS mx,
 count(*) FILTER (role = 'goalkeeper') AS kn, max(count(*)) OVER (PARTITION BY match_id, team) AS most
 FROM norm WHERE role IN ('player','goalkeeper') GROUP BY match_id, team, track_id""")


@query("goalkeepers", """SELECT match_id, team, coalesce(arg_max(track_id, kn * 100000 - track_id) FILTER (kn > 0),
 arg_max(track_id, abs(mx)) FILTER (n > most * 0.3)) AS keeper_id FROM keeper_stats GROUP BY match_id, team""", cte=True)
def goalkeepers(spark, sf):
    return H.goalkeepers(norm(spark, sf))


# ------------------------------------------------------------------ block, formation, pressing

BLOCK = """SELECT match_id, frame_idx, period, team, min(ts_all) AS "timestamp", count(*)::INT AS n_outfield,
 list_aggregate(list_sort(list(x*s))[1:4], 'avg') AS def_line_x, list_aggregate(list_sort(list(x*s))[-2:], 'avg') AS fwd_line_x,
 max(x*s) - min(x*s) AS depth_m, max(y) - min(y) AS width_m, any_value(mx) * any_value(s) AS centroid_x, any_value(my) AS centroid_y,
 avg(sqrt((x-mx)*(x-mx) + (y-my)*(y-my))) AS compactness_m, any_value(s) AS attacking_sign
 FROM (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM (
   SELECT n.*, CASE WHEN n.team = 'home' THEN 1 ELSE -1 END AS s, min("timestamp") OVER (PARTITION BY match_id, frame_idx, n.team) AS ts_all
   FROM {src} n JOIN goalkeepers k USING (match_id, team) WHERE role IN ('player','goalkeeper') AND frame_idx % {every} = 0
   QUALIFY track_id <> keeper_id) WINDOW w AS (PARTITION BY match_id, frame_idx, period, team))
 GROUP BY match_id, frame_idx, period, team HAVING count(*) >= 6"""
BLOCK_DOUBLES = "timestamp def_line_x fwd_line_x depth_m width_m centroid_x centroid_y compactness_m"
define("block25", BLOCK.format(src="norm", every=25))
define("block5", BLOCK.format(src="norm", every=5))


@query("team_block", "SELECT * FROM block25", BLOCK_DOUBLES)
def team_block(spark, sf):
    return H.team_block(norm(spark, sf))


@query("low_blocks_per_match", """SELECT match_id, team, count(*) AS n_low_blocks, sum(dur) AS seconds FROM (
 SELECT match_id, team, period, run, (max(frame_idx) - min(frame_idx) + 5) / 25.0::DOUBLE AS dur FROM (
 SELECT *, sum(CASE WHEN pf IS NULL OR frame_idx - pf > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, team, period ORDER BY frame_idx) AS run
 FROM (SELECT *, lag(frame_idx) OVER (PARTITION BY match_id, team, period ORDER BY frame_idx) AS pf FROM block5
 WHERE def_line_x <= -22.5 AND compactness_m <= 14)) GROUP BY ALL) WHERE dur >= 8 GROUP BY match_id, team""", "seconds")
def low_blocks_per_match(spark, sf):
    return Q.low_blocks_per_match(norm(spark, sf))


define("formations", """SELECT * FROM (VALUES (0,'4-4-2',4,4,2),(1,'4-3-3',4,3,3),(2,'4-2-3-1',4,5,1),(3,'3-5-2',3,5,2),
 (4,'5-3-2',5,3,2),(5,'4-5-1',4,5,1),(6,'3-4-3',3,4,3),(7,'5-4-1',5,4,1)) t(k,name,a,b,c)""")
define("formation_windows", """SELECT match_id, period, team, w, t0, track_id, avg(x) AS mx, count(*) AS n,
 max(count(*)) OVER (PARTITION BY match_id, period, team, w) AS most FROM (
 SELECT *, CAST(floor(("timestamp" - t0)/30) AS INT) AS w FROM (SELECT n.*, min("timestamp") OVER g AS t0, max("timestamp") OVER g AS t1
 FROM norm n JOIN goalkeepers k USING (match_id, team) WHERE role IN ('player','goalkeeper') AND frame_idx % 25 = 0 AND track_id <> keeper_id
 WINDOW g AS (PARTITION BY match_id, period, n.team))) WHERE t0 + w*30 < t1 GROUP BY match_id, period, team, w, t0, track_id""")
define("formation_xs", """SELECT match_id, period, team, w, t0, list_sort(list(mx * CASE WHEN team = 'home' THEN 1 ELSE -1 END)) AS xs
 FROM formation_windows WHERE n >= most * 0.5 GROUP BY match_id, period, team, w, t0 HAVING count(*) >= 8""")
define("formation_bands", """SELECT match_id, period, team, w, any_value(t0) AS t0, any_value(xs) AS xs, min(i) AS c0, max(i) AS c1 FROM (
 SELECT *, row_number() OVER (PARTITION BY match_id, period, team, w ORDER BY round(xs[i+2] - xs[i+1], 9) DESC, i DESC) AS rk
 FROM (SELECT *, unnest(range(len(xs) - 1)) AS i FROM formation_xs)) WHERE rk <= 2 GROUP BY match_id, period, team, w""")


@query("formation_over_time", """SELECT match_id, period, team, start_s, start_s + 30 AS end_s, n_players, bands, name AS formation,
 d AS template_distance, def_line_x FROM (SELECT *, t0 + w*30.0::DOUBLE AS start_s, len(xs)::INT AS n_players,
 concat(b0,'-',b1,'-',b2) AS bands, (abs(a-b0)+abs(b-b1)+abs(c-b2))::INT AS d, list_aggregate(xs[1:4],'avg') AS def_line_x
 FROM (SELECT *, c0+1 AS b0, c1-c0 AS b1, len(xs)-c1-1 AS b2 FROM formation_bands), formations)
 QUALIFY row_number() OVER (PARTITION BY match_id, period, team, w ORDER BY d, k) = 1""",
       "start_s end_s def_line_x", cte=True)
def formation_over_time(spark, sf):
    return H.formation_over_time(norm(spark, sf), window_s=30.0)


define("event_team", """SELECT e.*, s.team AS tm FROM action_events e LEFT JOIN team_sheet s USING (match_id, player_id)""")


@query("ppda", """SELECT match_id, period, team, count(*) FILTER (tm <> team AND label IN ('PASS','HIGH PASS','CROSS')) AS opp_passes,
 count(*) FILTER (tm = team AND label IN ('PLAYER SUCCESSFUL TACKLE','BALL PLAYER BLOCK')) AS def_actions,
 (count(*) FILTER (tm <> team AND label IN ('PASS','HIGH PASS','CROSS')))::DOUBLE / nullif(count(*) FILTER
 (tm = team AND label IN ('PLAYER SUCCESSFUL TACKLE','BALL PLAYER BLOCK')), 0) AS ppda
 FROM event_team, (VALUES ('home'),('away')) t(team) GROUP BY match_id, period, team""", "ppda", cte=True)
def ppda(spark, sf):
    return H.ppda(D.action_events(spark, sf), D.team_sheet(spark, sf))


@query("ppda_rollup", """SELECT match_id, team, period, sum(opp_passes)::BIGINT AS opp_passes, sum(def_actions)::BIGINT AS def_actions,
 sum(opp_passes)::DOUBLE / nullif(sum(def_actions), 0) AS ppda FROM ppda GROUP BY GROUPING SETS ((match_id, team, period), (match_id, team))""", "ppda")
def ppda_rollup(spark, sf):
    return H.ppda_rollup(D.action_events(spark, sf), D.team_sheet(spark, sf))


define("norm_ball", """SELECT match_id, frame_idx, arg_min(x, track_id) AS bx, arg_min(y, track_id) AS bly FROM norm WHERE role = 'ball' GROUP BY match_id, frame_idx""")
PRESS = """SELECT match_id, frame_idx, min("timestamp") AS "timestamp", min(period) AS period,
 CASE WHEN ball_status = 'HOME' THEN 'home' ELSE 'away' END AS in_possession, CASE WHEN ball_status = 'HOME' THEN 'away' ELSE 'home' END AS pressing_team,
 min(d) AS nearest_m, (list_sort(list(d) FILTER (d IS NOT NULL)))[2] AS second_nearest_m,
 (count(*) FILTER (d <= 5))::INT AS n_within_5m, (count(*) FILTER (d <= 10))::INT AS n_within_10m FROM (
 SELECT n.*, p.ball_status, CASE WHEN (p.ball_status = 'HOME') = (n.team = 'away') THEN sqrt((x-bx)*(x-bx)+(y-bly)*(y-bly)) END AS d
 FROM {src} n JOIN norm_ball USING (match_id, frame_idx) JOIN possession_gt p USING (match_id, frame_idx)
 WHERE role IN ('player','goalkeeper') AND frame_idx % {every} = 0 AND p.ball_status IN ('HOME','AWAY'))
 GROUP BY match_id, frame_idx, ball_status HAVING min(d) IS NOT NULL"""
define("press25", PRESS.format(src="norm", every=25))
define("press5", PRESS.format(src="norm", every=5))


@query("press_distance", "SELECT * FROM press25", "timestamp nearest_m second_nearest_m")
def press_distance(spark, sf):
    return H.press_distance(norm(spark, sf), D.possession_gt(spark, sf))


FLANK = """SELECT match_id, frame_idx, team, CASE WHEN la - ld > ra - rd THEN 'left' ELSE 'right' END AS flank,
 (CASE WHEN la - ld > ra - rd THEN la ELSE ra END)::INT AS n_attackers, (CASE WHEN la - ld > ra - rd THEN ld ELSE rd END)::INT AS n_defenders,
 seen::INT AS n_visible, opp::INT AS n_visible_opp FROM (SELECT match_id, frame_idx, team,
 count(*) FILTER (own AND gx >= 0 AND gy >= 34.0::DOUBLE/3) AS ra, count(*) FILTER (NOT own AND gx >= 0 AND gy >= 34.0::DOUBLE/3) AS rd,
 count(*) FILTER (own AND gx >= 0 AND gy <= -34.0::DOUBLE/3) AS la, count(*) FILTER (NOT own AND gx >= 0 AND gy <= -34.0::DOUBLE/3) AS ld,
 count(*) FILTER (own) AS seen, count(*) FILTER (NOT own) AS opp FROM (
 SELECT match_id, frame_idx, t.team, n.team = t.team AS own, x * t.s AS gx, y * t.s AS gy FROM {src} n, (VALUES ('home', 1),('away', -1)) t(team, s)
 WHERE role IN ('player','goalkeeper') AND frame_idx % 5 = 0 AND abs(x) <= 52.5 AND abs(y) <= 34) GROUP BY ALL)"""
define("flank5", FLANK.format(src="norm"))


@query("flank_counts", "SELECT * FROM flank5")
def flank_counts(spark, sf):
    return Q.flank_counts(norm(spark, sf))


@query("zone_occupancy", """SELECT match_id, team, third, channel, n, n / sum(n) OVER (PARTITION BY match_id, team) AS share FROM (
 SELECT match_id, team, CAST(least(greatest(floor((x*s + 52.5)/35) + 1, 1), 3) AS INT) AS third,
 CAST(least(greatest(floor((y*s + 34)/(68.0::DOUBLE/3)) + 1, 1), 3) AS INT) AS channel, count(*) AS n
 FROM (SELECT *, CASE WHEN team = 'home' THEN 1 ELSE -1 END AS s FROM norm WHERE role IN ('player','goalkeeper')) GROUP BY ALL)""", "share")
def zone_occupancy(spark, sf):
    return H.zone_occupancy(norm(spark, sf))


@query("block_summary", """SELECT match_id, period, team, avg(def_line_x) AS def_line, avg(width_m) AS width, avg(depth_m) AS depth,
 avg(compactness_m) AS compact FROM block25 GROUP BY match_id, period, team""", "def_line width depth compact")
def block_summary(spark, sf):
    return H.block_summary(H.team_block(norm(spark, sf)))


@query("formation_summary", """SELECT match_id, period, team, arg_min(formation, (-n, formation)) AS formation FROM (
 SELECT match_id, period, team, formation, count(*) AS n FROM formation_over_time GROUP BY ALL) GROUP BY match_id, period, team""")
def formation_summary(spark, sf):
    return H.formation_summary(H.formation_over_time(norm(spark, sf), window_s=30.0))


@query("press_summary", """SELECT match_id, pressing_team, avg(n_within_5m) AS within5, avg(n_within_10m) AS within10, median(nearest_m) AS nearest
 FROM press25 GROUP BY match_id, pressing_team""", "within5 within10 nearest")
def press_summary(spark, sf):
    return H.press_summary(H.press_distance(norm(spark, sf), D.possession_gt(spark, sf)))


@query("track_span", """SELECT match_id, max(frame_idx) + 1 AS n_frames, max("timestamp") AS duration_s FROM tracks GROUP BY match_id""", "duration_s")
def track_span(spark, sf):
    return H.track_span(D.tracks(spark, sf))


# ------------------------------------------------------------------ ball joins and possession

define("player_ball", """SELECT n.*, bx AS ball_x, bly AS ball_y, sqrt((x-bx)*(x-bx)+(y-bly)*(y-bly)) AS ball_dist
 FROM norm n JOIN norm_ball USING (match_id, frame_idx) WHERE role IN ('player','goalkeeper')""")


@query("players_with_ball", "SELECT match_id, frame_idx, track_id, ball_x, ball_y, ball_dist FROM player_ball", "ball_x ball_y ball_dist")
def players_with_ball(spark, sf):
    return H.players_with_ball(norm(spark, sf)).select(
        "match_id", "frame_idx", "track_id", "ball_x", "ball_y", "ball_dist")


define("control", """SELECT f.match_id, f.frame_idx, f.period, f."timestamp", CASE WHEN bx IS NULL THEN 'NONE'
 WHEN abs(bx) > 53.5 OR abs(bly) > 35 THEN 'BALLOUT' WHEN d <= 2 THEN upper(team) ELSE 'FREE' END AS control
 FROM frames f LEFT JOIN norm_ball USING (match_id, frame_idx) LEFT JOIN (SELECT match_id, frame_idx, min(ball_dist) AS d,
 arg_min(team, (ball_dist, track_id)) AS team FROM player_ball GROUP BY match_id, frame_idx) USING (match_id, frame_idx)""")


@query("control_frames", "SELECT * FROM control", "timestamp")
def control_frames(spark, sf):
    return P.control_frames(norm(spark, sf))


define("poss_gap", """SELECT *, sum((control <> 'NONE')::INT) OVER (PARTITION BY match_id ORDER BY frame_idx) AS g FROM control""")
define("poss_marker", """SELECT *, CASE WHEN control IN ('HOME','AWAY','BALLOUT') THEN control
 WHEN control = 'NONE' AND count(*) FILTER (control = 'NONE') OVER (PARTITION BY match_id, g) > 50 THEN 'UNKNOWN' END AS m FROM poss_gap""")
define("poss_island", """SELECT *, sum((pm IS NULL OR pm <> m)::INT) OVER (PARTITION BY match_id ORDER BY frame_idx) AS isl FROM (
 SELECT *, lag(m) OVER (PARTITION BY match_id ORDER BY frame_idx) AS pm FROM poss_marker WHERE m IS NOT NULL)""")
define("poss_taken", """SELECT match_id, frame_idx, CASE WHEN m IN ('BALLOUT','UNKNOWN') THEN m
 WHEN row_number() OVER (PARTITION BY match_id, isl ORDER BY frame_idx) = 1 AND count(*) OVER (PARTITION BY match_id, isl) >= 13 THEN m END AS t FROM poss_island""")


@query("infer_possession", """SELECT match_id, frame_idx, period, "timestamp", coalesce(last_value(t IGNORE NULLS) OVER
 (PARTITION BY match_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS ball_status
 FROM control LEFT JOIN poss_taken USING (match_id, frame_idx)""", "timestamp", cte=True)
def infer_possession(spark, sf):
    return P.infer_possession(norm(spark, sf))


define("runs_of_possession", """SELECT match_id, run, any_value(ball_status) AS team, min(frame_idx) AS f0, max(frame_idx) AS f1,
 arg_min(period, frame_idx) AS period, min("timestamp") AS t0, (max(frame_idx) - min(frame_idx)) / 25.0::DOUBLE AS len_s FROM (
 SELECT *, sum((p IS NULL OR p <> ball_status)::INT) OVER (PARTITION BY match_id ORDER BY frame_idx) AS run FROM (
 SELECT *, lag(ball_status) OVER (PARTITION BY match_id ORDER BY frame_idx) AS p FROM possession_gt WHERE ball_status IN ('HOME','AWAY')))
 GROUP BY match_id, run""")


@query("possession_runs", """SELECT match_id, team, f0 AS start_frame, f1 AS end_frame, period, t0, len_s FROM runs_of_possession""", "t0 len_s")
def possession_runs(spark, sf):
    return P.possession_runs(D.possession_gt(spark, sf)).select(
        "match_id", "team", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "period", "t0", "len_s")


define("turnovers", """SELECT *, lag(team) OVER (PARTITION BY match_id ORDER BY f0) AS pt FROM runs_of_possession WHERE len_s >= 1.5 QUALIFY pt <> team""")


@query("transitions", """SELECT t.match_id, any_value(t.period) AS period, any_value(t.t0) AS "timestamp", f0 AS frame_idx, any_value(lower(t.team)) AS won_by,
 max(bx) FILTER (b.frame_idx = f0) * any_value(s) AS won_at_x, max(bly) FILTER (b.frame_idx = f0) AS won_at_y, any_value(len_s) AS hold_s,
 (arg_max(bx, b.frame_idx) FILTER (b.frame_idx > f0) - max(bx) FILTER (b.frame_idx = f0)) * any_value(s) AS gain_m
 FROM (SELECT *, CASE WHEN team = 'HOME' THEN 1 ELSE -1 END AS s FROM turnovers) t JOIN norm_ball b ON b.match_id = t.match_id
 AND b.frame_idx BETWEEN f0 AND f0 + 125 GROUP BY t.match_id, f0 HAVING count(*) FILTER (b.frame_idx = f0) > 0""",
       "timestamp won_at_x won_at_y hold_s gain_m", cte=True)
def transitions(spark, sf):
    return P.transitions(norm(spark, sf), D.possession_gt(spark, sf))


@query("transition_summary", """SELECT match_id, period, won_by, count(*) AS n, avg(won_at_x) AS won_at_x, avg(gain_m) AS gain_m FROM transitions
 GROUP BY match_id, period, won_by""", "won_at_x gain_m")
def transition_summary(spark, sf):
    return H.transition_summary(P.transitions(norm(spark, sf), D.possession_gt(spark, sf)))


@query("possession_orientation_check", """SELECT match_id, count(*) FILTER (ok) AS agree, count(*) FILTER (NOT ok) AS disagree,
 count(*) FILTER (NOT ok) > count(*) FILTER (ok) AS swapped FROM (SELECT match_id, frame_idx, (CASE WHEN min(ball_dist) FILTER (team='away') <
 min(ball_dist) FILTER (team='home') THEN 'AWAY' ELSE 'HOME' END) = any_value(ball_status) AS ok FROM player_ball JOIN (
 SELECT match_id, frame_idx, ball_status FROM possession_gt JOIN norm_ball USING (match_id, frame_idx)
 WHERE ball_status IN ('HOME','AWAY')) USING (match_id, frame_idx)
 GROUP BY match_id, frame_idx) GROUP BY match_id""")
def possession_orientation_check(spark, sf):
    return P.possession_orientation_check(norm(spark, sf), D.possession_gt(spark, sf))


@query("swap_team_labels", """SELECT match_id, track_id, team, count(*) AS n FROM tracks GROUP BY match_id, track_id, team""")
def swap_team_labels(spark, sf):
    """Labels turned the wrong way round are detected and put back."""
    t = norm(spark, sf)
    flip = F.when(F.col("team") == "home", "away").when(F.col("team") == "away", "home").otherwise(F.col("team"))
    bad = t.withColumn("team", flip)
    fixed = P.swap_team_labels(bad, P.possession_orientation_check(bad, D.possession_gt(spark, sf)))
    return fixed.groupBy("match_id", "track_id", "team").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_frames", """SELECT match_id, frame_idx, period, "timestamp" FROM frames""", "timestamp")
def distinct_frames(spark, sf):
    return H.distinct_frames(D.tracks(spark, sf))


# ------------------------------------------------------------------ sequences

define("lookups", """SELECT b.*, 0 AS shot, coalesce(p.ball_status = CASE WHEN b.team = 'home' THEN 'AWAY' ELSE 'HOME' END, FALSE) AS out_of_possession,
 coalesce(p.ball_status = upper(b.team), FALSE) AS in_possession, bx * b.attacking_sign AS ball_x_own, coalesce(flank, '') AS flank,
 coalesce(n_within_10m, 0) AS n_within_10m, coalesce(n_attackers, 0) AS n_attackers, coalesce(n_defenders, 0) AS n_defenders,
 coalesce(n_visible, 0) AS n_visible, coalesce(n_visible_opp, 0) AS n_visible_opp
 FROM block5 b LEFT JOIN possession_gt p USING (match_id, frame_idx) LEFT JOIN norm_ball USING (match_id, frame_idx)
 LEFT JOIN (SELECT match_id, frame_idx, pressing_team AS team, n_within_10m FROM press5) USING (match_id, frame_idx, team)
 LEFT JOIN flank5 USING (match_id, frame_idx, team)""")


@query("frame_lookups", """SELECT match_id, frame_idx, team, shot, out_of_possession, in_possession, ball_x_own, flank, n_within_10m, n_attackers,
 n_defenders, n_visible, n_visible_opp FROM lookups""", "ball_x_own")
def frame_lookups(spark, sf):
    out = Q.frame_lookups(norm(spark, sf), D.possession_gt(spark, sf))
    return out.select("match_id", "frame_idx", "team", "shot", "out_of_possession", "in_possession", "ball_x_own", "flank",
                      "n_within_10m", "n_attackers", "n_defenders", "n_visible", "n_visible_opp")


define("hits", """SELECT *, 'low_block' AS label, '' AS rf, 8 AS min_s FROM lookups WHERE out_of_possession AND def_line_x <= -22.5 AND compactness_m <= 14
 UNION ALL SELECT *, 'high_press', '', 3 FROM lookups WHERE out_of_possession AND def_line_x >= 7.5 AND ball_x_own >= 17.5 AND n_within_10m >= 3
 UNION ALL SELECT *, 'flank_overload', flank, 3 FROM lookups WHERE n_attackers >= 4 AND n_defenders <= 3 AND n_visible >= 7 AND n_visible_opp >= 7""")
SEQ = """SELECT match_id, label, team, period, arg_min("timestamp", frame_idx) AS start_s, arg_max("timestamp", frame_idx) + 0.2::DOUBLE AS end_s,
 min(frame_idx) AS start_frame, max(frame_idx) + 4 AS end_frame, (max(frame_idx) - min(frame_idx) + 5)/25.0::DOUBLE AS duration_s,
 avg(def_line_x) AS def_line_x, avg(compactness_m) AS compactness_m, max(n_within_10m) AS n_within_10m, rf AS flank,
 max(n_attackers) AS n_attackers, max(n_defenders) AS n_defenders, avg(in_possession::INT) AS in_possession_share FROM (
 SELECT *, sum((pf IS NULL OR frame_idx - pf > 10 OR shot <> ps)::INT) OVER (PARTITION BY match_id, label, team, period, rf ORDER BY frame_idx) AS run
 FROM (SELECT *, lag(frame_idx) OVER w AS pf, lag(shot) OVER w AS ps FROM hits WINDOW w AS (PARTITION BY match_id, label, team, period, rf ORDER BY frame_idx)))
 GROUP BY match_id, label, team, period, rf, run"""
SEQ_DOUBLES = "start_s end_s duration_s def_line_x compactness_m in_possession_share"


@query("sequence_runs", SEQ, SEQ_DOUBLES)
def sequence_runs(spark, sf):
    looked = Q.frame_lookups(norm(spark, sf), D.possession_gt(spark, sf))
    return Q.sequence_runs(Q.sequence_hits(looked), 5)


@query("detect_sequences", f"""SELECT * FROM ({SEQ}) WHERE duration_s >= CASE WHEN label = 'low_block' THEN 8 ELSE 3 END""", SEQ_DOUBLES, cte=True)
def detect_sequences(spark, sf):
    return Q.detect_sequences(norm(spark, sf), D.possession_gt(spark, sf))


@query("sequence_ids", """SELECT match_id, concat_ws('-', label, team, period, start_frame) AS sequence_id FROM detect_sequences""")
def sequence_ids(spark, sf):
    return Q.detect_sequences(norm(spark, sf), D.possession_gt(spark, sf)).select(
        "match_id", Q.sequence_id().alias("sequence_id"))


@query("sequence_union", """SELECT match_id, label, count(*) AS n, min(start_s) AS first_start FROM detect_sequences GROUP BY match_id, label""", "first_start")
def sequence_union(spark, sf):
    """The labels' sequences in one table, ordered by start and label, summarised per label."""
    s = Q.detect_sequences(norm(spark, sf), D.possession_gt(spark, sf))
    return s.groupBy("match_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("start_s").alias("first_start"))


# ------------------------------------------------------------------ from inferred possession

for _name in ("press5", "lookups", "hits", "runs_of_possession", "turnovers"):
    _text = re.sub(r"\b(press5|lookups|hits|runs_of_possession|turnovers)\b", r"inferred_\1", CTE[_name])
    define(f"inferred_{_name}", re.sub(r"\bpossession_gt\b", "infer_possession", _text))


@query("inferred_sequences", f"""SELECT * FROM ({SEQ.replace("FROM hits", "FROM inferred_hits")}) WHERE duration_s >= CASE WHEN label = 'low_block' THEN 8 ELSE 3 END""", SEQ_DOUBLES)
def inferred_sequences(spark, sf):
    """Sequences from positions alone: possession is inferred, not given."""
    n = norm(spark, sf)
    return Q.detect_sequences(n, P.infer_possession(n))


@query("inferred_transitions", "SELECT match_id, team, f0 AS frame_idx, len_s AS hold_s FROM inferred_turnovers t SEMI JOIN norm_ball b ON b.match_id = t.match_id AND b.frame_idx = f0", "hold_s")
def inferred_transitions(spark, sf):
    n = norm(spark, sf)
    return P.transitions(n, P.infer_possession(n)).select("match_id", F.upper("won_by").alias("team"), "frame_idx", "hold_s")
