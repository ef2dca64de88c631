"""Matching, scoring and detections-table queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ball as B
from ..operators import detections as T
from ..operators import matching as M
from ..operators import possession as P
from ..operators import scoring as C
from ..operators import shape as H
from . import derive as D
from .registry import define, query


def gt(spark, sf):
    return D.as_tracks(D.people(spark, sf))


def pred(spark, sf):
    return D.pred(spark, sf)


# ------------------------------------------------------------------ matching

@query("match_people")
def match_people(spark, sf):
    return M.match_people(gt(spark, sf), pred(spark, sf))


@query("match_people_gated")
def match_people_gated(spark, sf):
    return M.match_people_gated(gt(spark, sf), pred(spark, sf))


@query("tracking_score")
def tracking_score(spark, sf):
    return C.tracking_score(gt(spark, sf), pred(spark, sf))


# Predictions whose best pairing is known: a whole cast moved alike pairs with itself, and so does a part of it moved by less than
# half the least distance between two people (3.3 m here). Ids, teams and roles differ, so nothing but the place can pair them.
define("pred_moved", """SELECT * REPLACE (23 - track_id + CASE WHEN (frame_idx // 50) % 5 = 0 THEN 100 ELSE 0 END AS track_id,
 CASE WHEN (ck + e) % 31 = 0 THEN CASE WHEN team = 'home' THEN 'away' ELSE 'home' END ELSE team END AS team,
 CASE WHEN (ck + e) % 13 = 0 THEN CASE WHEN role = 'player' THEN 'goalkeeper' ELSE 'player' END ELSE role END AS role,
 x + CASE ck % 4 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 3.0::DOUBLE ELSE 300.0::DOUBLE END AS x,
 y + CASE ck % 4 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 0.02::DOUBLE WHEN 2 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END AS y)
 FROM gt WHERE ck % 4 > 1 OR (ck + e) % 9 <> 0""")
define("moved_pairs", """SELECT g.match_id, g.frame_idx, g.track_id AS gt_track, p.track_id AS pred_track, g.role AS gt_role, p.role AS pred_role, g.team AS gt_team, p.team AS pred_team,
 sqrt(power(g.x - p.x, 2) + power(g.y - p.y, 2)) AS dist FROM gt g JOIN pred_moved p ON g.match_id = p.match_id AND g.frame_idx = p.frame_idx AND g.e = p.e""")
define("moved2", "SELECT * FROM moved_pairs WHERE dist <= 2")
define("moved5", "SELECT * FROM moved_pairs WHERE dist <= 5")


def moved(spark, sf):
    at = lambda a: F.expr(f"array({', '.join(f'{v}D' for v in a)})[cast(ck % 4 as int)]")
    key = F.col("ck") + F.col("e")
    return (gt(spark, sf).filter((F.col("ck") % 4 > 1) | (key % 9 != 0))
            .withColumn("track_id", F.expr("cast(23 - track_id + if((frame_idx div 50) % 5 = 0, 100, 0) as int)"))
            .withColumn("team", F.expr("if((ck + e) % 31 = 0, if(team = 'home', 'away', 'home'), team)"))
            .withColumn("role", F.expr("if((ck + e) % 13 = 0, if(role = 'player', 'goalkeeper', 'player'), role)"))
            .withColumn("x", F.col("x") + at((0.3, 0.05, 3.0, 300.0))).withColumn("y", F.col("y") + at((0.4, 0.02, 0.07, 0.0))))


@query("match_people_moved", "SELECT * FROM moved2", "dist")
def match_people_moved(spark, sf):
    return M.match_people(gt(spark, sf), moved(spark, sf))


@query("match_people_gated_moved", "SELECT * FROM moved5", "dist")
def match_people_gated_moved(spark, sf):
    return M.match_people_gated(gt(spark, sf), moved(spark, sf))


@query("tracking_score_moved", """SELECT *, CASE WHEN err_median_m < 0.5 THEN 'fine' WHEN err_median_m < 1.5 THEN 'formation' WHEN err_median_m < 3 THEN 'coarse' ELSE 'unusable' END AS band
 FROM (SELECT match_id, count(*) AS frames_scored, avg(coalesce(h, 0)/g) AS recall, avg(coalesce(h, 0)/p) AS "precision" FROM (SELECT match_id, frame_idx, count(*) AS g FROM gt GROUP BY ALL)
  JOIN (SELECT match_id, frame_idx, count(*) AS p FROM pred_moved GROUP BY ALL) USING (match_id, frame_idx)
  LEFT JOIN (SELECT match_id, frame_idx, count(*) AS h FROM moved5 GROUP BY ALL) USING (match_id, frame_idx) GROUP BY match_id)
 JOIN (SELECT match_id, count(*) AS matched, avg(dist) AS err_mean_m, median(dist) AS err_median_m, quantile_cont(dist, 0.9) AS err_p90_m, quantile_cont(dist, 0.99) AS err_p99_m FROM moved5 GROUP BY match_id) USING (match_id)
 JOIN (SELECT match_id, count(*) FILTER (before <> pred_track) AS id_switches, count(DISTINCT gt_track) AS gt_players_seen FROM (
  SELECT *, lag(pred_track) OVER (PARTITION BY match_id, gt_track ORDER BY frame_idx) AS before FROM moved5) GROUP BY match_id) USING (match_id)""",
       'recall "precision" err_mean_m err_median_m err_p90_m err_p99_m')
def tracking_score_moved(spark, sf):
    return C.tracking_score(gt(spark, sf), moved(spark, sf))


define("frame_times", "SELECT match_id, frame_idx, frame_idx/25.0::DOUBLE AS t FROM frames")
define("near_readings", """SELECT f.match_id, f.frame_idx, f.t, r.ts, r.tag_id, r.x_pitch, r.y_pitch, round(abs(r.ts - f.t), 9) AS dt FROM frame_times f
 JOIN sensor_readings r ON f.match_id = r.match_id AND r.ts BETWEEN f.t - 0.0501 AND f.t + 0.0501 WHERE round(abs(r.ts - f.t), 9) <= 0.05""")


def frame_times(spark, sf):
    return D.frames(spark, sf).select("match_id", "frame_idx", (F.col("frame_idx") / 25.0).alias("t"))


@query("asof_nearest", "SELECT match_id, frame_idx, any_value(t) AS t, arg_min(ts, (dt, ts)) AS ts FROM near_readings GROUP BY match_id, frame_idx", "t ts")
def asof_nearest(spark, sf):
    return M.asof_nearest(frame_times(spark, sf), D.sensor_readings(spark, sf))


@query("interval_join_closest", """SELECT match_id, frame_idx, any_value(t) AS t, tag_id, arg_min(ts, (dt, ts)) AS ts, arg_min(x_pitch, (dt, ts, x_pitch, y_pitch)) AS x_pitch,
 arg_min(y_pitch, (dt, ts, x_pitch, y_pitch)) AS y_pitch FROM near_readings GROUP BY match_id, frame_idx, tag_id""", "t ts x_pitch y_pitch")
def interval_join_closest(spark, sf):
    return M.interval_join_closest(frame_times(spark, sf), D.sensor_readings(spark, sf))


@query("event_asof_nearest", """SELECT user_id, frame_idx, arg_min(ts, (dt, ts)) AS ts FROM (SELECT a.user_id, a.event_id AS frame_idx, b.t AS ts,
 abs(a.t - b.t) AS dt FROM (SELECT user_id, event_id, round(epoch_us(ts)/1e6::DOUBLE - 1704067200, 3) AS t FROM events WHERE event_type = 'click') a
 JOIN (SELECT DISTINCT user_id, round(epoch_us(ts)/1e6::DOUBLE - 1704067200, 3) AS t FROM events WHERE event_type <> 'click') b
 ON a.user_id = b.user_id AND round(abs(a.t - b.t), 9) <= 3600) GROUP BY user_id, frame_idx""", "ts")
def event_asof_nearest(spark, sf):
    """Nearest other event of the same user within an hour of each click."""
    e = D.table(spark, sf, "events").withColumn("t", F.round(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / 1e6, 3))
    clicks = e.filter(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("frame_idx"), "t")
    others = e.filter(F.col("event_type") != "click").select("user_id", F.col("t").alias("ts"))
    return M.asof_nearest(clicks, others, 3600.0, by=("user_id",)).select("user_id", "frame_idx", "ts")


@query("id_switches", """SELECT match_id, count(*) FILTER (p <> pred_track) AS id_switches, count(DISTINCT gt_track) AS gt_players_seen FROM (
 SELECT *, lag(pred_track) OVER (PARTITION BY match_id, gt_track ORDER BY frame_idx) AS p FROM (SELECT match_id, frame_idx, gt_track,
 CASE WHEN (frame_idx // 50) % 5 = 0 THEN pred_track + 100 ELSE pred_track END AS pred_track FROM pairs5)) GROUP BY match_id""")
def id_switches(spark, sf):
    p = D.pairs(spark, sf, 5.0).withColumn("pred_track", F.expr(
        "if((frame_idx div 50) % 5 = 0, pred_track + 100, pred_track)"))
    return M.id_switches(p)


# ------------------------------------------------------------------ accuracy

TURNED = "SELECT p.* REPLACE (x * coalesce(sgn, -1) AS x, y * coalesce(sgn, -1) AS y) FROM {src} p LEFT JOIN period_sign USING (match_id, period)"
define("pred_turned", TURNED.format(src="pred"))
define("pred_playing", "SELECT * FROM pred_turned WHERE role IN ('player','goalkeeper')")
define("gt_turned", TURNED.format(src="gt"))
define("gt_sides", """SELECT match_id, team, CASE WHEN (px <= other) THEN 'left' ELSE 'right' END AS side FROM (SELECT match_id, team, px,
 CASE WHEN team = 'home' THEN max(px) FILTER (team = 'away') OVER (PARTITION BY match_id) ELSE max(px) FILTER (team = 'home') OVER (PARTITION BY match_id) - 1e-12 END AS other
 FROM (SELECT match_id, team, coalesce(avg(x) FILTER (role = 'goalkeeper'), avg(x)) AS px FROM pred_playing GROUP BY match_id, team))""")


def turned(df):
    """Both halves as one: each turned so that home attacks +x, and so defends the left goal."""
    return H.normalise_direction(df)


def sides(spark, sf):
    return C.team_sides(turned(pred(spark, sf)))


@query("team_sides", "SELECT * FROM gt_sides")
def team_sides(spark, sf):
    return sides(spark, sf)


define("side_hits", """SELECT p.match_id, p.gt_role, (CASE WHEN gt_team = 'home' THEN 'left' ELSE 'right' END) = s.side AS ok FROM pairs2 p
 JOIN gt_sides s ON p.match_id = s.match_id AND p.pred_team = s.team""")


@query("team_accuracy", "SELECT match_id, round(avg(ok::INT), 4) AS team_accuracy FROM side_hits GROUP BY match_id", "team_accuracy")
def team_accuracy(spark, sf):
    return C.team_accuracy(D.pairs(spark, sf, 2.0), sides(spark, sf))


@query("keeper_side_accuracy", """SELECT match_id, count(*) FILTER (ok) AS keeper_ok, count(*) AS keeper_n FROM side_hits WHERE gt_role = 'goalkeeper' GROUP BY match_id""")
def keeper_side_accuracy(spark, sf):
    return C.keeper_side_accuracy(D.pairs(spark, sf, 2.0), sides(spark, sf))


@query("role_counts", "SELECT match_id, gt_role, pred_role, count(*) AS n FROM pairs2 GROUP BY ALL")
def role_counts(spark, sf):
    return C.role_counts(D.pairs(spark, sf, 2.0))


@query("role_summary", """SELECT match_id, round(count(*) FILTER (gt_role = 'goalkeeper' AND pred_role = 'goalkeeper')/count(*) FILTER (gt_role = 'goalkeeper'), 4) AS keeper_recall,
 round(count(*) FILTER (gt_role = 'referee' AND pred_role = 'referee')/nullif(count(*) FILTER (gt_role = 'referee'), 0), 4) AS referee_recall,
 round(count(*) FILTER (gt_role = 'referee' AND pred_role = 'referee')/nullif(count(*) FILTER (pred_role = 'referee'), 0), 4) AS referee_precision
 FROM pairs2 GROUP BY match_id""", "keeper_recall referee_recall referee_precision")
def role_summary(spark, sf):
    return C.role_summary(C.role_counts(D.pairs(spark, sf, 2.0)))


# The same metrics from pairs that the matching itself finds.
define("moved_hits", """SELECT p.match_id, p.gt_role, (CASE WHEN gt_team = 'home' THEN 'left' ELSE 'right' END) = s.side AS ok FROM moved2 p
 JOIN gt_sides s ON p.match_id = s.match_id AND p.pred_team = s.team""")


@query("matched_side_accuracy", """SELECT match_id, count(*) FILTER (ok) AS ok, count(*) AS n, count(*) FILTER (ok AND gt_role = 'goalkeeper') AS keeper_ok,
 count(*) FILTER (gt_role = 'goalkeeper') AS keeper_n FROM moved_hits GROUP BY match_id""")
def matched_side_accuracy(spark, sf):
    return C.side_accuracy(match_people_moved(spark, sf), sides(spark, sf))


@query("matched_role_counts", "SELECT match_id, gt_role, pred_role, count(*) AS n FROM moved2 GROUP BY ALL")
def matched_role_counts(spark, sf):
    return C.role_counts(match_people_moved(spark, sf))


@query("matched_role_summary", """SELECT match_id, round(count(*) FILTER (gt_role = 'goalkeeper' AND pred_role = 'goalkeeper')/nullif(count(*) FILTER (gt_role = 'goalkeeper'), 0), 4) AS keeper_recall,
 NULL::DOUBLE AS referee_recall, NULL::DOUBLE AS referee_precision FROM moved2 GROUP BY match_id""", "keeper_recall")
def matched_role_summary(spark, sf):
    return C.role_summary(matched_role_counts(spark, sf))


POSITION = """SELECT {k} round(median(dist), 3) AS pos_err_median_m, round(quantile_cont(dist, 0.9), 3) AS pos_err_p90_m,
 round(count(*) FILTER (dist <= 2)/any_value(n), 4) AS recall_2m, any_value(n) AS gt_people FROM pairs5 {j}"""


@query("position_metrics", POSITION.format(k="match_id,", j="JOIN (SELECT match_id, count(*) AS n FROM gt GROUP BY match_id) USING (match_id) GROUP BY match_id"),
       "pos_err_median_m pos_err_p90_m recall_2m")
def position_metrics(spark, sf):
    return C.position_summary(D.pairs(spark, sf, 5.0), gt(spark, sf))


@query("matched_position_metrics", POSITION.replace("pairs5", "moved5").format(k="match_id,", j="JOIN (SELECT match_id, count(*) AS n FROM gt GROUP BY match_id) USING (match_id) GROUP BY match_id"),
       "pos_err_median_m pos_err_p90_m recall_2m")
def matched_position_metrics(spark, sf):
    return C.position_summary(match_people_gated_moved(spark, sf), gt(spark, sf))


@query("position_summary_pooled", POSITION.format(k="", j=", (SELECT count(*) AS n FROM gt)"), "pos_err_median_m pos_err_p90_m recall_2m")
def position_summary_pooled(spark, sf):
    return C.position_summary(D.pairs(spark, sf, 5.0), gt(spark, sf), by=())


define("ball_px", """SELECT g.match_id, g.frame_idx, sqrt(power(g.bbox_x - p.bbox_x, 2) + power(g.bbox_y - p.bbox_y, 2)) AS px FROM
 (SELECT * FROM tracks WHERE role = 'ball') g LEFT JOIN (SELECT * FROM pred_ball WHERE NOT interpolated) p USING (match_id, frame_idx)""")


@query("ball_distances", "SELECT * FROM ball_px", "px")
def ball_distances(spark, sf):
    return C.ball_distances(D.as_tracks(D.ball(spark, sf)), D.pred_ball(spark, sf)).select("match_id", "frame_idx", "px")


@query("ball_metrics", """SELECT match_id, round(count(*) FILTER (px <= 20)/count(*), 4) AS ball_recall, round(median(px) FILTER (px <= 20), 2) AS ball_px_median_hits,
 round((count(px) - count(*) FILTER (px <= 20))/count(*), 4) AS ball_wrong_share FROM ball_px GROUP BY match_id""", "ball_recall ball_px_median_hits ball_wrong_share")
def ball_metrics(spark, sf):
    return C.ball_metrics(D.as_tracks(D.ball(spark, sf)), D.pred_ball(spark, sf))


define("ball_near", """SELECT g.match_id, g.frame_idx, coalesce(bool_or(near), FALSE) AS d, coalesce(bool_or(near AND kept), FALSE) AS k FROM
 (SELECT * FROM ball_rows WHERE ck % 3 <> 0) g LEFT JOIN (SELECT *, frame_idx % 4 <> 0 AS kept FROM ball_candidates WHERE cand = 1 OR frame_idx % 5 <> 0) c
 USING (match_id, frame_idx), LATERAL (SELECT sqrt(power(g.bbox_x - c.bbox_x, 2) + power(g.bbox_y - c.bbox_y, 2)) <= 20 AS near) GROUP BY g.match_id, g.frame_idx""")


@query("ball_loss", "SELECT match_id, count(*) AS gt, count(*) FILTER (d) AS detected, count(*) FILTER (k) AS on_pitch FROM ball_near GROUP BY match_id")
def ball_loss(spark, sf):
    cands = D.ball_candidates(spark, sf).filter("cand = 1 or frame_idx % 5 <> 0").withColumn("kept", F.col("frame_idx") % 4 != 0)
    return C.ball_loss(D.as_tracks(D.ball(spark, sf)).filter("ck % 3 <> 0"), cands)


@query("ball_loss_summary", "SELECT round(avg(d::INT), 4) AS ball_det_recall, round(avg(k::INT), 4) AS ball_cand_recall FROM ball_near", "ball_det_recall ball_cand_recall")
def ball_loss_summary(spark, sf):
    return C.ball_loss_summary(ball_loss(spark, sf))


SHAPE = """SELECT match_id, frame_idx, side, count(*) AS n, avg(x) AS cx, avg(y) AS cy, max(y) - min(y) AS w, max(x) - min(x) AS d,
 avg(sqrt(power(x - mx, 2) + power(y - my, 2))) AS c FROM (SELECT *, avg(x) OVER k AS mx, avg(y) OVER k AS my FROM ({src})
 WINDOW k AS (PARTITION BY match_id, frame_idx, side)) GROUP BY match_id, frame_idx, side"""
define("gt_sided", "SELECT *, CASE WHEN team = 'home' THEN 'left' ELSE 'right' END AS side FROM gt_turned")
define("pred_sided", "SELECT p.*, s.side FROM pred_playing p JOIN gt_sides s USING (match_id, team)")
define("shape_gt", SHAPE.format(src="SELECT * FROM gt_sided"))
define("shape_pred", SHAPE.format(src="SELECT * FROM pred_sided"))


@query("shape_error", """SELECT *, round((centroid_x_err + centroid_y_err + width_err + depth_err + compactness_err)/5, 3) AS shape_error_m FROM (
 SELECT match_id, round(avg(abs(g.cx - p.cx)), 3) AS centroid_x_err, round(avg(abs(g.cy - p.cy)), 3) AS centroid_y_err, round(avg(abs(g.w - p.w)), 3) AS width_err,
 round(avg(abs(g.d - p.d)), 3) AS depth_err, round(avg(abs(g.c - p.c)), 3) AS compactness_err FROM shape_gt g JOIN shape_pred p USING (match_id, frame_idx, side)
 WHERE g.n >= 6 AND p.n >= 6 GROUP BY match_id)""", "centroid_x_err centroid_y_err width_err depth_err compactness_err shape_error_m")
def shape_error(spark, sf):
    return C.shape_error(turned(gt(spark, sf)), turned(pred(spark, sf)), sides(spark, sf))


define("side_counts", """SELECT f.match_id, f.frame_idx, s.side, coalesce(g.n, 0) AS gt_n, coalesce(p.n, 0) AS pred_n FROM frames f CROSS JOIN (VALUES ('left'),('right')) s(side)
 LEFT JOIN shape_gt g ON g.match_id = f.match_id AND g.frame_idx = f.frame_idx AND g.side = s.side
 LEFT JOIN shape_pred p ON p.match_id = f.match_id AND p.frame_idx = f.frame_idx AND p.side = s.side""")


@query("side_counts_outer", "SELECT * FROM side_counts")
def side_counts_outer(spark, sf):
    return C.side_counts_outer(turned(gt(spark, sf)), turned(pred(spark, sf)), sides(spark, sf))


@query("team_counts", """SELECT match_id, round(sum(e)/(2*count(*)), 3) AS team_count_err, round(avg((m > 11)::INT), 4) AS quota_breach_share FROM (
 SELECT match_id, frame_idx, sum(abs(pred_n - gt_n)) AS e, max(pred_n) AS m FROM side_counts GROUP BY match_id, frame_idx) GROUP BY match_id""",
       "team_count_err quota_breach_share")
def team_counts(spark, sf):
    return C.team_counts(turned(gt(spark, sf)), turned(pred(spark, sf)), sides(spark, sf))


# A tracklet id that welds two players now and then: fragments of 300 frames, every tenth shared.
define("owners", """SELECT DISTINCT match_id, e AS player_id, CASE WHEN (frame_idx // 300) % 10 = 3 THEN 5000 + (e // 2) ELSE (e + 1)*1000 + frame_idx // 1500 END AS tracklet_id
 FROM tracks_frag""")


@query("identity_purity", """SELECT * FROM (SELECT match_id, count(*) AS tracklets, count(*) FILTER (k > 1) AS welded FROM (SELECT match_id, tracklet_id,
 count(DISTINCT player_id) AS k FROM owners GROUP BY ALL) GROUP BY match_id) JOIN (SELECT match_id, median(f) AS median_frags_per_player,
 count(*) FILTER (f = 1) AS players_fully_recovered FROM (SELECT match_id, player_id, count(DISTINCT tracklet_id) AS f FROM owners GROUP BY ALL) GROUP BY match_id)
 USING (match_id)""", "median_frags_per_player")
def identity_purity(spark, sf):
    o = D.tracks_frag(spark, sf).selectExpr(
        "match_id", "e as player_id", "if((frame_idx div 300) % 10 = 3, 5000 + (e div 2), (e + 1) * 1000 + frame_idx div 1500) as tracklet_id")
    return C.identity_purity(o.distinct())


define("frag_spans", 'SELECT match_id, track_id, any_value(team) AS team, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM tracks_frag GROUP BY match_id, track_id')
define("head_changes", """SELECT match_id, frame_idx, sum(d) FILTER (team = 'home') AS dh, sum(d) FILTER (team = 'away') AS da FROM (
 SELECT match_id, team, f0 AS frame_idx, 1 AS d FROM frag_spans UNION ALL SELECT match_id, team, f1 + 1, -1 FROM frag_spans) GROUP BY match_id, frame_idx""")
define("heads_over_time", """SELECT match_id, frame_idx, lead(frame_idx) OVER w AS until, sum(coalesce(dh, 0)) OVER w::BIGINT AS home_n, sum(coalesce(da, 0)) OVER w::BIGINT AS away_n
 FROM head_changes WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)""".replace("OVER w::BIGINT", "OVER w"))


def spans(spark, sf):
    return D.tracks_frag(spark, sf).groupBy("match_id", "track_id").agg(
        F.min("team").alias("team"), F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"))


@query("active_intervals", "SELECT match_id, frame_idx, until, home_n::BIGINT AS home_n, away_n::BIGINT AS away_n FROM heads_over_time")
def active_intervals(spark, sf):
    return C.active_intervals(spans(spark, sf))


@query("eleven_a_side_share", """SELECT match_id, sum(CASE WHEN home_n = 11 AND away_n = 11 THEN until - frame_idx ELSE 0 END)/sum(until - frame_idx) AS eleven_share
 FROM heads_over_time WHERE until IS NOT NULL AND home_n + away_n > 0 GROUP BY match_id""", "eleven_share")
def eleven_a_side_share(spark, sf):
    return C.eleven_a_side_share(C.active_intervals(spans(spark, sf)))


# Cluster labels: a person's side, flipped on one row in seven; embeddings give a second corpus.
define("cluster_rows", "SELECT match_id, track_id, frame_idx, (CASE WHEN e < 11 THEN 0 ELSE 1 END + CASE WHEN (ck + e) % 7 = 0 THEN 1 ELSE 0 END) % 2 AS cluster FROM gt")


def cluster_rows(spark, sf):
    return gt(spark, sf).selectExpr("match_id", "track_id", "frame_idx",
                                    "cast((if(e < 11, 0, 1) + if((ck + e) % 7 = 0, 1, 0)) % 2 as int) as cluster")


DIAG = """SELECT match_id, consistency, balance, consistency >= 0.85 AND balance >= 0.7 AS ok, CASE WHEN consistency >= 0.85 AND balance >= 0.7 THEN 'sound'
 WHEN balance < 0.7 THEN 'lopsided' ELSE 'tracks flip' END AS note FROM (SELECT match_id, coalesce(avg(greatest(c0, n - c0)/n) FILTER (n >= 3), 0) AS consistency,
 1 - abs(sum(c0)/sum(n) - 0.5)*2 AS balance FROM (SELECT match_id, track_id, count(*) FILTER (cluster = 0) AS c0, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY match_id)"""


@query("cluster_diagnosis", DIAG.format(src="cluster_rows"), "consistency balance")
def cluster_diagnosis(spark, sf):
    return C.cluster_diagnosis(cluster_rows(spark, sf))


@query("embedding_cluster_diagnosis", DIAG.format(src="(SELECT 'all' AS match_id, vec_id // 10 AS track_id, \"label\" % 2 AS cluster FROM embeddings)"), "consistency balance")
def embedding_cluster_diagnosis(spark, sf):
    e = D.table(spark, sf, "embeddings")
    return C.cluster_diagnosis(e.selectExpr("'all' as match_id", "vec_id div 10 as track_id", "label % 2 as cluster"))


@query("cluster_sample", """SELECT * FROM (SELECT match_id, cluster::INT AS cluster, track_id, frame_idx, row_number() OVER (PARTITION BY match_id, cluster ORDER BY frame_idx, track_id) AS k
 FROM (SELECT match_id, cluster, track_id, min(frame_idx) AS frame_idx FROM cluster_rows GROUP BY ALL)) WHERE k <= 12""")
def cluster_sample(spark, sf):
    return C.cluster_sample(cluster_rows(spark, sf), 12)


# ------------------------------------------------------------------ detections

define("gated", """SELECT * FROM (SELECT *, CASE WHEN lower(cls_name) LIKE '%goalkeeper%' OR lower(cls_name) LIKE '%keeper%' THEN 'goalkeeper' WHEN lower(cls_name) LIKE '%ref%' THEN 'referee'
 WHEN cls_name LIKE '%ball%' THEN 'ball' WHEN cls_name LIKE '%player%' OR cls_name LIKE '%person%' THEN 'player' ELSE 'other' END AS role FROM detections)
 WHERE conf >= CASE WHEN role = 'ball' THEN 0.1 ELSE 0.25 END""")


@query("class_gate", "SELECT match_id, role, cls_name, count(*) AS n, sum(conf) AS c FROM gated GROUP BY ALL", "c")
def class_gate(spark, sf):
    return T.class_gate(D.detections(spark, sf)).groupBy("match_id", "role", "cls_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"))


@query("suppress_boxes")
def suppress_boxes(spark, sf):
    return T.suppress(T.class_gate(D.detections(spark, sf))).groupBy("match_id", "cls_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"))


@query("top_ball_boxes", """SELECT match_id, count(*) AS n, sum(det) AS s FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx, role ORDER BY conf DESC, det) AS k
 FROM (SELECT * REPLACE (CASE WHEN det % 3 <> 0 THEN 'ball' ELSE 'other' END AS role) FROM gated)) WHERE role <> 'ball' OR k <= 8 GROUP BY match_id""")
def top_ball_boxes(spark, sf):
    d = T.class_gate(D.detections(spark, sf)).withColumn("role", F.when(F.col("det") % 3 != 0, "ball").otherwise("other"))
    return B.top_ball_boxes(d, 8).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.sum("det").cast("double").alias("s"))


@query("anti_override", """SELECT match_id, role, count(*) AS n, sum(conf) AS c FROM (SELECT match_id, role, conf FROM gated g WHERE NOT (role = 'ball' AND EXISTS (
 SELECT 1 FROM ball_candidates b WHERE b.cand = 1 AND b.frame_idx % 2 = 0 AND b.match_id = g.match_id AND b.frame_idx = g.frame_idx))
 UNION ALL SELECT match_id, 'ball', conf FROM ball_candidates WHERE cand = 1 AND frame_idx % 2 = 0) GROUP BY ALL""", "c")
def anti_override(spark, sf):
    d = T.class_gate(D.detections(spark, sf)).select("match_id", "frame_idx", "role", "conf")
    b = D.ball_candidates(spark, sf).filter("cand = 1 and frame_idx % 2 = 0").select(
        "match_id", "frame_idx", F.lit("ball").alias("role"), "conf")
    return T.anti_override(d, b).groupBy("match_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"))
