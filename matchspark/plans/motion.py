"""Kinematics, gap filling, quality, validation and shot queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ball as B
from ..operators import kinematics as K
from ..operators import possession as P
from ..operators import quality as V
from ..operators import shape as H
from ..operators import shots as X
from ..schema import players
from . import derive as D
from .registry import define, query
from .tactics import norm

# ------------------------------------------------------------------ kinematics

define("noisy_players", "SELECT * FROM tracks_noisy WHERE role IN ('player','goalkeeper')")


def _hampel_sql(src: str, cols: tuple[str, ...] = ("x", "y")) -> str:
    med = ", ".join(f"median({c}) OVER w AS med_{c}" for c in cols)
    mad = ", ".join(f"median(abs({c} - med_{c})) OVER w AS mad_{c}" for c in cols)
    rep = ", ".join(f"CASE WHEN n >= 7 AND mad_{c} > 0 AND abs({c} - med_{c}) > 3 * 1.4826 * mad_{c} THEN med_{c} ELSE {c} END AS {c}" for c in cols)
    w = "WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
    return (f"SELECT * EXCLUDE ({', '.join(f'med_{c}, mad_{c}' for c in cols)}) REPLACE ({rep}) FROM (SELECT *, {mad} FROM (SELECT *, {med} FROM "
            f"(SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) - 1 AS p FROM {src} "
            f"WINDOW k AS (PARTITION BY match_id, track_id)) {w}) {w})")


def _smooth_sql(src: str, width: int, cols: tuple[str, ...] = ("x", "y")) -> str:
    """Tracks of the derived tables are longer than the window, so only the padding rule shows."""
    h = width // 2
    parts = ", ".join(
        f"(sum({c}) OVER w + greatest({h} - p, 0) * first({c}) OVER k + greatest({h} - (n - 1 - p), 0) * last({c}) OVER k) / {width} AS {c}"
        for c in cols)
    return (f"SELECT * REPLACE ({parts}) FROM {src} WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx "
            f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING), k AS (PARTITION BY match_id, track_id ORDER BY frame_idx "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


def _grad(c: str) -> str:
    return (f"CASE WHEN p = 0 THEN lead({c}) OVER o - {c} WHEN p = n - 1 THEN {c} - lag({c}) OVER o "
            f"ELSE (lead({c}) OVER o - lag({c}) OVER o) / 2 END")


_O = "WINDOW o AS (PARTITION BY match_id, track_id ORDER BY frame_idx)"
define("hampel_xy", _hampel_sql("noisy_players"))
define("smooth21_xy", _smooth_sql("hampel_xy", 21))
define("smooth11_xy", _smooth_sql("hampel_xy", 11))
define("speeds", f"""SELECT *, CASE WHEN dt <= 0 THEN 0.04 ELSE dt END AS step, least(sqrt(power(gx/dt,2) + power(gy/dt,2)), 12) AS sp FROM (
 SELECT *, ({_grad('frame_idx')})/25.0::DOUBLE AS dt, {_grad('x')} AS gx, {_grad('y')} AS gy FROM smooth21_xy {_O})""")
define("speed_smooth", _smooth_sql("(SELECT *, sp AS raw_sp FROM speeds)", 21, ("sp",)))
define("kinematics", f"""SELECT * EXCLUDE (speed, accel), raw_sp AS speed, greatest(least(({_grad('sp')}) / step, 10), -10) AS accel FROM speed_smooth {_O}""")


def noisy(spark, sf):
    return players(D.tracks_noisy(spark, sf))


def kin(spark, sf):
    return K.add_kinematics(noisy(spark, sf))


@query("hampel_filter", "SELECT match_id, track_id, frame_idx, x, y FROM hampel_xy", "x y")
def hampel_filter(spark, sf):
    return K.hampel(noisy(spark, sf)).select("match_id", "track_id", "frame_idx", "x", "y")


define("smooth_raw", _smooth_sql("""(SELECT *, count(*) OVER (PARTITION BY match_id, track_id) AS n,
 row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) - 1 AS p FROM noisy_players)""", 15))


@query("moving_average", "SELECT match_id, track_id, frame_idx, x, y FROM smooth_raw", "x y")
def moving_average(spark, sf):
    return K.smooth(noisy(spark, sf), 14).select("match_id", "track_id", "frame_idx", "x", "y")


@query("position_gradient", f"""SELECT match_id, track_id, frame_idx, {_grad('x')} AS gx, {_grad('y')} AS gy FROM (SELECT *,
 count(*) OVER (PARTITION BY match_id, track_id) AS n, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx) - 1 AS p
 FROM noisy_players) {_O}""", "gx gy")
def position_gradient(spark, sf):
    return K.gradient(noisy(spark, sf)).select("match_id", "track_id", "frame_idx", "gx", "gy")


@query("add_kinematics", "SELECT match_id, track_id, frame_idx, speed, accel FROM kinematics", "speed accel")
def add_kinematics(spark, sf):
    return kin(spark, sf).select("match_id", "track_id", "frame_idx", "speed", "accel")


@query("smooth_positions", "SELECT match_id, track_id, frame_idx, x, y FROM smooth11_xy", "x y")
def smooth_positions(spark, sf):
    return K.smooth_positions(noisy(spark, sf)).select("match_id", "track_id", "frame_idx", "x", "y")


define("distance", """SELECT match_id, track_id, arg_min(team, frame_idx) AS team, arg_min(role, frame_idx) AS role, mode(jersey) AS jersey,
 count(*) AS frames, count(*)/25.0::DOUBLE/60 AS minutes, coalesce(sum(moved), 0) AS distance_m, quantile_cont(speed, 0.995) AS top_speed_ms,
 coalesce(sum(moved) FILTER (speed > 5.5), 0) AS hsr_m, count(*) FILTER (speed > 7 AND (ps IS NULL OR ps <= 7)) AS sprints FROM (
 SELECT k.*, CASE WHEN k.frame_idx - lag(k.frame_idx) OVER o = 1 THEN sqrt(power(k.x - lag(k.x) OVER o, 2) + power(k.y - lag(k.y) OVER o, 2)) END AS moved,
 lag(speed) OVER o AS ps FROM kinematics k WINDOW o AS (PARTITION BY match_id, track_id ORDER BY frame_idx)) GROUP BY match_id, track_id""")


@query("distance_summary", "SELECT * FROM distance", "jersey minutes distance_m top_speed_ms hsr_m")
def distance_summary(spark, sf):
    return K.distance_summary(kin(spark, sf))


@query("furthest_tracks", "SELECT match_id, track_id, distance_m FROM distance ORDER BY distance_m DESC LIMIT 5", "distance_m")
def furthest_tracks(spark, sf):
    return K.furthest(K.distance_summary(kin(spark, sf)), 5).select("match_id", "track_id", "distance_m")


# ------------------------------------------------------------------ gaps

define("ball_steps", """SELECT *, lead(frame_idx) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tracks WHERE role = 'ball'
 WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)""")
define("ball_filled", """SELECT match_id, CAST(frame_idx + k AS INTEGER) AS frame_idx, period, (frame_idx + k)/25.0::DOUBLE AS "timestamp", track_id,
 x + (nx - x)*k/(nf - frame_idx) AS x, y + (ny - y)*k/(nf - frame_idx) AS y, NULL::DOUBLE AS det_conf, TRUE AS interpolated
 FROM (SELECT *, unnest(range(1, nf - frame_idx)) AS k FROM ball_steps WHERE nf - frame_idx - 1 BETWEEN 1 AND 5)
 UNION ALL SELECT match_id, frame_idx, period, "timestamp", track_id, x, y, det_conf, FALSE FROM tracks WHERE role = 'ball'""")


@query("interpolate_ball", "SELECT * FROM ball_filled", "timestamp x y det_conf")
def interpolate_ball(spark, sf):
    return B.interpolate_ball(D.tracks(spark, sf)).filter(F.col("role") == "ball").select(
        "match_id", "frame_idx", "period", "timestamp", "track_id", "x", "y", "det_conf", "interpolated")


define("noisy_steps", """SELECT *, lead(frame_idx) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead("timestamp") OVER w AS nt,
 lead(bbox_x) OVER w AS nbx FROM noisy_players WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_idx)""")


@query("hold_gaps", """SELECT match_id, track_id, CAST(frame_idx + k AS INTEGER) AS frame_idx, "timestamp" + (nt - "timestamp")*k/(nf - frame_idx) AS "timestamp",
 x + (nx - x)*k/(nf - frame_idx) AS x, y + (ny - y)*k/(nf - frame_idx) AS y, bbox_x + (nbx - bbox_x)*k/(nf - frame_idx) AS bbox_x, TRUE AS interpolated
 FROM (SELECT *, unnest(range(1, nf - frame_idx)) AS k FROM noisy_steps WHERE nf - frame_idx - 1 BETWEEN 1 AND 12)
 UNION ALL SELECT match_id, track_id, frame_idx, "timestamp", x, y, bbox_x, FALSE FROM noisy_players""", "timestamp x y bbox_x")
def hold_gaps(spark, sf):
    return B.hold_gaps(noisy(spark, sf)).select("match_id", "track_id", "frame_idx", "timestamp", "x", "y", "bbox_x", "interpolated")


@query("ball_coverage", """SELECT match_id, (SELECT count(*) FROM (SELECT DISTINCT match_id AS m, frame_idx FROM ball_filled) WHERE m = f.match_id)
 / count(*) AS coverage, (SELECT count(*) FROM tracks t WHERE role = 'ball' AND t.match_id = f.match_id) / count(*) AS detected FROM frames f GROUP BY match_id""",
       "coverage detected")
def ball_coverage(spark, sf):
    t = B.interpolate_ball(D.tracks(spark, sf))
    return B.ball_coverage(t).join(B.ball_coverage(t, True).withColumnRenamed("coverage", "detected"), "match_id")


@query("best_ball", """SELECT match_id, frame_idx, x, conf FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY conf DESC, cand DESC) AS k
 FROM ball_candidates) WHERE k = 1""", "x conf")
def best_ball(spark, sf):
    c = D.ball_candidates(spark, sf).select("match_id", "frame_idx", F.lit("ball").alias("role"), F.col("cand").alias("track_id"),
                                            F.col("conf").alias("det_conf"), "x")
    return B.best_ball(c).select("match_id", "frame_idx", "x", F.col("det_conf").alias("conf"))


@query("observed_and_filled", """SELECT match_id, interpolated, count(*) AS n FROM (SELECT match_id, interpolated FROM ball_filled
 UNION ALL SELECT match_id, FALSE FROM tracks WHERE role <> 'ball') GROUP BY match_id, interpolated""")
def observed_and_filled(spark, sf):
    return B.interpolate_ball(D.tracks(spark, sf)).groupBy("match_id", "interpolated").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ quality

define("births", """SELECT match_id, track_id, min(frame_idx) AS first_frame, any_value(m0) AS match_first, min(frame_idx) > any_value(m0) AS born_late
 FROM (SELECT *, min(frame_idx) OVER (PARTITION BY match_id) AS m0 FROM {src}) WHERE role IN ('player','goalkeeper','referee') GROUP BY match_id, track_id""".format(src="tracks_noisy"))


@query("track_births", "SELECT * FROM births")
def track_births(spark, sf):
    return V.track_births(D.tracks_noisy(spark, sf))


define("noisy_heads", """SELECT match_id, frame_idx, count(DISTINCT track_id) FILTER (role <> 'ball') AS n, max((role = 'ball')::INT) AS b
 FROM tracks_noisy GROUP BY match_id, frame_idx""")


@query("compute_quality", """SELECT h.match_id, count(*) AS frames, 1 AS stride, 22 AS expected_players, avg(n) AS mean_players_per_frame,
 avg((n >= 18)::INT) AS pct_frames_ge_18_players, avg((n >= 20)::INT) AS pct_frames_ge_20_players, any_value(ids) AS unique_track_ids,
 any_value(late) AS track_births_after_first_frame, any_value(late)/22.0::DOUBLE/(count(*)/25.0::DOUBLE/60) AS id_switch_rate_per_player_per_minute,
 avg(b) AS ball_coverage, avg(b) AS ball_coverage_detected, count(*)/10.0::DOUBLE AS wall_seconds,
 count(*)/10.0::DOUBLE/(count(*)/25.0::DOUBLE/60) AS seconds_per_match_minute FROM noisy_heads h JOIN
 (SELECT match_id, count(*) AS ids, count(*) FILTER (born_late) AS late FROM births GROUP BY match_id) USING (match_id) GROUP BY h.match_id""",
       """mean_players_per_frame pct_frames_ge_18_players pct_frames_ge_20_players id_switch_rate_per_player_per_minute
       ball_coverage ball_coverage_detected wall_seconds seconds_per_match_minute""", cte=True)
def compute_quality(spark, sf):
    t = D.tracks_noisy(spark, sf)
    seconds = t.groupBy("match_id", "frame_idx").agg(F.lit(0.1).alias("s")).groupBy("match_id").agg(
        (F.count(F.lit(1)) / 10.0).alias("seconds"))
    return V.compute_quality(t, D.matches(spark, sf), seconds)


@query("quality_markdown", """SELECT match_id, line_no, line FROM (SELECT match_id, unnest([
 {line_no: 0, line: '- **frames**: ' || frames}, {line_no: 5, line: '- **unique_track_ids**: ' || unique_track_ids},
 {line_no: 9, line: '- **wall_seconds**: ' || printf('%.3f', wall_seconds)}], recursive := true) FROM
 (SELECT match_id, frames, unique_track_ids, wall_seconds FROM compute_quality))""")
def quality_markdown(spark, sf):
    q = compute_quality(spark, sf).select("match_id", "frames", "stride", "expected_players", "mean_players_per_frame",
                                          "pct_frames_ge_18_players", "unique_track_ids", "track_births_after_first_frame",
                                          "ball_coverage", "ball_coverage_detected", "wall_seconds")
    return V.quality_markdown(q).filter(F.col("line_no").isin(0, 5, 9))


@query("seconds_per_match_minute", """SELECT match_id, count(*) AS frames, count(*)/8.0::DOUBLE AS seconds,
 round(count(*)/8.0::DOUBLE/(count(*)/25.0::DOUBLE/60), 2) AS seconds_per_match_minute FROM frames GROUP BY match_id""", "seconds seconds_per_match_minute")
def seconds_per_match_minute(spark, sf):
    runs = D.frames(spark, sf).groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / 8.0).alias("seconds"))
    return V.seconds_per_match_minute(runs)


@query("validate", """WITH base AS (SELECT match_id, count(*)::DOUBLE AS rws, avg((abs(x) > 57.5 OR abs(y) > 39)::INT) AS off,
 count(*) FILTER (role <> 'ball') AS np, quantile_cont(x, 0.995) FILTER (role <> 'ball') - quantile_cont(x, 0.005) FILTER (role <> 'ball') AS sx,
 quantile_cont(y, 0.995) FILTER (role <> 'ball') - quantile_cont(y, 0.005) FILTER (role <> 'ball') AS sy FROM tracks_noisy GROUP BY match_id),
 sp AS (SELECT match_id, avg((speed > 12.5)::INT) AS fast FROM kinematics GROUP BY match_id),
 heads AS (SELECT match_id, median(n) AS typical, abs(median(h) - median(a)) AS split FROM (SELECT match_id, frame_idx, count(*) AS n,
 count(*) FILTER (team = 'home') AS h, count(*) FILTER (team = 'away') AS a FROM noisy_players GROUP BY match_id, frame_idx) GROUP BY match_id),
 allv AS (SELECT *, source_type = 'fixed_panoramic' AS f FROM matches JOIN base USING (match_id) JOIN sp USING (match_id) JOIN heads USING (match_id))
 SELECT match_id, 'not_empty' AS "check", rws AS value, 1.0::DOUBLE AS threshold, FALSE AS failed FROM allv
 UNION ALL SELECT match_id, 'off_pitch_share', off, 0.01, off > 0.01 FROM allv
 UNION ALL SELECT match_id, 'players_per_frame', CASE WHEN f THEN typical END, 18, f AND typical < 18 FROM allv
 UNION ALL SELECT match_id, 'fast_share', fast, 0.001, fast > 0.001 FROM allv
 UNION ALL SELECT match_id, 'unknown_team_share', 0, 0.1, FALSE FROM allv
 UNION ALL SELECT match_id, 'width_covered', CASE WHEN f THEN sy/68 END, 1, f AND sy/68 > 1 FROM allv
 UNION ALL SELECT match_id, 'length_covered', CASE WHEN f AND sy/68 <= 1 THEN sx/105 END, 1, f AND sy/68 <= 1 AND sx/105 > 1 FROM allv
 UNION ALL SELECT match_id, 'team_split', CASE WHEN f THEN split END, 3, f AND split > 3 FROM allv""", "value threshold")
def validate(spark, sf):
    t = D.tracks_noisy(spark, sf)
    both = kin(spark, sf).unionByName(t.filter(F.col("role") == "ball"))
    return V.validate(both, D.matches(spark, sf))


define("role_votes", "SELECT match_id, track_id, role, count(*) AS n FROM tracks_frag GROUP BY match_id, track_id, role")
define("role_winner", """SELECT match_id, track_id, arg_min(role, (-n, role)) AS role, sum(n) AS total FROM role_votes GROUP BY match_id, track_id""")


@query("resolve_roles", """SELECT match_id, track_id, role, count(*) AS n FROM (SELECT t.match_id, t.track_id, coalesce(w.role, t.role) AS role FROM tracks_frag t
 LEFT JOIN (SELECT * FROM role_winner WHERE total >= 10) w USING (match_id, track_id)) GROUP BY ALL""")
def resolve_roles(spark, sf):
    return V.resolve_roles(D.tracks_frag(spark, sf)).groupBy("match_id", "track_id", "role").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ shots
# The derived signals have stingers of 38 frames starting at 0 and 400 of every 2000, so the SQL side
# can work with runs directly.

define("sting_runs", """SELECT match_id, min(frame_idx) AS s, max(frame_idx) AS e FROM (SELECT *, frame_idx - row_number() OVER
 (PARTITION BY match_id ORDER BY frame_idx) AS grp FROM signals WHERE stinger) GROUP BY match_id, grp HAVING count(*) >= 12""")
define("sting_chain", """SELECT *, row_number() OVER (PARTITION BY match_id, chain ORDER BY s) AS k, lead(e) OVER (PARTITION BY match_id, chain ORDER BY s) AS ne
 FROM (SELECT *, sum(CASE WHEN s - pe > 1125 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY s) AS chain FROM (
 SELECT *, lag(e) OVER (PARTITION BY match_id ORDER BY s) AS pe FROM sting_runs))""")
define("sting_frames", """SELECT g.*, EXISTS (SELECT 1 FROM sting_runs r WHERE r.match_id = g.match_id AND g.frame_idx BETWEEN s AND e) AS is_stinger,
 EXISTS (SELECT 1 FROM sting_chain c WHERE c.match_id = g.match_id AND k % 2 = 1 AND ne IS NOT NULL AND g.frame_idx BETWEEN s AND ne) AS replay FROM signals g""")


@query("stinger_and_replay", "SELECT match_id, frame_idx, is_stinger, replay FROM sting_frames")
def stinger_and_replay(spark, sf):
    return X.stinger_and_replay(D.signals(spark, sf)).select("match_id", "frame_idx", "is_stinger", "replay")


define("wide0", """SELECT *, grass >= 0.55 AND NOT stinger AND coalesce(person_h, 0) <= 0.22 AND NOT is_stinger AND NOT replay AS wide,
 coalesce(hot <> lag(hot) OVER (PARTITION BY match_id ORDER BY frame_idx), FALSE) AS cut FROM sting_frames""")
define("wide1", """SELECT *, sum((wide IS DISTINCT FROM pw)::INT) OVER (PARTITION BY match_id ORDER BY frame_idx) AS g FROM (
 SELECT *, lag(wide) OVER (PARTITION BY match_id ORDER BY frame_idx) AS pw FROM wide0)""")
define("wide_gaps", """SELECT match_id, g, min(frame_idx) AS s, max(frame_idx) AS e FROM wide1 WHERE NOT wide GROUP BY match_id, g""")
define("wide_ends", "SELECT match_id, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM signals GROUP BY match_id")
define("wide_fill", """SELECT match_id, g FROM wide_gaps JOIN wide_ends USING (match_id) WHERE s <> f0 AND e <> f1 AND e - s + 1 <= 12
 AND NOT EXISTS (SELECT 1 FROM wide0 w WHERE w.match_id = wide_gaps.match_id AND w.cut AND w.frame_idx BETWEEN s AND e + 1)""")
define("wide2", """SELECT w.* REPLACE ((wide OR f.g IS NOT NULL) AND NOT is_stinger AND NOT replay AS wide) FROM wide1 w LEFT JOIN wide_fill f USING (match_id, g)""")
define("wide3", """SELECT *, wide AND count(*) OVER (PARTITION BY match_id, h) >= 50 AS live FROM (SELECT * EXCLUDE (pw), sum((wide IS DISTINCT FROM pw)::INT)
 OVER (PARTITION BY match_id ORDER BY frame_idx) AS h FROM (SELECT * EXCLUDE (pw), lag(wide) OVER (PARTITION BY match_id ORDER BY frame_idx) AS pw FROM wide2))""")
define("shot_frames", """SELECT match_id, frame_idx, is_stinger, replay, cut, live, CAST(sum((cut OR coalesce(live <> pl, FALSE))::INT) OVER (PARTITION BY match_id
 ORDER BY frame_idx) AS INTEGER) AS shot FROM (SELECT *, lag(live) OVER (PARTITION BY match_id ORDER BY frame_idx) AS pl FROM wide3)""")


@query("live_wide_segments", "SELECT * FROM shot_frames")
def live_wide_segments(spark, sf):
    return X.live_wide_segments(D.signals(spark, sf)).select("match_id", "frame_idx", "is_stinger", "replay", "cut", "live", "shot")


@query("fill_mask_gaps", """SELECT match_id, frame_idx, wide OR f.g IS NOT NULL AS live FROM wide1 LEFT JOIN wide_fill f USING (match_id, g)""")
def fill_mask_gaps(spark, sf):
    s = X.with_cuts(X.stinger_and_replay(D.signals(spark, sf)))
    s = s.withColumn("live", X.is_wide() & ~F.col("is_stinger") & ~F.col("replay"))
    runs = X.fill_gaps(X.run_table(s, ["live"], F.col("cut")), "live", 12)
    return runs.select("match_id", F.explode(F.sequence("s", "e")).alias("frame_idx"), "live")


@query("run_report", """SELECT match_id, any_value(fp) AS frames_processed, any_value(fc) AS frames_calibrated, any_value(det) AS detections,
 any_value(dropped) AS dropped_off_pitch, any_value(bd) AS ball_dropped_off_pitch, any_value(tc) AS tracks_created, any_value(lw) AS live_wide_share,
 any_value(rs) AS replay_seconds, any_value(sh) AS shots, any_value(fp) - any_value(fc) AS frames_uncalibrated, any_value(fc)/any_value(fp) AS calib_success_rate
 FROM (SELECT match_id, count(*) AS det, count(*) FILTER (abs(y) > 36 OR abs(x) > 54.5) AS dropped, count(*) FILTER (abs(y) > 36 OR abs(x) > 54.5 AND role='ball') AS bdx,
 count(*) FILTER ((abs(y) > 36 OR abs(x) > 54.5) AND role = 'ball') AS bd FROM tracks GROUP BY match_id)
 JOIN (SELECT match_id, count(*) AS fp, count(*) FILTER (ck % 4 <> 0) AS fc FROM frames GROUP BY match_id) USING (match_id)
 JOIN (SELECT match_id, count(DISTINCT track_id) AS tc FROM tracks GROUP BY match_id) USING (match_id)
 JOIN (SELECT match_id, avg(live::INT) AS lw, count(*) FILTER (replay)/25.0::DOUBLE AS rs, max(shot) + 1 AS sh FROM shot_frames GROUP BY match_id) USING (match_id)
 GROUP BY match_id""", "live_wide_share replay_seconds calib_success_rate")
def run_report(spark, sf):
    t = D.tracks(spark, sf)
    kept = (F.abs("x") <= 54.5) & (F.abs("y") <= 36)
    calibrated = D.frames(spark, sf).select("match_id", "frame_idx", (F.col("ck") % 4 != 0).alias("calibrated"))
    return V.run_report(t.withColumn("kept", kept), t, calibrated, X.live_wide_segments(D.signals(spark, sf)))
