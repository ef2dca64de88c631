"""Geometry, calibration and landmark queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.joins import by_exchange
from ..operators import calibration as C
from ..operators import detections as T
from ..operators import landmarks as L
from ..operators import review as R
from ..schema import players
from . import derive as D
from .registry import define, query

_POINTS = [(k, n, 52.5 * sx + dx, 34.0 * sy + dy) for k, (n, sx, dx, sy, dy) in enumerate(G.landmark_terms())]
define("pitch_points", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{n}', {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, n, x, y in _POINTS) + ") t(k, landmark, lx, ly)")
LINES = [(k, *r) for k, r in enumerate([
    ("Side line top", -52.5, -34.0, 52.5, -34.0), ("Side line bottom", -52.5, 34.0, 52.5, 34.0),
    ("Side line left", -52.5, -34.0, -52.5, 34.0), ("Side line right", 52.5, -34.0, 52.5, 34.0), ("Middle line", 0.0, -34.0, 0.0, 34.0),
    ("Big rect. left main", -36.0, -20.16, -36.0, 20.16), ("Big rect. right main", 36.0, -20.16, 36.0, 20.16)])]
define("ground_lines", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, n, a, b, c, d in LINES) + ") t(k, line, ax, ay, bx, by_)")


# ------------------------------------------------------------------ derived inputs

define("label_frames", "SELECT * FROM frames")
LABEL = """SELECT match_id, frame_idx, ck, k, landmark, lx, ly, 960 + 8*lx + ((ck*(k+{a})) % 5 - 2) AS u, 540 + 6*ly + ((ck*(k+{b})) % 5 - 2) AS v
 FROM label_frames, pitch_points WHERE (ck + k) % {m} <> 0"""
define("labels_a", LABEL.format(a=1, b=2, m=3))
define("labels_b", LABEL.format(a=3, b=4, m=4))
define("cams", """SELECT match_id, frame_idx, ck, 0.125::DOUBLE AS a, -120.0::DOUBLE AS b, 1.0::DOUBLE/6 AS c, -90.0::DOUBLE AS d,
 CASE WHEN ck % 10 <> 0 THEN (ck % 5)*1e-5::DOUBLE END AS p, 0.5*(ck % 3) AS t, frame_idx % 10 = 0 AS keyf FROM frames""")


def label_rows(spark, sf, a, b, m):
    at = F.get(G.landmark_array(F.lit(105.0), F.lit(68.0)), F.col("id").cast("int"))
    pts = spark.range(0, len(_POINTS), 1, 1).select(F.col("id").cast("int").alias("k"), at.alias("p")).select("k", "p.*")
    f = D.each(D.frames(spark, sf).select("match_id", "frame_idx", "ck"), pts)
    return f.filter(f"(ck + k) % {m} <> 0").selectExpr(
        "match_id", "frame_idx", "ck", "k", "landmark", "lx", "ly", f"960D + 8D * lx + ((ck * (k + {a})) % 5 - 2) as u",
        f"540D + 6D * ly + ((ck * (k + {b})) % 5 - 2) as v")


def labels_a(spark, sf):
    return label_rows(spark, sf, 1, 2, 3)


def labels_b(spark, sf):
    return label_rows(spark, sf, 3, 4, 4)


def cams(spark, sf):
    return D.frames(spark, sf).selectExpr(
        "match_id", "frame_idx", "ck", "if(ck % 10 = 0, null, array(0.125D, 0D, -120D, 0D, 1D / 6D, -90D, 0D, (ck % 5) * 1e-5D, 1D)) as h",
        "array(1D, 0D, 0.5D * (ck % 3), 0D, 1D, 0D, 0D, 0D, 1D) as m", "if(frame_idx % 10 = 0, 'keyframe', 'bridged') as source")


# ------------------------------------------------------------------ geometry

@query("pitch_landmarks", "SELECT match_id, landmark, lx, ly FROM matches, pitch_points", "lx ly")
def pitch_landmarks(spark, sf):
    return G.pitch_landmarks(D.matches(spark, sf))


@query("feet_point", "SELECT match_id, frame_idx, track_id, bbox_x + bbox_w/2 AS u, bbox_y + bbox_h AS v FROM tracks", "u v")
def feet_point(spark, sf):
    u, v = G.feet_point()
    return D.tracks(spark, sf).select("match_id", "frame_idx", "track_id", u.alias("u"), v.alias("v"))


define("mapped", """SELECT t.match_id, t.frame_idx, t.track_id, (a*u + b)/(1 + p*v) AS x, (c*v + d)/(1 + p*v) AS y FROM (SELECT *, bbox_x + bbox_w/2 AS u,
 bbox_y + bbox_h AS v FROM tracks) t JOIN cams USING (match_id, frame_idx) WHERE p IS NOT NULL""")


@query("map_detections", "SELECT * FROM mapped", "x y")
def map_detections(spark, sf):
    return C.map_detections(D.tracks(spark, sf), cams(spark, sf)).select("match_id", "frame_idx", "track_id", "x", "y")


@query("calibration_counts", "SELECT match_id, count(p) AS frames_calibrated, count(*) - count(p) AS frames_uncalibrated FROM cams WHERE ck % 4 <> 0 OR TRUE GROUP BY match_id")
def calibration_counts(spark, sf):
    return C.calibration_counts(D.frames(spark, sf), cams(spark, sf).filter("h is not null"))


@query("apply_homography", "SELECT l.match_id, l.frame_idx, landmark, (a*u + b)/(1 + p*v) AS x, (c*v + d)/(1 + p*v) AS y FROM labels_a l JOIN cams USING (match_id, frame_idx)", "x y")
def apply_homography(spark, sf):
    j = labels_a(spark, sf).join(by_exchange(cams(spark, sf).select("match_id", "frame_idx", "h")), ["match_id", "frame_idx"])
    return C.apply_homography(j).select("match_id", "frame_idx", "landmark", "x", "y")


@query("undistort_fisheye", """SELECT match_id, frame_idx, track_id, xd*s*1100 + 960 - 52.5 AS x, yd*s*1100 + 540 - 38 AS y FROM (SELECT *, CASE WHEN td > 1e-8 THEN tan(th)/td ELSE 1 END AS s FROM (
 SELECT *, list_reduce(list_prepend(td, [1.0,2,3,4,5,6,7,8,9,10]::DOUBLE[]), lambda th, i: th - (th*(1 + th*th*(0.05 + th*th*(-0.01 + th*th*(0.002 - 0.0003*th*th)))) - td)
 /(1 + th*th*(0.15 + th*th*(-0.05 + th*th*(0.014 - 0.0027*th*th))))) AS th FROM (SELECT *, least(sqrt(xd*xd + yd*yd), pi()/2) AS td FROM (
 SELECT match_id, frame_idx, track_id, (bbox_x + bbox_w/2 - 960)/1200 AS xd, (bbox_y + bbox_h - 540)/1200 AS yd FROM tracks WHERE frame_idx % 2 >= 0))))""", "x y")
def undistort_fisheye(spark, sf):
    u, v = G.feet_point()
    pts = D.tracks(spark, sf).select("match_id", "frame_idx", "track_id", u.alias("u"), v.alias("v"))
    lens = D.matches(spark, sf).selectExpr(
        "match_id", "array(1200D, 1200D, 960D, 540D) as k", "array(0.05D, -0.01D, 0.002D, -0.0003D) as d",
        "array(1100D, 1100D, 960D, 540D) as knew", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) as h")
    return C.undistort_fisheye(pts, lens).select("match_id", "frame_idx", "track_id", "x", "y")


@query("compose_moving_camera", """SELECT t.match_id, t.frame_idx, t.track_id, (a*(u - t) + b) AS x, (c*v + d) AS y FROM (SELECT *, bbox_x + bbox_w/2 AS u,
 bbox_y + bbox_h AS v FROM tracks) t JOIN cams USING (match_id, frame_idx)""".replace("(u - t)", "(u - cams.t)"), "x y")
def compose_moving_camera(spark, sf):
    motion = cams(spark, sf).select("match_id", "frame_idx", F.col("m").alias("h"))
    anchors = D.matches(spark, sf).selectExpr("match_id", "array(0.125D, 0D, -120D, 0D, 1D / 6D, -90D, 0D, 0D, 1D) as h")
    return C.compose_moving_camera(D.tracks(spark, sf), motion, anchors).select("match_id", "frame_idx", "track_id", "x", "y")


@query("centre_origin", "SELECT match_id, frame_idx, track_id, x*0.5 - 52.5 AS x, y*0.5 - 34 AS y, (x + 52.5)/105*105 - 52.5 AS ux FROM tracks", "x y ux")
def centre_origin(spark, sf):
    L_, W_ = F.lit(105.0), F.lit(68.0)
    x, y = G.centre_origin(F.col("x") * 0.5, F.col("y") * 0.5, L_, W_)
    ux, _ = G.centre_origin((F.col("x") + 52.5) / 105, F.col("y"), L_, W_, unit=True)
    return D.tracks(spark, sf).select("match_id", "frame_idx", "track_id", x.alias("x"), y.alias("y"), ux.alias("ux"))


@query("apply_tps", "SELECT match_id, frame_idx, count(*) AS n, 0.0::DOUBLE AS worst FROM labels_a GROUP BY match_id, frame_idx", "worst")
def apply_tps(spark, sf):
    """A spline fitted to the leftovers of a homography sends its own points to the truth."""
    lab = labels_a(spark, sf)
    fit = C.fit_homographies(lab, tps=True)
    j = C.apply_homography(lab.join(by_exchange(fit.select("match_id", "frame_idx", "h")), ["match_id", "frame_idx"]))
    out = C.apply_tps(j.drop("h"), fit, ["match_id", "frame_idx"])
    return out.groupBy("match_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(
        F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))), 3).alias("worst"))


KNOTS = [(-30.0, -20.0), (30.0, -20.0), (-30.0, 20.0), (30.0, 20.0)]
_R2 = [f"(power(px - ({x}), 2) + power(py - ({y}), 2))" for x, y in KNOTS]
_BEND = lambda a, m: " + ".join(f"((ck + {a * k}) % {m} - {m // 2})*1e-5*{r}*ln({r})" for k, r in enumerate(_R2))
define("spline_points", f"""SELECT match_id, frame_idx, track_id, u, v, 0.5 + 1.01*px + {_BEND(1, 5)} AS x, -0.25 + 0.99*py + {_BEND(2, 7)} AS y FROM (
 SELECT *, (a*u + b)/(1 + p*v) AS px, (c*v + d)/(1 + p*v) AS py FROM (SELECT match_id, frame_idx, track_id, 960 + 8*x AS u, 540 + 6*y AS v FROM tracks) JOIN cams USING (match_id, frame_idx) WHERE p IS NOT NULL)""")


@query("pitch_to_image", "SELECT * FROM spline_points", "u v x y")
def pitch_to_image(spark, sf):
    """Pixels through a known map and spline to the pitch, and from there back to the pixels, off the control points."""
    pt = lambda x, y: F.struct(F.expr(f"cast({x} as double)").alias("x"), F.expr(f"cast({y} as double)").alias("y"))
    bend = [pt(f"((ck + {k}) % 5 - 2) * 1e-5D", f"((ck + {2 * k}) % 7 - 3) * 1e-5D") for k in range(4)]
    c = cams(spark, sf).filter("h is not null").select("match_id", "frame_idx", "h", F.array(*[pt(x, y) for x, y in KNOTS]).alias("src"), F.array(
        *bend, pt(0.5, -0.25), pt(1.01, 0), pt(0, 0.99)).alias("coef"))
    t = D.tracks(spark, sf).select("match_id", "frame_idx", "track_id", (960 + 8 * F.col("x")).alias("u"), (540 + 6 * F.col("y")).alias("v"))
    there = C.image_to_pitch(t, c, ["match_id", "frame_idx"]).drop("u", "v")
    return C.pitch_to_image(there, c, ["match_id", "frame_idx"]).select("match_id", "frame_idx", "track_id", "u", "v", "x", "y")


@query("fit_homographies", """SELECT match_id, frame_idx, count(*)::INT AS n_points, 0.125::DOUBLE AS h0, -120.0::DOUBLE AS h2, 1.0::DOUBLE/6 AS h4, -90.0::DOUBLE AS h5
 FROM labels_a GROUP BY match_id, frame_idx""", "h0 h2 h4 h5")
def fit_homographies(spark, sf):
    """Exact points of a known plane map give that map back."""
    exact = labels_a(spark, sf).withColumn("u", 960 + 8 * F.col("lx")).withColumn("v", 540 + 6 * F.col("ly"))
    h = C.fit_homographies(exact)
    return h.select("match_id", "frame_idx", "n_points", *[F.get("h", F.lit(i)).alias(f"h{i}") for i in (0, 2, 4, 5)])


@query("fit_keypoint_homographies")
def fit_keypoint_homographies(spark, sf):
    k = labels_a(spark, sf).withColumn("conf", (F.col("ck") * (F.col("k") + 7) % 100) / 100.0)
    k = k.withColumn("u", F.when((F.col("ck") + F.col("k")) % 11 == 0, F.col("u") + 300).otherwise(F.col("u")))
    return C.fit_keypoint_homographies(k).select("match_id", "frame_idx", "n_points", "err")


@query("fit_vertex_homographies", """SELECT match_id, frame_idx, (CASE WHEN ck % 6 > 0 THEN 32 ELSE ck % 4 END)::INT AS n_points, CASE WHEN ck % 6 > 0 THEN 0.125::DOUBLE END AS h0,
 CASE WHEN ck % 6 > 0 THEN -120.0::DOUBLE END AS h2, CASE WHEN ck % 6 > 0 THEN 1.0::DOUBLE/6 END AS h4, CASE WHEN ck % 6 > 0 THEN -90.0::DOUBLE END AS h5, CASE WHEN ck % 6 > 0 THEN 0.0::DOUBLE END AS err
 FROM frames""", "h0 h2 h4 h5 err")
def fit_vertex_homographies(spark, sf):
    """Model output with one vertex far off, or with too few sure ones: the map is found, or the frame keeps a row of nulls."""
    at = G.model_vertices()
    u = F.array(*[F.lit(960 + 8 * x) + F.when(F.col("ck") % 32 == k, 300.0).otherwise(0.0) for k, (x, _) in enumerate(at)])
    conf = F.array(*[F.when((F.col("ck") % 6 > 0) | (F.col("ck") % 4 > k), 0.9).otherwise(0.1) for k in range(len(at))])
    f = D.frames(spark, sf).select("match_id", "frame_idx", u.alias("u"), F.array(*[F.lit(540 + 6 * y) for _, y in at]).alias("v"), conf.alias("conf"))
    h = C.fit_vertex_homographies(f)
    return h.select("match_id", "frame_idx", "n_points", *[F.get("h", F.lit(i)).alias(f"h{i}") for i in (0, 2, 4, 5)], "err")


# ------------------------------------------------------------------ errors

define("label_errs", """SELECT l.match_id, l.frame_idx, l.landmark, sqrt(power((a*u + b)/(1 + p*v) - lx, 2) + power((c*v + d)/(1 + p*v) - ly, 2)) AS err_m
 FROM labels_a l JOIN cams USING (match_id, frame_idx) WHERE p IS NOT NULL""")
define("frame_errs", "SELECT f.match_id, f.frame_idx, median(err_m) AS error_m FROM (SELECT DISTINCT match_id, frame_idx FROM labels_a) f LEFT JOIN label_errs USING (match_id, frame_idx) GROUP BY ALL")


@query("landmark_errors", "SELECT * FROM label_errs", "err_m")
def landmark_errors(spark, sf):
    return C.landmark_errors(labels_a(spark, sf), cams(spark, sf))


@query("frame_error", "SELECT * FROM frame_errs", "error_m")
def frame_error(spark, sf):
    return C.frame_error(labels_a(spark, sf), cams(spark, sf))


@query("landmark_benchmark", """SELECT match_id, count(*) AS frames, count(*) FILTER (e < 1)/count(*) AS share_under_1m, count(*) FILTER (bad) AS failed,
 count(*) FILTER (NOT bad AND e IS NULL) AS uncalibrated, median(e) AS median_error_m FROM (SELECT *, frame_idx % 350 = 0 AS bad,
 CASE WHEN frame_idx % 350 <> 0 THEN error_m END AS e FROM frame_errs) GROUP BY match_id""", "share_under_1m median_error_m")
def landmark_benchmark(spark, sf):
    failed = D.frames(spark, sf).filter("frame_idx % 350 = 0").select("match_id", "frame_idx")
    return C.landmark_benchmark(labels_a(spark, sf), cams(spark, sf), failed)


@query("calibration_verdict", """SELECT match_id, frame_idx, count(*) AS n_points, avg(err_m) AS mean_m, median(err_m) AS median_m, max(err_m) AS max_m,
 arg_min(landmark, (-round(err_m, 9), landmark)) AS worst_landmark, CASE WHEN max(err_m) < 0.5 THEN 'good' WHEN max(err_m) < 1.5 THEN 'usable' ELSE 'bad' END AS verdict
 FROM label_errs GROUP BY match_id, frame_idx""", "mean_m median_m max_m")
def calibration_verdict(spark, sf):
    return C.calibration_verdict(labels_a(spark, sf), cams(spark, sf))


@query("labelling_error")
def labelling_error(spark, sf):
    return L.labelling_error(labels_a(spark, sf), labels_b(spark, sf))


@query("label_pairs", "SELECT a.match_id, a.frame_idx, a.landmark, a.u, a.v, b.u AS u2, b.v AS v2 FROM labels_a a JOIN labels_b b USING (match_id, frame_idx, landmark)", "u v u2 v2")
def label_pairs(spark, sf):
    return L.label_pairs(labels_a(spark, sf), labels_b(spark, sf)).select("match_id", "frame_idx", "landmark", "u", "v", "u2", "v2")


define("labels_swapped", "SELECT * REPLACE (CASE WHEN (ck + k) % 17 = 1 THEN 1920 - u ELSE u END AS u) FROM labels_a")
define("bad_triples", """SELECT a.match_id, a.frame_idx, a.landmark AS la, b.landmark AS lb, c.landmark AS lc,
 (b.u-a.u)*(c.v-a.v) - (b.v-a.v)*(c.u-a.u) AS cp, sqrt(power(b.u-a.u,2)+power(b.v-a.v,2))*sqrt(power(c.u-a.u,2)+power(c.v-a.v,2)) AS np,
 (b.lx-a.lx)*(c.ly-a.ly) - (b.ly-a.ly)*(c.lx-a.lx) AS cm, sqrt(power(b.lx-a.lx,2)+power(b.ly-a.ly,2))*sqrt(power(c.lx-a.lx,2)+power(c.ly-a.ly,2)) AS nm
 FROM labels_swapped a JOIN labels_swapped b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.landmark < b.landmark
 JOIN labels_swapped c ON b.match_id = c.match_id AND b.frame_idx = c.frame_idx AND b.landmark < c.landmark""")
define("triple_counts", """SELECT match_id, frame_idx, landmark, count(*) AS bad_triples FROM (SELECT match_id, frame_idx, unnest([la, lb, lc]) AS landmark FROM bad_triples
 WHERE np <> 0 AND nm <> 0 AND abs(cp) >= 0.02*np AND abs(cm) >= 0.02*nm AND (cp > 0) <> (cm > 0)) GROUP BY ALL""")


@query("orientation_suspects", "SELECT * FROM triple_counts QUALIFY bad_triples = max(bad_triples) OVER (PARTITION BY match_id, frame_idx)")
def orientation_suspects(spark, sf):
    lab = labels_a(spark, sf)
    return L.orientation_suspects(lab.withColumn("u", F.when((F.col("ck") + F.col("k")) % 17 == 1, 1920 - F.col("u")).otherwise(F.col("u"))))


@query("calibration_jitter", """SELECT match_id, avg(j) FILTER (sw) AS switch_m, avg(j) FILTER (NOT sw) AS between_m, count(j) FILTER (sw) AS pairs_switch,
 count(j) FILTER (NOT sw) AS pairs_between, count(*) FILTER (j IS NULL) AS pairs_skipped FROM (SELECT match_id, frame_idx, any_value(sw) AS sw, avg(moved) AS j FROM (
 SELECT *, sqrt(power((a*(u + t) + b)/(1 + p1*v) - lx, 2) + power((c*v + d)/(1 + p1*v) - ly, 2)) AS moved FROM (SELECT *, (lx*(1 + p*v) - b)/a AS u FROM (
 SELECT q.*, lx, ly, (ly - d)/(c - p*ly) AS v FROM (SELECT *, lead(p) OVER w AS p1, keyf OR lead(keyf) OVER w AS sw, lead(frame_idx) OVER w AS nf FROM cams
 WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)) q, pitch_points WHERE nf IS NOT NULL))) GROUP BY match_id, frame_idx) GROUP BY match_id""",
       "switch_m between_m")
def calibration_jitter(spark, sf):
    pts = G.landmark_array(F.lit(105.0), F.lit(68.0))
    points = D.matches(spark, sf).select("match_id", F.posexplode(pts).alias("k", "p")).select("match_id", "p.lx", "p.ly")
    return C.calibration_jitter(cams(spark, sf), points)


@query("pair_weighted_mean", """SELECT match_id, sum(m*n)/nullif(sum(n), 0) AS weighted_mean FROM (SELECT match_id, CASE WHEN ck % 5 <> 0 THEN (ck % 11)/10.0::DOUBLE END AS m,
 CASE WHEN ck % 5 <> 0 THEN ck % 4 END AS n FROM frames) GROUP BY match_id""", "weighted_mean")
def pair_weighted_mean(spark, sf):
    w = D.frames(spark, sf).selectExpr("match_id", "if(ck % 5 <> 0, (ck % 11) / 10D, null) as m", "ck % 4 as n")
    return C.pair_weighted_mean(w, "m", "n", ["match_id"])


# ------------------------------------------------------------------ camera lines

define("line_labels", """SELECT match_id, frame_idx, ck, line, q, ((ck*(k+3+q)) % 97)/97.0::DOUBLE AS qx, ((ck*(k+5+q)) % 89)/89.0::DOUBLE AS qy
 FROM frames, ground_lines, range(2) t(q)""")
define("line_cams", """SELECT match_id, frame_idx, radians((ck % 21 - 10)::DOUBLE) AS pa, radians((75 + ck % 5)::DOUBLE) AS ti, 1500.0::DOUBLE*0.5 AS fo FROM frames""")
define("line_variants", """SELECT match_id, frame_idx, 0 AS m, line, qx, qy FROM line_labels UNION ALL SELECT match_id, frame_idx, 1,
 CASE WHEN line LIKE '%left%' THEN replace(line, 'left', 'right') WHEN line LIKE '%right%' THEN replace(line, 'right', 'left') WHEN line LIKE '%top' THEN replace(line, 'top', 'bottom')
 WHEN line LIKE '%bottom' THEN replace(line, 'bottom', 'top') ELSE line END, qx, qy FROM line_labels""")
define("line_px", """SELECT match_id, frame_idx, line, i, CASE WHEN z > 1e-3 THEN fo*xx/z + 480 END AS u, CASE WHEN z > 1e-3 THEN fo*yy/z + 270 END AS v FROM (
 SELECT match_id, frame_idx, line, i, fo, cos(pa)*wx + sin(pa)*wy AS xx, -sin(pa)*cos(ti)*wx + cos(pa)*cos(ti)*wy + sin(ti)*15 AS yy,
 sin(pa)*sin(ti)*wx - cos(pa)*sin(ti)*wy + cos(ti)*15 AS z FROM (SELECT c.*, line, i, ax + (bx-ax)*i/59.0::DOUBLE AS wx, ay + (by_-ay)*i/59.0::DOUBLE - 70 AS wy
 FROM line_cams c, ground_lines, range(60) t(i)))""")
define("line_segments", "SELECT *, lead(u) OVER w AS u1, lead(v) OVER w AS v1 FROM line_px WHERE u IS NOT NULL WINDOW w AS (PARTITION BY match_id, frame_idx, line ORDER BY i)")
define("line_point_dist", """SELECT match_id, frame_idx, m, line, qx, qy, min(sqrt(power(pu - u - w*(u1-u), 2) + power(pv - v - w*(v1-v), 2))) AS dd FROM (
 SELECT *, least(greatest(((pu-u)*(u1-u) + (pv-v)*(v1-v))/greatest(power(u1-u,2) + power(v1-v,2), 1e-12), 0), 1) AS w FROM (
 SELECT l.*, qx*959 AS pu, qy*539 AS pv, u, v, u1, v1 FROM line_variants l JOIN line_segments s USING (match_id, frame_idx, line) WHERE u1 IS NOT NULL)) GROUP BY ALL""")


@query("median_reprojection_px", """SELECT match_id, frame_idx, round(min(px), 3) AS median_px FROM (SELECT match_id, frame_idx, m, median(dd) AS px
 FROM line_point_dist GROUP BY match_id, frame_idx, m) GROUP BY match_id, frame_idx""", "median_px")
def median_reprojection_px(spark, sf):
    f = D.frames(spark, sf)
    names = F.array(*[F.lit(r[1]) for r in LINES])
    lines = f.select("match_id", "frame_idx", "ck", F.posexplode(names).alias("k", "line")).withColumn("q", F.explode(F.array(F.lit(0), F.lit(1))))
    lines = lines.selectExpr("match_id", "frame_idx", "line", "((ck * (k + 3 + q)) % 97) / 97D as qx", "((ck * (k + 5 + q)) % 89) / 89D as qy")
    cam = f.selectExpr("match_id", "frame_idx", "cast(ck % 21 - 10 as double) as pan", "cast(75 + ck % 5 as double) as tilt", "0D as roll",
                       "0D as cx", "70D as cy", "-15D as cz", "1500D as focal", "960D as ppx", "540D as ppy")
    return C.median_reprojection_px(lines, cam)


@query("mirror_lines", """SELECT match_id, frame_idx, count(*) AS n, count(DISTINCT line) AS names, min(line) AS first_line FROM line_variants WHERE m = 1 GROUP BY match_id, frame_idx""")
def mirror_lines(spark, sf):
    names = F.array(*[F.lit(r[1]) for r in LINES])
    l = D.frames(spark, sf).select("match_id", "frame_idx", F.explode(names).alias("line"))
    l = l.withColumn("q", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("line", G.mirror_line())
    return l.groupBy("match_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("names"), F.min("line").alias("first_line"))


# ------------------------------------------------------------------ pitch size

define("measures", "SELECT match_id, 68 + (ck % 40)/4.0::DOUBLE + CASE WHEN ck % 3 = 0 THEN 20 ELSE 0 END AS value, frame_idx AS ord FROM frames")


@query("consensus_measure", """SELECT match_id, any_value(med) AS value, any_value(agree) AS n_agree, any_value(spread) AS spread FROM (SELECT b.*, (SELECT max(value) - min(value) FROM measures m
 WHERE m.match_id = b.match_id) AS spread, (SELECT median(m.value) FROM measures m WHERE m.match_id = b.match_id AND abs(m.value - b.value) <= 2) AS med FROM (
 SELECT a.match_id, a.value, a.ord, count(*) AS agree, row_number() OVER (PARTITION BY a.match_id ORDER BY count(*) DESC, a.ord) AS k FROM measures a
 JOIN measures b ON a.match_id = b.match_id AND abs(a.value - b.value) <= 2 GROUP BY a.match_id, a.value, a.ord) b WHERE k = 1) GROUP BY match_id""", "value spread")
def consensus_measure(spark, sf):
    m = D.frames(spark, sf).selectExpr(
        "match_id", "68D + (ck % 40) / 4D + if(ck % 3 = 0, 20D, 0D) as value", "frame_idx as ord")
    return C.consensus_measure(m)


@query("cross_check_dims", """SELECT match_id, sx AS span_x, sy AS span_y, CASE WHEN 105 < sx THEN 'impossible' WHEN 105 > sx/0.75 THEN 'implausible' ELSE 'fine' END AS length_check,
 CASE WHEN w < sy THEN 'impossible' WHEN w > sy/0.75 THEN 'implausible' ELSE 'fine' END AS width_check, NOT (105 < sx OR 105 > sx/0.75) AND NOT (w < sy OR w > sy/0.75) AS ok
 FROM (SELECT match_id, 40 + 20*(match_id::INT % 2) AS w, quantile_cont(x, 0.995) - quantile_cont(x, 0.005) AS sx, quantile_cont(y, 0.995) - quantile_cont(y, 0.005) AS sy
 FROM gt GROUP BY match_id)""", "span_x span_y")
def cross_check_dims(spark, sf):
    m = D.matches(spark, sf).selectExpr("match_id", "105D as length", "40D + 20D * (cast(match_id as int) % 2) as width", "true as confident")
    return C.cross_check_dims(m, players(D.tracks(spark, sf)))


@query("pooled_calibration_score", """SELECT run_id, 100*p/l*(jp/p)/100 AS score, jp/p AS jac5, 100*p/l AS completeness, round(cs, 4) AS calibrated_share, round(ka/k, 4) AS keyframe_accept_rate FROM (
 SELECT match_id AS run_id, sum(lab)::DOUBLE AS l, sum(pr)::DOUBLE AS p, sum(jac*pr) AS jp, avg(cs) AS cs, sum(keyf)::DOUBLE AS k, sum(ka)::DOUBLE AS ka FROM (
 SELECT match_id, frame_idx // 250 AS clip, count(*) AS lab, count(*) FILTER (ck % 10 <> 0) AS pr, avg(ck % 100) AS jac, avg((ck % 10 <> 0)::INT) AS cs,
 count(*) FILTER (frame_idx % 10 = 0) AS keyf, count(*) FILTER (frame_idx % 10 = 0 AND ck % 3 <> 0) AS ka FROM frames GROUP BY match_id, frame_idx // 250) GROUP BY match_id)""",
       "score jac5 completeness calibrated_share keyframe_accept_rate")
def pooled_calibration_score(spark, sf):
    has, key = F.col("ck") % 10 != 0, F.col("frame_idx") % 10 == 0
    clips = D.frames(spark, sf).groupBy("match_id", F.expr("frame_idx div 250").alias("clip")).agg(
        F.count(F.lit(1)).alias("labelled"), F.count(F.when(has, 1)).alias("predicted"), F.avg(F.col("ck") % 100).alias("jac5"),
        F.avg(has.cast("int")).alias("calibrated_share"), F.count(F.when(key, 1)).alias("keyframes"),
        F.count(F.when(key & (F.col("ck") % 3 != 0), 1)).alias("keyframes_accepted"))
    return C.pooled_calibration_score(clips.withColumnRenamed("match_id", "run_id"))


# ------------------------------------------------------------------ keys, splits, samples

@query("frame_key", "SELECT match_id, frame_idx, match_id || '/' || lpad(frame_idx::VARCHAR, 7, '0') AS key FROM frames")
def frame_key(spark, sf):
    return D.frames(spark, sf).select("match_id", "frame_idx", L.frame_key().alias("key"))


@query("match_slug", """SELECT match_id, 'da-nang-' || (ck % 7) || '-hai-phong-duc' AS slug, count(*) AS n FROM frames GROUP BY ALL""")
def match_slug(spark, sf):
    f = D.frames(spark, sf).withColumn("filename", F.concat(
        F.lit("ĐÀ NẴNG "), (F.col("ck") % 7).cast("string"), F.lit(" - HẢI PHÒNG (Đức) - LPBANK V.LEAGUE 1 - 2025-26.mp4")))
    return f.select("match_id", L.match_slug().alias("slug")).groupBy("match_id", "slug").agg(F.count(F.lit(1)).alias("n"))


SPLITS = """SELECT match_id, frame_idx, match_id || '/' || lpad(frame_idx::VARCHAR, 7, '0') AS key, CASE WHEN r % 2 = 0 THEN 'dev' ELSE 'frozen' END AS split, r % 4 = 1 AS relabel
 FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1 AS r FROM label_frames)"""


def splits(spark, sf):
    return L.assign_splits(D.frames(spark, sf).select("match_id", "frame_idx"))


@query("assign_splits", SPLITS, cte=True)
def assign_splits(spark, sf):
    return splits(spark, sf)


@query("even_spread_sample")
def even_spread_sample(spark, sf):
    c = D.frames(spark, sf).filter("ck % 3 <> 0").selectExpr("match_id", "frame_idx", "ck % 5 = 0 as rejected")
    return L.even_spread_sample(c, 15)


NUM = "regexp_replace(printf('%.2f', round({c}, 2)), '0$', '')"


@query("frozen_digest", f"""SELECT match_id, sha256('{{' || string_agg('"' || key || '":{{' || pts || '}}', ',' ORDER BY key) || '}}') AS digest FROM (
 SELECT match_id, key, string_agg('"' || landmark || '":[' || {NUM.format(c='u')} || ',' || {NUM.format(c='v')} || ']', ',' ORDER BY landmark) AS pts
 FROM labels_a JOIN assign_splits USING (match_id, frame_idx) WHERE split = 'frozen' GROUP BY match_id, key) GROUP BY match_id""")
def frozen_digest(spark, sf):
    return L.frozen_digest(labels_a(spark, sf), splits(spark, sf), ["match_id"])


@query("leakage_subset", """SELECT game, count(*) AS n FROM (SELECT 'L' || (ck % 3) || '|' || match_id || '|' || (ck % 4) || '|' AS game FROM frames) WHERE game NOT IN
 (SELECT DISTINCT 'L1|' || match_id || '|' || (ck % 2) || '|' FROM frames) GROUP BY game""")
def leakage_subset(spark, sf):
    f = D.frames(spark, sf)
    frames = f.selectExpr("concat('L', ck % 3) as league", "match_id as season", "cast(ck % 4 as string) as match", "cast(null as string) as date")
    listed = f.selectExpr("concat('L1|', match_id, '|', ck % 2, '|') as game").distinct()
    return R.leakage_subset(frames, listed).groupBy("game").agg(F.count(F.lit(1)).alias("n"))
