"""Identity, team, tracking and streaming queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as CAL
from ..operators import identity as I
from ..operators import kinematics as K
from ..operators import possession as P
from ..operators import scoring as SC
from ..operators import sequences as Q
from ..operators import shape as H
from ..operators import teams as M
from ..operators import tracking as T
from ..schema import players
from ..sources.scratch import scratch_dir, written
from ..streaming import live as L
from . import derive as D
from .registry import CTE, define, query
from .tactics import BLOCK, BLOCK_DOUBLES, SEQ_DOUBLES, norm

# ------------------------------------------------------------------ tracklets

define("frag_tail", """SELECT match_id, track_id, arg_min(x, frame_idx) AS tx, arg_min(y, frame_idx) AS ty, min(frame_idx) AS tf FROM (
 SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY frame_idx DESC) AS r FROM tracks_frag) WHERE r <= 11 GROUP BY match_id, track_id""")
define("tracklets_sql", """SELECT *, (ex - tx)/greatest((f1 - tf)/25.0::DOUBLE, 1e-6) AS vx, (ey - ty)/greatest((f1 - tf)/25.0::DOUBLE, 1e-6) AS vy FROM (
 SELECT match_id, track_id, count(*) AS n_frames, min(frame_idx) AS f0, max(frame_idx) AS f1, arg_min(x, frame_idx) AS sx, arg_min(y, frame_idx) AS sy,
 arg_max(x, frame_idx) AS ex, arg_max(y, frame_idx) AS ey FROM tracks_frag GROUP BY match_id, track_id) JOIN frag_tail USING (match_id, track_id)""")


def tracklets(spark, sf, embeddings=None):
    return I.build_tracklets(D.tracks_frag(spark, sf), embeddings)


@query("build_tracklets", """SELECT match_id, track_id AS tracklet_id, n_frames, f0 AS start_frame, f1 AS end_frame, sx, sy, ex, ey, vx, vy, w.role FROM tracklets_sql JOIN role_winner w USING (match_id, track_id)""",
       "sx sy ex ey vx vy")
def build_tracklets(spark, sf):
    return tracklets(spark, sf).select("match_id", "tracklet_id", "n_frames", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"),
                                       "sx", "sy", "ex", "ey", "vx", "vy", "role")


define("votes_sql", "SELECT match_id, track_id, number, sum(confidence) AS c, count(*) AS k FROM jersey_reads GROUP BY match_id, track_id, number")


@query("add_jersey_reads", "SELECT match_id, track_id AS tracklet_id, number, c FROM votes_sql", "c")
def add_jersey_reads(spark, sf):
    t = I.add_jersey_reads(tracklets(spark, sf), D.jersey_reads(spark, sf))
    return t.select("match_id", "tracklet_id", F.explode("votes").alias("number", "c"))


@query("best_jersey", "SELECT match_id, track_id AS tracklet_id, arg_min(number, (-round(c, 9), number)) AS number, max(c)/sum(c) AS share, sum(k)::BIGINT AS reads FROM votes_sql GROUP BY ALL", "share")
def best_jersey(spark, sf):
    n, s, r = I.best_jersey()
    t = I.add_jersey_reads(tracklets(spark, sf), D.jersey_reads(spark, sf))
    return t.filter(F.size("votes") > 0).select("match_id", "tracklet_id", n.alias("number"), s.alias("share"), r.alias("reads"))


@query("candidate_successors", """SELECT a.match_id, a.track_id AS a, b.track_id AS b, sqrt(power(b.sx - (a.ex + a.vx*g), 2) + power(b.sy - (a.ey + a.vy*g), 2)) AS cost FROM tracklets_sql a
 JOIN tracklets_sql b ON a.match_id = b.match_id AND b.f0 > a.f1 AND b.f0 - a.f1 <= 50, LATERAL (SELECT (b.f0 - a.f1)/25.0::DOUBLE AS g)
 WHERE sqrt(power(b.sx - a.ex, 2) + power(b.sy - a.ey, 2)) <= 9*g + 2""", "cost")
def candidate_successors(spark, sf):
    return I.candidate_successors(tracklets(spark, sf)).select("match_id", "a", "b", "cost")


@query("stitch_tracklets")
def stitch_tracklets(spark, sf):
    return I.stitch_tracklets(tracklets(spark, sf)).select("match_id", "tracklet_id", F.size("track_ids").alias("n_tracks"), "start", "end", "n_frames")


@query("merge_by_jersey")
def merge_by_jersey(spark, sf):
    t = I.add_jersey_reads(tracklets(spark, sf), D.jersey_reads(spark, sf)).withColumn(
        "team", F.when(F.col("tracklet_id") < 12000, "home").otherwise("away"))
    return I.merge_by_jersey(t).select("match_id", "tracklet_id", F.size("track_ids").alias("n_tracks"), "jersey", "n_frames", "reads")


@query("assign_teams_with_roster")
def assign_teams_with_roster(spark, sf):
    t = tracklets(spark, sf).withColumn("team_score", (F.col("tracklet_id") - 12000) / 12000.0)
    return I.assign_teams_with_roster(t).select("match_id", "tracklet_id", "team")


define("wide_rows", "SELECT * REPLACE (CASE WHEN e IN (3, 14) THEN 33.8::DOUBLE ELSE y END AS y, CASE WHEN e = 14 THEN 10.0::DOUBLE WHEN e = 3 THEN (frame_idx % 60)/4.0::DOUBLE ELSE x END AS x) FROM tracks_frag")


@query("touchline_people", """SELECT match_id, track_id AS tracklet_id, CASE WHEN greatest(max(x) - min(x), max(y) - min(y)) > 5 THEN 'referee' ELSE 'other' END AS line_role FROM wide_rows
 GROUP BY match_id, track_id HAVING count(*) >= 25 AND avg((abs(y) >= 33.5 OR abs(x) >= 52)::INT) >= 0.8""")
def touchline_people(spark, sf):
    t = D.tracks_frag(spark, sf).withColumn("y", F.when(F.col("e").isin(3, 14), 33.8).otherwise(F.col("y"))).withColumn(
        "x", F.when(F.col("e") == 14, 10.0).when(F.col("e") == 3, (F.col("frame_idx") % 60) / 4.0).otherwise(F.col("x")))
    return I.touchline_people(t, I.build_tracklets(t))


define("extremes", "SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM tracks_frag WINDOW w AS (PARTITION BY match_id, frame_idx)")


@query("frame_extremes", "SELECT match_id, frame_idx, track_id, lo AS frame_min_x, hi AS frame_max_x FROM extremes", "frame_min_x frame_max_x")
def frame_extremes(spark, sf):
    return I.frame_extremes(D.tracks_frag(spark, sf)).select("match_id", "frame_idx", "track_id", "frame_min_x", "frame_max_x")


define("keepers_sql", """SELECT * FROM (SELECT match_id, track_id AS tracklet_id, CASE WHEN avg((x <= -36 AND abs(y) <= 20.16)::INT) >= 0.9 AND avg((x <= lo)::INT) >= 0.7 THEN -1
 WHEN avg((x >= 36 AND abs(y) <= 20.16)::INT) >= 0.9 AND avg((x >= hi)::INT) >= 0.7 THEN 1 END AS end_ FROM extremes GROUP BY match_id, track_id HAVING count(*) >= 25) WHERE end_ IS NOT NULL""")


@query("goalkeeper_tracklets", "SELECT match_id, tracklet_id, end_ AS \"end\" FROM keepers_sql")
def goalkeeper_tracklets(spark, sf):
    t = D.tracks_frag(spark, sf)
    return I.goalkeeper_tracklets(t, I.build_tracklets(t))


define("frag_turned", "SELECT p.* REPLACE (x * coalesce(sgn, -1) AS x, y * coalesce(sgn, -1) AS y) FROM tracks_frag p LEFT JOIN period_sign USING (match_id, period)")
define("turned_extremes", CTE["extremes"].replace("tracks_frag", "frag_turned"))
define("turned_keepers", CTE["keepers_sql"].replace("extremes", "turned_extremes"))


@query("goalkeeper_teams", """SELECT k.match_id, k.tracklet_id, CASE WHEN (end_ < 0) = (h < a) THEN 'home' ELSE 'away' END AS keeper_team FROM turned_keepers k JOIN (
 SELECT match_id, avg(x) FILTER (team = 'home') AS h, avg(x) FILTER (team = 'away') AS a FROM frag_turned t
 WHERE NOT EXISTS (SELECT 1 FROM turned_keepers k WHERE k.match_id = t.match_id AND k.tracklet_id = t.track_id) GROUP BY match_id) USING (match_id)""")
def goalkeeper_teams(spark, sf):
    """Over both halves, turned so that each team keeps its end."""
    t = H.normalise_direction(D.tracks_frag(spark, sf))
    tl = I.build_tracklets(t).withColumn("team", F.when(F.col("tracklet_id") < 12000, "home").otherwise("away"))
    return I.goalkeeper_teams(t, tl, I.goalkeeper_tracklets(t, tl))


# ------------------------------------------------------------------ kits

define("kit_rows", """SELECT match_id, track_id, frame_idx, role, e, CASE WHEN e % 11 = 0 THEN 2 WHEN e < 11 THEN 0 ELSE 1 END AS kit, (ck*(e+1)) % 10 AS wob FROM gt""")


def kit_rows(spark, sf):
    """Three kits: two teams and the keepers', with a little noise and one row in ten blank."""
    p = D.as_tracks(D.people(spark, sf))
    d = "transform(sequence(0, 5), k -> if(w = 9, 0D, if(k = kit * 2, 1D, 0D) + if(k = w % 6, 0.1D, 0D)))"
    p = p.selectExpr("match_id", "track_id", "frame_idx", "role", "if(e % 11 = 0, 2, if(e < 11, 0, 1)) as kit", "(ck * (e + 1)) % 10 as w")
    return p.selectExpr("match_id", "track_id", "frame_idx", "role", "kit", f"{d} as descriptor")


@query("kit_clusters")
def kit_clusters(spark, sf):
    return M.kit_clusters(kit_rows(spark, sf)).select("match_id", "balance", F.get("c0", F.lit(0)).alias("c00"), F.get("c1", F.lit(0)).alias("c10"))


define("kit_swaps", """SELECT match_id, track_id, (CASE WHEN e < 11 THEN 0 ELSE 1 END + CASE WHEN (ck + e) % 7 = 0 THEN 1 ELSE 0 END) % 2 AS cluster, (ck*(e+1)) % 10 AS wob FROM gt""")


def kit_swaps(spark, sf):
    """Two kits; one row in seven of a track wears the other one, one in ten is blank."""
    p = D.as_tracks(D.people(spark, sf)).selectExpr("match_id", "track_id", "frame_idx", "(if(e < 11, 0, 1) + if((ck + e) % 7 = 0, 1, 0)) % 2 as kit", "(ck * (e + 1)) % 10 as w")
    return p.selectExpr("match_id", "track_id", "frame_idx", "transform(sequence(0, 5), k -> if(w = 9, 0D, if(k = kit * 2, 1D, 0D) + if(k = w % 6, 0.1D, 0D))) as descriptor")


@query("pooled_kits", """SELECT count(*)::DOUBLE AS n, """ + ", ".join(
    f"avg(CASE WHEN kit*2 = {k} THEN 1 ELSE 0 END + CASE WHEN wob % 6 = {k} THEN 0.1::DOUBLE ELSE 0 END) AS d{k}" for k in range(6)) + " FROM kit_rows WHERE wob <> 9 GROUP BY kit",
       " ".join(f"d{k}" for k in range(6)))
def pooled_kits(spark, sf):
    """Three kits of all matches in one pool: the centres are the kits' means."""
    return spark.createDataFrame([(float(m), *map(float, c)) for c, m in M.pooled_kits(kit_rows(spark, sf), 3)],
                                 "n double, " + ", ".join(f"d{k} double" for k in range(6)))


@query("kit_diagnosis", """SELECT *, consistency >= 0.85 AND balance >= 0.7 AS ok, CASE WHEN balance < 0.7 THEN 'lopsided' WHEN consistency >= 0.85 THEN 'sound' ELSE 'tracks flip' END AS note FROM (
 SELECT match_id, coalesce(avg(CASE WHEN n >= 3 THEN greatest(c0, n - c0)/n END), 0) AS consistency, 1 - abs(sum(c0)/sum(n) - 0.5)*2 AS balance FROM (
 SELECT match_id, track_id, count(*) FILTER (cluster = 0) AS c0, count(*) AS n FROM kit_swaps WHERE wob <> 9 GROUP BY ALL) GROUP BY match_id)""", "consistency balance")
def kit_diagnosis(spark, sf):
    """Descriptors, pooled clusters, a label per row, and whether the split can be trusted."""
    rows = kit_swaps(spark, sf)
    return SC.cluster_diagnosis(M.predict_kits(rows, M.pooled_kit_clusters(rows)))


def kit_labels(spark, sf):
    """Labels as a clustering would give them: the kit (keepers' called 0), sure to a varying degree."""
    return kit_rows(spark, sf).selectExpr("match_id", "track_id", "frame_idx", "role", "kit % 2 as cluster", "((track_id * 7 + frame_idx) % 10 + 1) / 10D as gap")


define("kit_votes", """SELECT match_id, track_id, coalesce(sum(gap) FILTER (kit % 2 = 0), 0) AS w0, coalesce(sum(gap) FILTER (kit % 2 = 1), 0) AS w1, count(*) AS n FROM
 (SELECT *, ((track_id*7 + frame_idx) % 10 + 1)/10.0::DOUBLE AS gap FROM kit_rows) GROUP BY match_id, track_id""")


@query("track_scores", "SELECT match_id, track_id, coalesce((w1 - w0)/nullif(w0 + w1, 0), 0) AS score FROM kit_votes", "score")
def track_scores(spark, sf):
    return M.track_scores(kit_labels(spark, sf))


@query("assign_tracks", """SELECT match_id, track_id, CASE WHEN i <= cut THEN 'home' ELSE 'away' END AS team, greatest(w0, w1)/(w0 + w1)*(1 - 0.5*(1 - abs(i - cut)/greatest(nn, 1))) AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY (w1 - w0)/(w0 + w1), track_id) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS nn, count(*) OVER (PARTITION BY match_id) // 2 - 1 AS cut FROM kit_votes)""", "confidence")
def assign_tracks(spark, sf):
    return M.assign_tracks(kit_labels(spark, sf))


@query("mean_descriptors", """SELECT match_id, track_id, count(*) AS n, avg(CASE WHEN kit = 0 THEN 1 ELSE 0 END + CASE WHEN wob % 6 = 0 THEN 0.1::DOUBLE ELSE 0 END) AS d0 FROM kit_rows WHERE wob <> 9 GROUP BY match_id, track_id""", "d0")
def mean_descriptors(spark, sf):
    return M.mean_descriptors(kit_rows(spark, sf)).select("match_id", "track_id", "n", F.get("embedding", F.lit(0)).alias("d0"))


@query("team_scores_by_track")
def team_scores_by_track(spark, sf):
    return M.team_scores_by_track(M.mean_descriptors(kit_rows(spark, sf)))


define("kit_centres", "SELECT match_id, kit, count(*) AS n, count(DISTINCT track_id) AS ids, " + ", ".join(
    f"avg(CASE WHEN kit*2 = {k} THEN 1 ELSE 0 END + CASE WHEN wob % 6 = {k} THEN 0.1::DOUBLE ELSE 0 END) AS c{k}" for k in range(6)) + " FROM kit_rows WHERE wob <> 9 GROUP BY match_id, kit")
KIT_GAP = "sqrt(" + " + ".join(f"power({{a}}.c{k} - {{b}}.c{k}, 2)" for k in range(6)) + ")"


@query("split_officials", f"""SELECT match_id, CASE WHEN id_share > 0.25 THEN 'too many tracks' WHEN obs_share > 0.2 THEN 'too many observations' WHEN separation < 0.6 THEN 'not separate'
 ELSE 'split' END AS reason, id_share, obs_share, separation FROM (SELECT match_id, s.ids/(s.ids + t.ids + u.ids) AS id_share, s.n/(s.n + t.n + u.n) AS obs_share,
 least({KIT_GAP.format(a='s', b='t')}, {KIT_GAP.format(a='s', b='u')})/{KIT_GAP.format(a='t', b='u')} AS separation
 FROM kit_centres s JOIN kit_centres t USING (match_id) JOIN kit_centres u USING (match_id) WHERE s.kit = 2 AND t.kit = 0 AND u.kit = 1)""", "id_share obs_share separation")
def split_officials(spark, sf):
    return M.split_officials(M.mean_descriptors(kit_rows(spark, sf)), report=True)


def _wobbled(p, dims: int):
    """Descriptors of a kit each: one in ten is blank, the others carry a little noise."""
    return p.selectExpr("match_id", "track_id", "frame_idx", f"transform(sequence(0, {dims - 1}), k -> if(w = 9, 0D, if(k = kit * 2, 1D, 0D) + if(k = w % {dims}, 0.1D, 0D))) as descriptor")


# Four kits of 9, 8, 3 and 1 tracks; the person e = 3 is never seen well enough to have a descriptor.
define("kits4", """SELECT match_id, track_id, frame_idx, CASE WHEN e IN (0, 12, 13) THEN 2 WHEN e = 11 THEN 3 WHEN e < 11 THEN 0 ELSE 1 END AS kit, CASE WHEN e = 3 THEN 9 ELSE (ck*(e+1)) % 10 END AS wob FROM gt""")
FOUR = {k: f"avg(CASE WHEN kit*2 = {k} THEN 1 ELSE 0 END + CASE WHEN wob % 8 = {k} THEN 0.1::DOUBLE ELSE 0 END)" for k in range(8)}
define("kit4_centres", "SELECT match_id, kit, " + ", ".join(f"{v} AS c{k}" for k, v in FOUR.items()) + " FROM kits4 WHERE wob <> 9 GROUP BY match_id, kit")
define("kit4_means", "SELECT match_id, track_id, " + ", ".join(f"{v} AS c{k}" for k, v in FOUR.items()) + " FROM kits4 WHERE wob <> 9 GROUP BY match_id, track_id")
GAP4 = "sqrt(" + " + ".join(f"power(t.c{k} - {{b}}.c{k}, 2)" for k in range(8)) + ")"


def kits4(spark, sf):
    return _wobbled(D.as_tracks(D.people(spark, sf)).selectExpr(
        "match_id", "track_id", "frame_idx", "case when e in (0, 12, 13) then 2 when e = 11 then 3 when e < 11 then 0 else 1 end as kit", "if(e = 3, 9, (ck * (e + 1)) % 10) as w"), 8)


@query("team_scores_four_kits", f"""SELECT match_id, track_id, coalesce((a - b)/(a + b), 0) AS score FROM (SELECT DISTINCT match_id, track_id FROM kits4) LEFT JOIN (
 SELECT match_id, t.track_id, {GAP4.format(b='h')} AS a, {GAP4.format(b='w')} AS b
 FROM kit4_means t JOIN kit4_centres h USING (match_id) JOIN kit4_centres w USING (match_id) WHERE h.kit = 0 AND w.kit = 1) USING (match_id, track_id)""", "score")
def team_scores_four_kits(spark, sf):
    """Clusters that are the kits' means: every track's score is known, and a track that was never seen well has 0."""
    rows = kits4(spark, sf)
    return M.team_scores_by_track(M.mean_descriptors(rows), tracks=rows)


@query("kit_clusters_two", """SELECT match_id, 1 - abs(sum(n) FILTER (NOT away)/sum(n) - 0.5)*2 AS balance, max(d0) AS high0, min(d0) AS low0 FROM (
 SELECT match_id, e >= 11 AS away, count(*) AS n, avg(CASE WHEN cluster = 0 THEN 1 ELSE 0 END + CASE WHEN wob % 6 = 0 THEN 0.1::DOUBLE ELSE 0 END) AS d0
 FROM kit_swaps JOIN (SELECT DISTINCT match_id, track_id, e FROM gt) USING (match_id, track_id) WHERE wob <> 9 GROUP BY ALL) GROUP BY match_id""", "balance high0 low0")
def kit_clusters_two(spark, sf):
    """Two kits a match, one row in seven in the other one: the centroids are the teams' means."""
    a, b = F.get("c0", F.lit(0)), F.get("c1", F.lit(0))
    return M.kit_clusters(kit_swaps(spark, sf)).select("match_id", "balance", F.greatest(a, b).alias("high0"), F.least(a, b).alias("low0"))


@query("assign_seen_tracks", """SELECT match_id, track_id, CASE WHEN w0 + w1 IS NULL OR n < 5 THEN 'unknown' WHEN w0 >= w1 THEN 'home' ELSE 'away' END AS team,
 CASE WHEN w0 + w1 IS NULL OR n < 5 THEN 0 ELSE greatest(w0, w1)/(w0 + w1) END AS confidence FROM (
 SELECT match_id, track_id, count(*) FILTER (wob <> 9) AS n,
 CASE WHEN count(*) FILTER (wob <> 9) > 0 THEN count(*) FILTER (wob <> 9 AND kit IN (0, 2))/2 END AS w0, CASE WHEN count(*) FILTER (wob <> 9) > 0 THEN count(*) FILTER (wob <> 9 AND kit IN (1, 3))/2 END AS w1
 FROM kits4 GROUP BY match_id, track_id)""", "confidence")
def assign_seen_tracks(spark, sf):
    """Every track gets a team or `unknown`; kits 2 and 3 count as the team of their remainder."""
    rows = kits4(spark, sf)
    labels = rows.filter(M.usable()).selectExpr("match_id", "track_id", "frame_idx", "cast(if(array_position(descriptor, array_max(descriptor)) in (3, 7), 1, 0) as int) as cluster", "0.5D as gap")
    return M.assign_tracks(labels, balanced=False, tracks=rows)


@query("resolve_identity")
def resolve_identity(spark, sf):
    t = D.tracks_frag(spark, sf).select(*D.TRACK_COLUMNS).unionByName(D.as_tracks(D.ball(spark, sf)).select(*D.TRACK_COLUMNS))
    kits = D.tracks_frag(spark, sf).selectExpr(
        "match_id", "track_id", "frame_idx", "transform(sequence(0, 5), k -> if(k = if(e % 11 = 0, 4, if(e < 11, 0, 2)), 1D, 0.01D * ((ck + k) % 3))) as descriptor")
    out = I.resolve_identity(t, M.mean_descriptors(kits))
    return out.groupBy("match_id", "team", "role").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("people"))


# ------------------------------------------------------------------ tracking

def detections(spark, sf):
    t = D.tracks_wide(spark, sf).filter((F.col("ck") + F.col("e")) % 10 != 0)
    return t.select("match_id", "frame_idx", F.col("e").alias("det"), "x", "y", "role")


@query("track_detections")
def track_detections(spark, sf):
    return T.track_detections(detections(spark, sf)).groupBy("match_id", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


def _people(spark, sf):
    return D.as_tracks(D.people(spark, sf))


@query("select_ball")
def select_ball(spark, sf):
    return T.select_ball(D.ball_candidates(spark, sf), _people(spark, sf))


@query("select_ball_summary")
def select_ball_summary(spark, sf):
    return T.select_ball_summary(T.select_ball(D.ball_candidates(spark, sf), _people(spark, sf)))


@query("link_ball_path")
def link_ball_path(spark, sf):
    return T.link_ball_path(D.ball_candidates(spark, sf), _people(spark, sf))


# ------------------------------------------------------------------ streaming
# Each query streams a whole table, slice of time by slice, through the operator to the end and returns what was given out. Matches kick
# off 127 seconds apart, so they overlap; a closing row follows the last slice.

SLICES, SLICE_FILES = 6, 4


def _kicked_off(df):
    return df.withColumn("kickoff", F.timestamp_seconds(F.lit(946_684_800) + F.col("match_id").cast("long") * 127))


def _streamed(spark, source, build):
    """What `build` gives for the source, fed as SLICES stretches of event time, each one trigger, and the closing row."""
    table, path, out, mark = (scratch_dir(spark) for _ in range(4))
    timed = L.event_time(_kicked_off(source))
    ends = timed.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    if ends.a is None:
        return spark.createDataFrame([], build(source).schema)
    at = F.least(F.floor((F.col("ts").cast("double") - ends.a) / (ends.b - ends.a + 1e-6) * SLICES), F.lit(SLICES - 1)).cast("int")
    timed.withColumn("slice", at).drop("ts").write.partitionBy("slice").parquet(table)
    fed = spark.read.parquet(table)
    plain = _kicked_off(source).columns
    for i in range(SLICES):
        fed.filter(F.col("slice") == i).select(plain).repartition(SLICE_FILES).write.mode("append").parquet(path)
    L.closing_row(fed.select(plain)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(fed.select(plain).schema).option("maxFilesPerTrigger", SLICE_FILES).parquet(path)
    made = build(stream)
    q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


define("block1", BLOCK.format(src="norm", every=1))


@query("stream_team_block", "SELECT * FROM block1", BLOCK_DOUBLES)
def stream_team_block(spark, sf):
    t = norm(spark, sf)
    keepers = written(H.goalkeepers(t))
    return _streamed(spark, t.select("match_id", "frame_idx", "period", "timestamp", "track_id", "role", "team", "x", "y"), lambda s: L.frame_blocks(s, keepers))


def _window_number():
    """Windows of ten seconds counted from the match's kick-off."""
    return ((F.unix_micros("window_start") / 1_000_000 - 946_684_800 - F.col("match_id").cast("long") * 127) / 10).cast("long").alias("w")


@query("stream_coverage", """SELECT match_id, frame_idx // 250 AS w, count(*) AS rows, count(*) FILTER (role = 'ball') AS ball_frames, avg(abs(y)) FILTER (role <> 'ball') AS mean_abs_y FROM tracks
 GROUP BY match_id, frame_idx // 250""", "mean_abs_y")
def stream_coverage(spark, sf):
    out = _streamed(spark, D.tracks(spark, sf).select("match_id", "frame_idx", "role", "y"), L.window_coverage)
    return out.select("match_id", _window_number(), "rows", "ball_frames", "mean_abs_y")


@query("stream_press", """SELECT n.match_id, n.frame_idx // 250 AS w, team, min(ball_dist) AS closest_m, count(*) FILTER (ball_dist <= 5) AS within_5m, count(*) FILTER (ball_dist <= 10) AS within_10m
 FROM player_ball n JOIN possession_gt p USING (match_id, frame_idx)
 WHERE team = CASE p.ball_status WHEN 'HOME' THEN 'away' WHEN 'AWAY' THEN 'home' END GROUP BY n.match_id, n.frame_idx // 250, team""", "closest_m")
def stream_press(spark, sf):
    pairs = H.players_with_ball(norm(spark, sf)).join(D.possession_gt(spark, sf).select("match_id", "frame_idx", "ball_status"), ["match_id", "frame_idx"])
    out = _streamed(spark, pairs.select("match_id", "frame_idx", "team", "ball_dist", "ball_status"), L.window_press)
    return out.select("match_id", _window_number(), "team", "closest_m", "within_5m", "within_10m")


@query("stream_sequences", "SELECT * FROM detect_sequences", SEQ_DOUBLES)
def stream_sequences(spark, sf):
    hits = Q.sequence_hits(Q.frame_lookups(norm(spark, sf), D.possession_gt(spark, sf))).select(
        "match_id", "label", "team", "period", "run_flank", "shot", "frame_idx", "timestamp", "def_line_x", "compactness_m", "n_within_10m",
        "n_attackers", "n_defenders", "in_possession")
    return _streamed(spark, hits, lambda s: L.session_sequences(s, min_s={"low_block": 8.0, "high_press": 3.0, "flank_overload": 3.0}))


@query("stream_possession", "SELECT match_id, frame_idx, ball_status FROM infer_possession")
def stream_possession(spark, sf):
    return _streamed(spark, P.control_frames(norm(spark, sf)).select("match_id", "frame_idx", "control"), L.stream_possession)


@query("stream_tracks")
def stream_tracks(spark, sf):
    out = _streamed(spark, detections(spark, sf), L.stream_tracks)
    return out.groupBy("match_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_frame"))


@query("stream_ball")
def stream_ball(spark, sf):
    c = D.ball_candidates(spark, sf).select("match_id", "frame_idx", "cand", "x", "y", "conf")
    p = _people(spark, sf).select("match_id", "frame_idx", F.lit(-1).alias("cand"), "x", "y", F.lit(0.0).alias("conf"))
    return _streamed(spark, c.unionByName(p), L.stream_ball)


@query("user_frame_mapper", """SELECT match_id, frame_idx, track_id, bbox_x*0.1 AS x, bbox_y*0.1 AS y FROM tracks WHERE role <> 'ball'""", "x y")
def user_frame_mapper(spark, sf):
    """A user's own detections -> pitch function, plugged in with DataFrame.transform."""
    mapper = lambda df: df.withColumn("x", F.col("bbox_x") * 0.1).withColumn("y", F.col("bbox_y") * 0.1)
    return CAL.map_feet(players(D.tracks(spark, sf)), mapper).select("match_id", "frame_idx", "track_id", "x", "y")


@query("club_thresholds", """SELECT match_id, team, count(*) AS n FROM block5 WHERE def_line_x <= CASE WHEN team = 'home' THEN -30 ELSE -25 END GROUP BY match_id, team""")
def club_thresholds(spark, sf):
    """Rule thresholds from a per-team table instead of keyword arguments."""
    limits = D.matches(spark, sf).select("match_id", F.explode(F.array(
        F.struct(F.lit("home").alias("team"), F.lit(-30.0).alias("line")), F.struct(F.lit("away").alias("team"), F.lit(-25.0).alias("line")))).alias("r")).select("match_id", "r.*")
    b = H.team_block(norm(spark, sf), every=5).join(limits, ["match_id", "team"])
    return b.filter(F.col("def_line_x") <= F.col("line")).groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("n"))
