"""Track tables derived from the driver's `orders` table by the formulas in FIXTURES.md.

One order is one frame; people and ball rows are exploded from it. `SQL` holds the same
derivations as DuckDB common table expressions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AWAY, BALL, GOALKEEPER, HOME, PLAYER, UNKNOWN

FRAMES_PER_MATCH = 7500
FRAMES_PER_TASK = 1 << 16      # fixed value: with their 23 objects a few hundred MB, sorted in memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, by_match: bool = False) -> DataFrame:
    """One narrow row per frame, hashed by (match, frame) before anything is exploded from it; more tasks the more frames there are.

    With `by_match` the frames of a match share a task, and its id is known not to be null: files of matches then need no sort when written."""
    o = table(spark, sf_dir, "orders")
    f = (F.col("o_orderkey") % FRAMES_PER_MATCH)
    df = o.select(
        F.expr(f"cast(o_orderkey div {FRAMES_PER_MATCH} as string)").alias("match_id"),
        f.cast("int").alias("frame_idx"),
        F.expr(f"cast(1 + (o_orderkey % {FRAMES_PER_MATCH}) div 3750 as int)").alias("period"),
        ((f % 3750).cast("double") / 25.0).alias("timestamp"),
        F.expr(f"cast(((o_orderkey % {FRAMES_PER_MATCH}) div 250) % 6 as int)").alias("ph"),
        F.col("o_custkey").cast("long").alias("ck"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-o.count() // FRAMES_PER_TASK), 1)
    if by_match:
        return df.withColumn("match_id", F.coalesce("match_id", F.lit(""))).repartition(n, "match_id")
    return df.repartition(n, "match_id", "frame_idx")


# Base and step of u (length) and v (width) by phase 0-5, home then away.
_UB = (-42, 9, 5, -25, -20, -25, -20, -44, -44, -25, -42, -25)
_US = (7, 13, 10, 15, 15, 15, 15, 7, 10, 15, 7, 15)
_VB = (0, 8, 22, 0, 0, 0, 0, 0, 0, 0, 0, 0)
_VS = (4, 3, 3, 8, 8, 8, 8, 8, 8, 8, 4, 8)
BALL_AT = 22


def _place(e: int, ph: int) -> tuple[int, float, float]:
    """Who an object stands with (the ball at its holder, others at their own place), and that place as length and width."""
    h = e if e < BALL_AT else (11 if ph <= 1 else 0) + (10 if ph == 1 else 9)
    i, k, side = h % 11, ph + 6 * (h // 11), 1.0 if h < 11 else -1.0
    u = -50.0 if i == 0 else _UB[k] + _US[k] * ((i - 1) // 4)
    v = 0.0 if i == 0 else _VB[k] + _VS[k] * (2 * ((i - 1) % 4) - 3)
    return h, side * u, side * v


def _places(spark, objects: range) -> DataFrame:
    """One row per object `e`: people 0-21 and the ball 22, with arrays by phase of `_place`.

    Worked out here once: inlined into every filter on x and y, it made methods that the JVM does not compile."""
    row = lambda e, k, end: "array(" + ", ".join(f"{_place(e, ph)[k]}{end}" for ph in range(6)) + ")"
    table = lambda k, end: "array(" + ", ".join(row(e, k, end) for e in range(BALL_AT + 1)) + ")"
    return spark.range(objects.start, objects.stop, 1, 1).selectExpr(
        "cast(id as int) as e", f"{table(0, '')}[id] as hs", f"{table(1, 'D')}[id] as us", f"{table(2, 'D')}[id] as vs")


def _objects(df: DataFrame) -> DataFrame:
    """Positions of the objects of each frame, from its places."""
    base = ["match_id", "frame_idx", "period", "timestamp", "ph", "ck", "e"]
    flip = "if(period = 2, -1D, 1D)"
    return df.selectExpr(
        *base, "if(e = 22, -1, e % 11) as i", "e = 22 as _ball",
        f"{flip} * (us[ph] + ((ck * (hs[ph] + 1)) % 29 - 14) / 100D + if(e = 22, 0.5D, 0D)) as x",
        f"{flip} * if(e = 22 and ph = 5, 40D, vs[ph] + ((ck * (hs[ph] + 2)) % 29 - 14) / 100D) as y")


def frames_of_objects(frames: DataFrame, people: str, ball: str) -> DataFrame:
    """Frames with their people and their ball, if seen, as arrays of the given expression on o.e, o.x and o.y: the rows of `everyone`, never apart."""
    at = lambda objects: "array(" + ", ".join(
        "array(" + ", ".join("named_struct('e', {}, 'h', {}, 'u', {}D, 'v', {}D)".format(e, *_place(e, ph)) for e in objects) + ")" for ph in range(6)) + ")[ph]"
    f = frames.selectExpr("*", "if(period = 2, -1D, 1D) as flip", f"{at(range(BALL_AT))} as people", f"if({_BALL_SEEN}, {at([BALL_AT])}, array()) as ball")
    x = "flip * (p.u + ((ck * (p.h + 1)) % 29 - 14) / 100D{})".format
    y = "flip * (p.v + ((ck * (p.h + 2)) % 29 - 14) / 100D)"
    of = lambda k, x, y, text: f"transform(transform({k}, p -> named_struct('e', p.e, 'x', {x}, 'y', {y})), o -> {text}) as {k}"
    return f.selectExpr(*frames.columns, of("people", x(""), y, people), of("ball", x(" + 0.5D"), f"if(ph = 5, flip * 40D, {y})", ball))


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        "match_id", "frame_idx", "period", "timestamp", "ph", "ck", "e",
        "i", F.expr("if(_ball, -1, e + 1)").alias("track_id"),
        F.expr(f"if(_ball, '{BALL}', if(i = 0 and frame_idx % 2 = 0, '{GOALKEEPER}', '{PLAYER}'))").alias("role"),
        F.expr(f"if(_ball, '{UNKNOWN}', if(e < 11, '{HOME}', '{AWAY}'))").alias("team"),
        F.expr("if(_ball, null, i + 1D)").alias("jersey"),
        F.expr("960D + 8D * x - if(_ball, 4D, 10D)").alias("bbox_x"),
        F.expr("540D + 6D * y - if(_ball, 4D, 40D)").alias("bbox_y"),
        F.expr("if(_ball, 8D, 20D)").alias("bbox_w"), F.expr("if(_ball, 8D, 40D)").alias("bbox_h"),
        F.expr("0.3D + if(_ball, ck % 50, (ck * (e + 1)) % 70) / 100D").alias("det_conf"),
        "x", "y", F.expr("if(_ball, 0D, null)").alias("z"))


_BALL_SEEN = "(ck % 7 <> 0 and not (frame_idx % 1500 between 1300 and 1399))"


def each(df: DataFrame, few: DataFrame) -> DataFrame:
    """Every row with every row of the small table `few`.

    Written as a product, not an explode: Spark takes exploded rows to be as few as the rows they come from, and would send
    a table of all people to every task in a join."""
    return df.crossJoin(few)


def people(spark, sf_dir) -> DataFrame:
    return _rows(_objects(each(frames(spark, sf_dir), _places(spark, range(BALL_AT)))))


def ball(spark, sf_dir) -> DataFrame:
    return _rows(_objects(each(frames(spark, sf_dir).filter(_BALL_SEEN), _places(spark, range(BALL_AT, BALL_AT + 1)))))


def everyone(spark, sf_dir) -> DataFrame:
    """People and ball from one product, so no union doubles the scan."""
    return _rows(_objects(each(frames(spark, sf_dir), _places(spark, range(BALL_AT + 1))).filter(f"e < 22 or {_BALL_SEEN}")))


TRACK_COLUMNS = ["match_id", "frame_idx", "period", "timestamp", "track_id", "role", "team", "jersey",
                 "bbox_x", "bbox_y", "bbox_w", "bbox_h", "det_conf", "x", "y", "z",
                 "speed", "accel", "interpolated", "live_wide", "shot"]


def as_tracks(df: DataFrame) -> DataFrame:
    extra = {"speed": "cast(null as double)", "accel": "cast(null as double)", "interpolated": "false",
             "live_wide": "true", "shot": "0"}
    return df.selectExpr(*[f"{extra[c]} as {c}" if c in extra else c for c in TRACK_COLUMNS],
                         "ph", "ck", "e", "i")


def tracks_wide(spark, sf_dir) -> DataFrame:
    """tracks plus the generating columns ph, ck, e, i."""
    return as_tracks(everyone(spark, sf_dir))


def tracks(spark, sf_dir) -> DataFrame:
    return tracks_wide(spark, sf_dir).select(*TRACK_COLUMNS)


def tracks_noisy(spark, sf_dir) -> DataFrame:
    """Dropped rows and 5 m spikes."""
    t = tracks_wide(spark, sf_dir).filter((F.col("ck") + F.col("e")) % 10 != 0)
    return t.withColumn("x", F.col("x") + F.when((F.col("ck") * (F.col("e") + 3)) % 97 == 0, 5.0)
                        .otherwise(0.0)).select(*TRACK_COLUMNS)


def tracks_frag(spark, sf_dir) -> DataFrame:
    """People cut into fragments of 300 frames with a gap of 10."""
    t = as_tracks(people(spark, sf_dir)).filter(F.col("frame_idx") % 300 >= 10)
    return t.withColumn("track_id", F.expr("(e + 1) * 1000 + frame_idx div 300").cast("int"))


def tracks_shots(spark, sf_dir) -> DataFrame:
    """tracks with a replay every 900 frames and a shot id every 1000."""
    return (tracks(spark, sf_dir)
            .withColumn("live_wide", F.col("frame_idx") % 900 >= 50)
            .withColumn("shot", F.expr("frame_idx div 1000").cast("int")))


def pred(spark, sf_dir) -> DataFrame:
    """Predictions against the people as ground truth: shifted, dropped and swapped."""
    t = as_tracks(people(spark, sf_dir)).filter((F.col("ck") + F.col("e")) % 9 != 0)
    swapped = F.when(F.col("team") == HOME, AWAY).otherwise(HOME)
    t = t.withColumn("team", F.when((F.col("ck") + F.col("e")) % 31 == 0, swapped).otherwise(F.col("team")))
    t = t.withColumn("role", F.when((F.col("ck") + F.col("e")) % 13 == 0, "referee").otherwise(F.col("role")))
    t = t.withColumn("x", F.col("x") + (F.col("ck") % 7).cast("double") / 2.0)
    return t.withColumn("bbox_x", F.col("bbox_x") + 4.0 * (F.col("ck") % 7).cast("double"))


def pairs(spark, sf_dir, gate: float) -> DataFrame:
    """Ground truth paired with its own prediction, as far as the gate allows."""
    g = as_tracks(people(spark, sf_dir)).filter((F.col("ck") + F.col("e")) % 9 != 0)
    swapped = F.when(F.col("team") == HOME, AWAY).otherwise(HOME)
    d = (F.col("ck") % 7).cast("double") / 2.0
    return g.filter(d <= gate).select(
        "match_id", "frame_idx", F.col("track_id").alias("gt_track"), F.col("track_id").alias("pred_track"),
        F.col("role").alias("gt_role"),
        F.when((F.col("ck") + F.col("e")) % 13 == 0, "referee").otherwise(F.col("role")).alias("pred_role"),
        F.col("team").alias("gt_team"),
        F.when((F.col("ck") + F.col("e")) % 31 == 0, swapped).otherwise(F.col("team")).alias("pred_team"),
        d.alias("dist"))


def sensor_readings(spark, sf_dir) -> DataFrame:
    """Position readings of the home side, near every second frame and up to 0.08 s off it."""
    p = as_tracks(people(spark, sf_dir)).filter((F.col("e") < 11) & (F.col("frame_idx") % 2 == 0))
    off = (F.col("ck") % 9 - 4).cast("double") / 50.0
    return p.select("match_id", F.round(F.col("frame_idx") / 25.0 + off, 3).alias("ts"),
                    F.col("track_id").alias("tag_id"), F.col("x").alias("x_pitch"), F.col("y").alias("y_pitch"))


def pred_ball(spark, sf_dir) -> DataFrame:
    b = as_tracks(ball(spark, sf_dir)).filter(F.col("ck") % 5 != 0)
    return (b.withColumn("bbox_x", F.col("bbox_x") + 7.0 * (F.col("ck") % 6).cast("double"))
            .withColumn("interpolated", F.col("ck") % 11 == 0))


def ball_candidates(spark, sf_dir) -> DataFrame:
    """The ball plus a still decoy at (20, 5)."""
    conf = 0.3 + (F.col("ck") % 50).cast("double") / 100.0
    real = ball(spark, sf_dir).select("match_id", "frame_idx", F.lit(0).alias("cand"), "x", "y",
                                      "bbox_x", "bbox_y", "bbox_w", "bbox_h", conf.alias("conf"))
    still = frames(spark, sf_dir).select(
        "match_id", "frame_idx", F.lit(1).alias("cand"), F.lit(20.0).alias("x"), F.lit(5.0).alias("y"),
        F.lit(1116.0).alias("bbox_x"), F.lit(566.0).alias("bbox_y"), F.lit(8.0).alias("bbox_w"),
        F.lit(8.0).alias("bbox_h"), (0.3 + (F.col("ck") * 3 % 50).cast("double") / 100.0).alias("conf"))
    return real.unionByName(still)


def signals(spark, sf_dir) -> DataFrame:
    f = frames(spark, sf_dir)
    m = F.col("frame_idx") % 2000
    return f.select(
        "match_id", "frame_idx",
        F.when(F.col("frame_idx") % 900 < 50, 0.2).otherwise(0.8).alias("grass"),
        F.lit(0.1).alias("blob"),
        (m.between(0, 37) | m.between(400, 437)).alias("stinger"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(
            k == F.expr("(frame_idx div 1000) % 16"), 1.0).otherwise(0.0)).alias("hist"),
        F.when(F.col("frame_idx") % 1700 < 5, 0.3).alias("person_h"))


def action_events(spark, sf_dir) -> DataFrame:
    k = F.col("ck") % 6
    label = (F.when(k == 0, "PASS").when(k == 1, "HIGH PASS").when(k == 2, "CROSS")
             .when(k == 3, "PLAYER SUCCESSFUL TACKLE").when(k == 4, "BALL PLAYER BLOCK").otherwise("OTHER"))
    return (frames(spark, sf_dir).filter(F.col("ck") % 5 == 0)
            .select("match_id", "frame_idx", "period", "timestamp", label.alias("label"),
                    (1 + F.col("ck") % 22).alias("player_id")))


def team_sheet(spark, sf_dir) -> DataFrame:
    """One row per match and player, from the frames of the match."""
    m = frames(spark, sf_dir).select("match_id").distinct()
    return m.withColumn("player_id", F.explode(F.sequence(F.lit(1), F.lit(22)))).select(
        "match_id", F.col("player_id").cast("long").alias("player_id"),
        F.when(F.col("player_id") <= 11, HOME).otherwise(AWAY).alias("team"),
        ((F.col("player_id") - 1) % 11 + 1).cast("int").alias("number"))


def possession_gt(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("ph") <= 1, "AWAY").when(F.col("ph") == 5, "BALLOUT").otherwise("HOME")
    return frames(spark, sf_dir).select("match_id", "frame_idx", "period", "timestamp",
                                        status.alias("ball_status"))


def jersey_reads(spark, sf_dir) -> DataFrame:
    p = tracks_frag(spark, sf_dir).filter((F.col("ck") + F.col("e")) % 50 == 0)
    return p.select("match_id", "track_id", "frame_idx",
                    (F.col("i") + F.when(F.col("ck") % 17 == 0, 2).otherwise(1)).cast("int").alias("number"),
                    F.lit(0.8).alias("confidence"))


def matches(spark, sf_dir) -> DataFrame:
    m = frames(spark, sf_dir).groupBy("match_id").agg(F.max("frame_idx").alias("last"))
    return m.select(
        "match_id", F.lit(25.0).alias("fps"), F.lit(105.0).alias("pitch_length"),
        F.lit(68.0).alias("pitch_width"),
        F.when(F.col("match_id").cast("int") % 2 == 0, "fixed_panoramic").otherwise("broadcast")
        .alias("source_type"))


def detections(spark, sf_dir) -> DataFrame:
    """Class-labelled boxes: people and ball with a shifted copy of every third box."""
    t = tracks_wide(spark, sf_dir)
    name = (F.when(F.col("role") == BALL, "ball").when(F.col("e") % 11 == 10, "Referee")
            .when(F.col("e") % 11 == 0, "goalkeeper").when(F.col("e") % 11 == 9, "banner").otherwise("player"))
    base = t.select("match_id", "frame_idx", F.col("e").alias("det"), name.alias("cls_name"),
                    "x", "y", "bbox_x", "bbox_y", "bbox_w", "bbox_h",
                    (((F.col("ck") * (F.col("e") + 5)) % 100).cast("double") / 100.0).alias("conf"), "ck")
    copy = (base.filter((F.col("ck") + F.col("det")) % 3 == 0)
            .withColumn("det", F.col("det") + 100).withColumn("bbox_x", F.col("bbox_x") + 3.0)
            .withColumn("conf", F.greatest(F.col("conf") - 0.05, F.lit(0.0))))
    return base.unionByName(copy).drop("ck")


# ------------------------------------------------------------------------------- DuckDB text

_U = """CASE WHEN i = 0 THEN -50.0::DOUBLE WHEN e < 11 THEN
 CASE ph WHEN 0 THEN -42+7*r WHEN 1 THEN 9+13*r WHEN 2 THEN 5+10*r WHEN 4 THEN -20+15*r ELSE -25+15*r END
 ELSE CASE ph WHEN 0 THEN -20+15*r WHEN 1 THEN -44+7*r WHEN 2 THEN -44+10*r WHEN 4 THEN -42+7*r
 ELSE -25+15*r END END"""
_V = """CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN e < 11 THEN
 CASE ph WHEN 0 THEN c2*4 WHEN 1 THEN c2*3+8 WHEN 2 THEN c2*3+22 ELSE c2*8 END
 ELSE CASE ph WHEN 4 THEN c2*4 ELSE c2*8 END END"""
_TRACK_TAIL = """NULL::DOUBLE AS speed, NULL::DOUBLE AS accel, FALSE AS interpolated, TRUE AS live_wide, 0 AS shot"""
_PLACE = """SELECT *, (CASE WHEN e < 11 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * ({u})
 + ((ck*(e+1)) % 29 - 14)::DOUBLE/100.0::DOUBLE AS px,
 (CASE WHEN e < 11 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * ({v})
 + ((ck*(e+2)) % 29 - 14)::DOUBLE/100.0::DOUBLE AS py
 FROM (SELECT *, e % 11 AS i, (((e % 11) - 1) // 4)::DOUBLE AS r, (2*(((e % 11) - 1) % 4) - 3)::DOUBLE AS c2
 FROM ({src}))"""

SQL: dict[str, str] = {}
SQL["frames"] = """SELECT CAST(o_orderkey // 7500 AS VARCHAR) AS match_id, CAST(o_orderkey % 7500 AS INTEGER) AS frame_idx,
 CAST(1 + (o_orderkey % 7500) // 3750 AS INTEGER) AS period, ((o_orderkey % 7500) % 3750)::DOUBLE/25.0::DOUBLE AS "timestamp",
 CAST(((o_orderkey % 7500) // 250) % 6 AS INTEGER) AS ph, CAST(o_custkey AS BIGINT) AS ck FROM orders"""
SQL["people_raw"] = _PLACE.format(u=_U, v=_V, src="SELECT frames.*, CAST(t.e AS INTEGER) AS e FROM frames, range(22) t(e)")
SQL["people_xy"] = """SELECT *, CASE WHEN period = 2 THEN -px ELSE px END AS x,
 CASE WHEN period = 2 THEN -py ELSE py END AS y FROM people_raw"""
SQL["people"] = """SELECT match_id, frame_idx, period, "timestamp", ph, ck, e, i, e + 1 AS track_id,
 CASE WHEN i = 0 AND frame_idx % 2 = 0 THEN 'goalkeeper' ELSE 'player' END AS role,
 CASE WHEN e < 11 THEN 'home' ELSE 'away' END AS team, (i + 1)::DOUBLE AS jersey,
 960 + 8*x - 10 AS bbox_x, 540 + 6*y - 40 AS bbox_y, 20.0::DOUBLE AS bbox_w, 40.0::DOUBLE AS bbox_h,
 0.3::DOUBLE + ((ck*(e+1)) % 70)::DOUBLE/100.0::DOUBLE AS det_conf, x, y, NULL::DOUBLE AS z FROM people_xy"""
SQL["ball_raw"] = _PLACE.format(u=_U, v=_V, src="""SELECT *, CAST(CASE WHEN ph <= 1 THEN 11 ELSE 0 END
 + CASE WHEN ph = 1 THEN 10 ELSE 9 END AS INTEGER) AS e FROM frames
 WHERE ck % 7 <> 0 AND NOT (frame_idx % 1500 BETWEEN 1300 AND 1399)""")
SQL["ball_xy"] = """SELECT * REPLACE (px + 0.5::DOUBLE AS px, CASE WHEN ph = 5 THEN 40.0::DOUBLE ELSE py END AS py) FROM ball_raw"""
SQL["ball_rows"] = """SELECT match_id, frame_idx, period, "timestamp", ph, ck, 22 AS e, -1 AS i, -1 AS track_id,
 'ball' AS role, 'unknown' AS team, NULL::DOUBLE AS jersey, 960 + 8*x - 4 AS bbox_x, 540 + 6*y - 4 AS bbox_y,
 8.0::DOUBLE AS bbox_w, 8.0::DOUBLE AS bbox_h, 0.3::DOUBLE + (ck % 50)::DOUBLE/100.0::DOUBLE AS det_conf,
 x, y, 0.0::DOUBLE AS z FROM (SELECT *, CASE WHEN period = 2 THEN -px ELSE px END AS x,
 CASE WHEN period = 2 THEN -py ELSE py END AS y FROM ball_xy)"""
SQL["tracks"] = f"""SELECT *, {_TRACK_TAIL} FROM (SELECT * FROM people UNION ALL SELECT * FROM ball_rows)"""
SQL["tracks_noisy"] = """SELECT * REPLACE (x + CASE WHEN (ck*(e+3)) % 97 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS x)
 FROM tracks WHERE (ck + e) % 10 <> 0"""
SQL["tracks_frag"] = """SELECT * REPLACE (CAST((e + 1) * 1000 + frame_idx // 300 AS INTEGER) AS track_id) FROM tracks
 WHERE role <> 'ball' AND frame_idx % 300 >= 10"""
SQL["tracks_shots"] = """SELECT * REPLACE (frame_idx % 900 >= 50 AS live_wide, CAST(frame_idx // 1000 AS INTEGER) AS shot) FROM tracks"""
SQL["gt"] = "SELECT * FROM tracks WHERE role <> 'ball'"
SQL["pred"] = """SELECT * REPLACE (
 CASE WHEN (ck + e) % 31 = 0 THEN CASE WHEN team = 'home' THEN 'away' ELSE 'home' END ELSE team END AS team,
 CASE WHEN (ck + e) % 13 = 0 THEN 'referee' ELSE role END AS role,
 x + (ck % 7)::DOUBLE/2 AS x, bbox_x + 4*(ck % 7) AS bbox_x) FROM gt WHERE (ck + e) % 9 <> 0"""
SQL["pred_ball"] = """SELECT * REPLACE (bbox_x + 7*(ck % 6) AS bbox_x, ck % 11 = 0 AS interpolated)
 FROM tracks WHERE role = 'ball' AND ck % 5 <> 0"""
SQL["ball_candidates"] = """SELECT match_id, frame_idx, 0 AS cand, x, y, bbox_x, bbox_y, bbox_w, bbox_h,
 0.3::DOUBLE + (ck % 50)::DOUBLE/100.0::DOUBLE AS conf FROM ball_rows
 UNION ALL SELECT match_id, frame_idx, 1, 20.0, 5.0, 1116.0, 566.0, 8.0, 8.0,
 0.3::DOUBLE + (ck*3 % 50)::DOUBLE/100.0::DOUBLE FROM frames"""
SQL["signals"] = """SELECT match_id, frame_idx, CASE WHEN frame_idx % 900 < 50 THEN 0.2 ELSE 0.8 END::DOUBLE AS grass,
 0.1::DOUBLE AS blob, (frame_idx % 2000 BETWEEN 0 AND 37 OR frame_idx % 2000 BETWEEN 400 AND 437) AS stinger,
 (frame_idx // 1000) % 16 AS hot, CASE WHEN frame_idx % 1700 < 5 THEN 0.3::DOUBLE END AS person_h FROM frames"""
SQL["action_events"] = """SELECT match_id, frame_idx, period, "timestamp", CASE ck % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'HIGH PASS'
 WHEN 2 THEN 'CROSS' WHEN 3 THEN 'PLAYER SUCCESSFUL TACKLE' WHEN 4 THEN 'BALL PLAYER BLOCK' ELSE 'OTHER' END AS label,
 1 + ck % 22 AS player_id FROM frames WHERE ck % 5 = 0"""
SQL["team_sheet"] = """SELECT match_id, p::BIGINT AS player_id, CASE WHEN p <= 11 THEN 'home' ELSE 'away' END AS team,
 CAST((p - 1) % 11 + 1 AS INTEGER) AS number FROM (SELECT DISTINCT match_id FROM frames), range(1, 23) t(p)"""
SQL["possession_gt"] = """SELECT match_id, frame_idx, period, "timestamp", CASE WHEN ph <= 1 THEN 'AWAY' WHEN ph = 5 THEN 'BALLOUT'
 ELSE 'HOME' END AS ball_status FROM frames"""
SQL["jersey_reads"] = """SELECT match_id, track_id, frame_idx, CAST(i + CASE WHEN ck % 17 = 0 THEN 2 ELSE 1 END AS INTEGER) AS number,
 0.8::DOUBLE AS confidence FROM tracks_frag WHERE (ck + e) % 50 = 0"""
SQL["matches"] = """SELECT match_id, 25.0::DOUBLE AS fps, 105.0::DOUBLE AS pitch_length, 68.0::DOUBLE AS pitch_width,
 CASE WHEN match_id::INT % 2 = 0 THEN 'fixed_panoramic' ELSE 'broadcast' END AS source_type
 FROM (SELECT DISTINCT match_id FROM frames)"""
SQL["detections_base"] = """SELECT match_id, frame_idx, e AS det, CASE WHEN role = 'ball' THEN 'ball' WHEN e % 11 = 10 THEN 'Referee'
 WHEN e % 11 = 0 THEN 'goalkeeper' WHEN e % 11 = 9 THEN 'banner' ELSE 'player' END AS cls_name, x, y, bbox_x, bbox_y, bbox_w, bbox_h,
 ((ck*(e+5)) % 100)::DOUBLE/100.0::DOUBLE AS conf, ck FROM tracks"""
SQL["detections"] = """SELECT * EXCLUDE (ck) FROM (SELECT * FROM detections_base UNION ALL
 SELECT * REPLACE (det + 100 AS det, bbox_x + 3 AS bbox_x, greatest(conf - 0.05::DOUBLE, 0) AS conf) FROM detections_base
 WHERE (ck + det) % 3 = 0)"""

SQL["pairs5"] = """SELECT g.match_id, g.frame_idx, g.track_id AS gt_track, p.track_id AS pred_track, g.role AS gt_role, p.role AS pred_role,
 g.team AS gt_team, p.team AS pred_team, (g.ck % 7)::DOUBLE/2 AS dist FROM gt g JOIN pred p USING (match_id, frame_idx, track_id)
 WHERE (g.ck % 7)::DOUBLE/2 <= 5"""
SQL["pairs2"] = "SELECT * FROM pairs5 WHERE dist <= 2"
SQL["sensor_readings"] = """SELECT match_id, round(frame_idx/25.0::DOUBLE + (ck % 9 - 4)::DOUBLE/50, 3) AS ts, track_id AS tag_id, x AS x_pitch,
 y AS y_pitch FROM gt WHERE e < 11 AND frame_idx % 2 = 0"""
