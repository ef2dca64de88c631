"""The match-state table: one row per tracked object per frame, in pitch metres."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The label sets and column types of the match-state contract.
HOME, AWAY, OFFICIAL, UNKNOWN = "home", "away", "official", "unknown"
TEAMS = (HOME, AWAY)
PLAYER, GOALKEEPER, REFEREE, BALL, OTHER = "player", "goalkeeper", "referee", "ball", "other"
PLAYING = (PLAYER, GOALKEEPER)

TRACK_SCHEMA = T.StructType([
    T.StructField("match_id", T.StringType()),
    T.StructField("frame_idx", T.IntegerType()),
    T.StructField("period", T.ByteType()),
    T.StructField("timestamp", T.FloatType()),
    T.StructField("track_id", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("team", T.StringType()),
    T.StructField("jersey", T.FloatType()),
    T.StructField("bbox_x", T.FloatType()),
    T.StructField("bbox_y", T.FloatType()),
    T.StructField("bbox_w", T.FloatType()),
    T.StructField("bbox_h", T.FloatType()),
    T.StructField("det_conf", T.FloatType()),
    T.StructField("x", T.FloatType()),
    T.StructField("y", T.FloatType()),
    T.StructField("z", T.FloatType()),
    T.StructField("speed", T.FloatType()),
    T.StructField("accel", T.FloatType()),
    T.StructField("interpolated", T.BooleanType()),
    T.StructField("live_wide", T.BooleanType()),
    T.StructField("shot", T.IntegerType()),
])
REQUIRED = ("match_id", "frame_idx", "timestamp", "track_id", "role", "team", "x", "y")
DEFAULTS = {"role": UNKNOWN, "team": UNKNOWN, "interpolated": False, "live_wide": True, "shot": 0}

TEAM_INFO = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("short_name", T.StringType()),
    T.StructField("kit_color", T.ArrayType(T.IntegerType())),
    T.StructField("attacks_positive_x_first_half", T.BooleanType()),
])
MATCH_SCHEMA = T.StructType([
    T.StructField("match_id", T.StringType()),
    T.StructField("fps", T.DoubleType()),
    T.StructField("pitch_length", T.DoubleType()),
    T.StructField("pitch_width", T.DoubleType()),
    T.StructField("home", TEAM_INFO),
    T.StructField("away", TEAM_INFO),
    T.StructField("competition", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
])
FULL_PITCH_SOURCES = ("fixed_panoramic", "tactical_cam")

FPS, PITCH_LENGTH, PITCH_WIDTH = 25.0, 105.0, 68.0


def conform(df: DataFrame) -> DataFrame:
    """Project any table onto TRACK_SCHEMA: unreadable numbers become null, gaps take defaults."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"track table is missing required columns: {missing}")
    cols = []
    for f in TRACK_SCHEMA.fields:
        if f.name not in df.columns:
            c = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        else:
            c = F.col(f.name)
            if isinstance(f.dataType, (T.FloatType, T.IntegerType, T.ByteType)):
                number = c.try_cast("double")
                c = F.when(~F.isnan(number), number).cast(f.dataType)
            else:
                c = c.try_cast(f.dataType.simpleString())
            if f.name in DEFAULTS:
                c = F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(cols)


def empty_match_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRACK_SCHEMA)


def players(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("role").isin(*PLAYING))


def ball(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("role") == BALL)


def frame(tracks: DataFrame, frame_idx: int) -> DataFrame:
    return tracks.filter(F.col("frame_idx") == frame_idx)


def team(tracks: DataFrame, name: str) -> DataFrame:
    return players(tracks).filter(F.col("team") == name)


def is_playing():
    return F.col("role").isin(*PLAYING)


def attacking_sign(team_col="team"):
    """+1 when the team attacks +x once directions are normalised, else -1."""
    return F.when(F.col(team_col) == HOME, F.lit(1)).otherwise(F.lit(-1))


def finite(col):
    """False for null, nan (greater than all numbers) and infinities. Names the column once: its formula may be long, and methods
    of over 8,000 bytes are not compiled."""
    return F.coalesce(F.abs(col) < F.lit(float("inf")), F.lit(False))
