"""Match-state tables on disk: partitioned Parquet for rows, JSON for match metadata."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MATCH_SCHEMA, TRACK_SCHEMA, conform


def write_match_state(tracks: DataFrame, matches: DataFrame, path: str) -> None:
    """tracks/match_id=... sorted by frame so row groups can be skipped; matches as JSON lines.

    Rows are dealt by (match, frame range), so one long match is written by many tasks."""
    t = conform(tracks).withColumn("_r", F.expr("frame_idx div 16384"))
    t = t.repartition("match_id", "_r").sortWithinPartitions("match_id", "frame_idx", "track_id").drop("_r")
    t.write.mode("overwrite").partitionBy("match_id").parquet(f"{path}/tracks")
    known = {f.name: f for f in MATCH_SCHEMA.fields}
    matches.select([F.col(c).cast(f.dataType) if c in matches.columns else F.lit(None).cast(f.dataType).alias(c)
                    for c, f in known.items()]).write.mode("overwrite").json(f"{path}/matches")


def read_match_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    fields = [f for f in TRACK_SCHEMA.fields if f.name != "match_id"] + [TRACK_SCHEMA["match_id"]]
    tracks = spark.read.schema(T.StructType(fields)).parquet(f"{path}/tracks")
    matches = spark.read.schema(MATCH_SCHEMA).json(f"{path}/matches")
    from ..schema import FULL_PITCH_SOURCES
    return conform(tracks), matches.withColumn("full_pitch_visible", F.col("source_type").isin(*FULL_PITCH_SOURCES))
