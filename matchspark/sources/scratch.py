"""Where intermediate files go: the cluster's shared folder, a new temporary one only in local tests."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a new temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_base(spark)}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: for an input that several branches of a plan read."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_match(df: DataFrame) -> DataFrame:
    """Rows dealt by match, for a write into a folder per match: each match lands in a few files, not in one from every task.

    Large matches are split and small ones share a task, as the sizes found at run time ask."""
    return df.hint("rebalance", "match_id")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; for loops only, whose plans would grow without end."""
    sc = df.sparkSession.sparkContext
    base = shared_base(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return df.checkpoint()
