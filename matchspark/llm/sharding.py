"""Jump consistent hashing: stable keys to shards without a ring table."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, saved

MULTIPLIER, CHUNKS = np.uint64(2862933555777941757), 1024     # the multiplier is the published one, a fixed value


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key (Lamping and Veach 2014), all keys at once; about ln(shards) rounds."""
    key = keys.astype(np.uint64, copy=True)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.flatnonzero(ahead < shards)
    while len(live):
        at[live] = ahead[live]
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / step)).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def assign(docs: DataFrame, keys: list[str], shards: int, out: str = "shard") -> DataFrame:
    """Adds the shard (0 to shards-1) of each row, decided by the key columns and the shard count alone. No shuffle.

    A null key is a key like any other; equal keys share a shard; a column named `out` is replaced; an empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy().astype(np.int64).view(np.uint64), shards))
    return docs.withColumn(out, place(F.xxhash64(*(F.col(k) for k in keys))))


def numbered(rows: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard.

    Equal rows are first counted together, so that repeats of one key never gather in a task; a shard's numbers run over
    1024 hash chunks. Rows should be digests, not texts: they are written once to the shared folder.
    """
    cols = rows.columns
    counted = saved(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
                    .withColumn("__chunk", F.pmod(F.xxhash64(*cols), F.lit(CHUNKS))))
    placed = running_total(counted, [shard], "__chunk", cols, "__n", "__from")
    return placed.select(*cols, F.explode(F.sequence("__from", F.col("__from") + F.col("__n") - 1)).alias(out))


def write_shards(docs: DataFrame, keys: list[str], shards: int, path: str, files_per_shard: int = 1) -> None:
    """Whole rows as Parquet, one folder per shard; a shard's rows are dealt over `files_per_shard` tasks."""
    placed = assign(docs, keys, shards)
    salt = F.pmod(F.xxhash64(*docs.columns), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
