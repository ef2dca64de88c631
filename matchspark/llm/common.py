"""What the operators of this subpackage share: tables, shared files, running totals that split hot keys."""
from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.plans.registry import ship_package

WORDS = r"[^\x20\x09-\x0D]+"      # a word: a run of anything but ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken) for name in names]


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A null-safe join that keeps the left side's keys once."""
    renamed = right.select([F.col(c).alias(f"__{c}" if c in keys else c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys))
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"__{k}" for k in keys))


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before, in the order (chunk, order) within the keys; and `nth` in the chunk.

    Rows are windowed in (keys, chunk) only, so a hot key is spread over its chunks; one total a chunk carries the sum across.
    """
    by = [F.col(k) for k in keys]
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, chunk, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*by, chunk).orderBy(*order)
    inner = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("__inner", inner).withColumn("nth", F.row_number().over(w))
    joined = join_on(rows, base, [*keys, chunk])
    return joined.withColumn(out, F.col("__inner") + F.col("__base")).drop("__inner", "__base")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; none for null."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text divisible by 5; a null id counts as empty text."""
    return (crc32_of(doc_id) % 5) == 0


def bound(array: Column, use) -> Column:
    """use(array), with the array computed once: as a lambda's variable. Named inside a lambda as it stands, Spark would compute it for every element."""
    return F.transform(F.array(array), use)[0]


def prefix_sums(lengths: Column) -> Column:
    """For each element of an array of numbers, the sum of those before it; blocks of about the root of their number keep it to n * sqrt(n) steps."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(values: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
        return bound(size, lambda block: bound(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int")), lambda b: total(F.slice(values, b * block + 1, block))),
            lambda blocks: F.transform(values, lambda _, i: total(F.slice(blocks, F.lit(1), F.floor(i / block).cast("int")))
                                       + total(F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block)))))
    return bound(lengths, summed)
