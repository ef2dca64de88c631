"""Analyst marks on sequences, benchmark runs and their scoreboard."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import sequence_id


def score_marks(sequences: DataFrame, marks: DataFrame, missed: DataFrame, by=("match_id",)) -> DataFrame:
    """Per label: counted, marked, right, wrong, unsure, missed, precision. Stale marks are ignored."""
    by = list(by)
    s = sequences.withColumn("sequence_id", sequence_id()).join(
        marks.select("match_id", "sequence_id", "verdict"), ["match_id", "sequence_id"], "left")
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    g = s.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("marked"),
                                    n("right"), n("wrong"), n("unsure"))
    m = missed.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("missed"))
    out = g.join(m, by + ["label"], "full").fillna(0, ["n", "marked", "right", "wrong", "unsure", "missed"])
    return out.withColumn("precision", F.col("right") / F.nullif(F.col("right") + F.col("wrong"), F.lit(0)))


def evaluate_check(tasks: DataFrame) -> DataFrame:
    """Adds value, delta and passed for tasks with a check: a minimum, or an expected value and tolerance.

    `aggregate` is a map of metric -> value."""
    value = F.try_element_at("aggregate", F.col("check_metric"))
    delta = F.when(F.col("check_min").isNull(), value - F.col("check_expected"))
    ok = F.when(F.col("check_min").isNotNull(), value >= F.col("check_min")).otherwise(F.abs(delta) <= F.col("check_tolerance"))
    return (tasks.withColumn("value", value).withColumn("delta", F.round(delta, 3))
            .withColumn("passed", F.when(F.col("check_metric").isNotNull(), F.coalesce(ok, F.lit(False)))))


def run_status(tasks: DataFrame) -> DataFrame:
    g = tasks.groupBy("run_id").agg(F.bool_and(F.col("status") == "complete").alias("c"),
                                    F.bool_and(F.col("status") == "failed").alias("f"))
    return g.select("run_id", F.when(F.col("c"), "complete").when(F.col("f"), "failed").otherwise("partial").alias("run_status"))


def noise(tasks: DataFrame) -> DataFrame:
    """Absolute difference of every shared metric between a task and the one it repeats, both complete."""
    done = tasks.filter(F.col("status") == "complete")
    a = done.filter(F.col("noise_of").isNotNull()).select(
        "run_id", "task_id", "noise_of", F.explode("aggregate").alias("metric", "va"))
    b = done.select("run_id", F.col("task_id").alias("noise_of"), F.explode("aggregate").alias("metric", "vb"))
    return a.join(b, ["run_id", "noise_of", "metric"]).select(
        "run_id", "task_id", "metric", F.round(F.abs(F.col("va") - F.col("vb")), 4).alias("noise"))


# The metric a task kind shows when its suite names none.
PRIMARY = {"gsr_pipeline": "hota_jersey_off", "gsr_gt_roundtrip": "hota_jersey_off", "gsr_rescore": "hota_jersey_on",
           "sncalib": "score", "gsr_calibration": "score"}


def headline_metric():
    by_kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PRIMARY.items()])
    return F.coalesce("check_metric", by_kind, F.try_element_at(F.map_keys("aggregate"), F.lit(1)))


def scoreboard(tasks: DataFrame, history: int) -> DataFrame:
    """The newest runs of each suite with one headline cell per task (a long table to pivot or print)."""
    runs = tasks.select("suite", "run_id", "finished_at").distinct()
    w = Window.partitionBy("suite").orderBy(F.desc("finished_at"), "run_id")
    newest = runs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= history).select("suite", "run_id", "k")
    t = tasks.join(newest, ["suite", "run_id"]).withColumn("metric", F.when(F.col("status") == "failed", "error").otherwise(headline_metric()))
    value = F.when(F.col("status") != "failed", F.try_element_at("aggregate", F.col("metric")))
    t = t.withColumn("value", value)
    mark = F.when(F.col("passed"), " ✓").when(~F.col("passed"), " ✗").otherwise("")
    cell = F.when(F.col("value").isNull(), F.col("metric")).otherwise(
        F.concat("metric", F.lit(" "), F.format_string("%.2f", "value"), F.when(F.col("passed").isNull(), "").otherwise(mark)))
    return t.select("suite", "k", "run_id", "finished_at", "task_id", "metric", "value", cell.alias("cell"))


def scoreboard_pivot(board: DataFrame, tasks: list[str]) -> DataFrame:
    return board.groupBy("suite", "k", "run_id").pivot("task_id", tasks).agg(F.first("cell"))


def leakage_subset(frames: DataFrame, listed: DataFrame) -> DataFrame:
    """Frames whose game (league|season|match|date) is not listed."""
    key = F.concat_ws("|", *[F.trim(F.coalesce(c, F.lit(""))) for c in ("league", "season", "match", "date")])
    return frames.withColumn("game", key).join(listed.select("game"), "game", "left_anti")
