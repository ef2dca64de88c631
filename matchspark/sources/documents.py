"""Calibration, landmark-label, review-mark and evaluator documents; run rows and report tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import landmark_terms
from ..operators.quality import quality_markdown
from .feeds import match_of_path
from .scratch import by_match

CALIBRATION = ("H array<array<double>>, image_size array<int>, named_points map<string,array<double>>, "
               "use_tps boolean, notes string")


def read_calibration(spark: SparkSession, path: str, suffix: str = r"\.json", lines: bool = False) -> DataFrame:
    d = spark.read.schema(CALIBRATION).option("multiLine", not lines).json(path).withColumn("match_id", match_of_path(suffix))
    return d.select("match_id", F.flatten("H").alias("h"), "image_size", "named_points",
                    F.coalesce("use_tps", F.lit(False)).alias("use_tps"), F.coalesce("notes", F.lit("")).alias("notes"))


def write_calibration(calibrations: DataFrame, path: str) -> None:
    """One document per row, as JSON lines under match_id=..."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.slice("h", i * 3 + 1, 3))
    by_match(calibrations.select("match_id", rows.alias("H"), "image_size", "named_points", "use_tps", "notes")).write.mode(
        "overwrite").partitionBy("match_id").json(path)


def calibration_points(calibrations: DataFrame) -> DataFrame:
    """The named points of each calibration as rows, for refitting and for the verdict."""
    return calibrations.select("match_id", F.lit(0).alias("frame_idx"), F.explode("named_points").alias("landmark", "_p")).select(
        "match_id", "frame_idx", "landmark", F.get("_p", F.lit(0)).alias("u"), F.get("_p", F.lit(1)).alias("v"))


LABELS = ("version int, annotator string, session int, image_size array<int>, "
          "frames map<string,map<string,array<double>>>")
MANIFEST = "version int, matches map<string,struct<frames:map<string,struct<split:string,relabel:boolean>>>>"
SIZE, COORD_LIMIT, LABELS_VERSION = (1920, 1080), 10_000, 1


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    d = spark.read.schema(MANIFEST).option("multiLine", not lines).json(path)
    d = d.select(F.explode("matches").alias("match_id", "m")).select("match_id", F.explode("m.frames").alias("f", "meta"))
    return d.select("match_id", F.col("f").cast("int").alias("frame_idx"), "meta.split", "meta.relabel")


def read_landmark_labels(spark: SparkSession, path: str, manifest: DataFrame, lines: bool = False) -> DataFrame:
    """Long labels with split and relabel, and `problem`: null for a good row, else what is wrong."""
    d = spark.read.schema(LABELS).option("multiLine", not lines).json(path)
    doc = (F.when(F.coalesce(F.col("version"), F.lit(-1)) != LABELS_VERSION, "version")
           .when(~F.coalesce(F.col("image_size") == F.array(*[F.lit(v) for v in SIZE]), F.lit(False)), "image size"))
    d = d.select("annotator", "session", doc.alias("_doc"), F.explode("frames").alias("key", "pts"))
    d = d.select("*", F.explode("pts").alias("landmark", "uv"))
    d = d.select("annotator", "session", "_doc", "landmark", F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("match_id"),
                 F.regexp_extract("key", "([0-9]+)$", 1).cast("int").alias("frame_idx"), F.size("uv").alias("_n"),
                 F.get("uv", F.lit(0)).alias("u"), F.get("uv", F.lit(1)).alias("v"))
    j = d.join(manifest, ["match_id", "frame_idx"], "left")
    big = F.greatest(F.abs("u"), F.abs("v")) > COORD_LIMIT
    outside = ~(F.col("u").between(0, SIZE[0]) & F.col("v").between(0, SIZE[1]))
    names = [n for n, *_ in landmark_terms()]
    problem = (F.when(F.col("_doc").isNotNull(), F.col("_doc")).when(F.col("split").isNull(), "unknown frame")
               .when(~F.col("landmark").isin(*names), "unknown landmark")
               .when((F.coalesce("_n", F.lit(0)) != 2) | F.col("u").isNull() | F.col("v").isNull(), "not a point")
               .when(F.isnan("u") | F.isnan("v") | big, "not finite").when(outside, "outside the image"))
    return j.select("annotator", "session", "match_id", "frame_idx", "landmark", "u", "v", "split", "relabel",
                    problem.alias("problem"))


def good_labels(labels: DataFrame) -> DataFrame:
    """The rows, failing the job on the first bad one."""
    text = F.concat_ws(" ", F.lit("bad label:"), "match_id", F.col("frame_idx").cast("string"), "landmark", "problem")
    return labels.withColumn("landmark", F.when(F.col("problem").isNull(), F.col("landmark")).otherwise(
        F.raise_error(text))).drop("problem")


MARKS = ("version int, reviewer string, video string, video_offset_s double, "
         "sequences map<string,struct<verdict:string,note:string>>, "
         "missed array<struct<label:string,team:string,start_s:double,end_s:double,note:string>>")


def read_marks(spark: SparkSession, path: str, suffix: str = r"\.json", lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequence marks, missed entries, problems) of review documents; teams are lower-cased on read."""
    d = spark.read.schema(MARKS).option("multiLine", not lines).json(path).withColumn("match_id", match_of_path(suffix))
    bad = (F.when(F.coalesce(F.col("version"), F.lit(-1)) != 1, "version")
           .when(F.col("reviewer").isNull() | F.col("video").isNull(), "no reviewer or video")
           .when(F.col("video_offset_s").isNull() | F.isnan("video_offset_s"), "no video offset")
           .when(F.col("sequences").isNull() | F.col("missed").isNull(), "no list of marks"))
    docs = d.withColumn("_bad", bad)
    seq = docs.filter("_bad is null").select("match_id", F.explode("sequences").alias("sequence_id", "m")).select(
        "match_id", "sequence_id", "m.verdict", "m.note")
    seq = seq.withColumn("problem", F.when(~F.coalesce(F.col("verdict").isin("right", "wrong", "unsure"), F.lit(False)), "verdict")
                         .when(F.col("note").isNull(), "note"))
    mis = docs.filter("_bad is null").select("match_id", F.explode("missed").alias("m")).select("match_id", "m.*")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    mis = mis.withColumn("problem", F.when(F.coalesce(F.col("label"), F.lit("")) == "", "label")
                         .when(~F.coalesce(F.col("team").isin("HOME", "AWAY"), F.lit(False)), "team")
                         .when(~(finite("start_s") & finite("end_s")), "times")
                         .when(F.col("end_s") <= F.col("start_s"), "empty span")).withColumn("team", F.lower("team"))
    problems = (docs.filter("_bad is not null").select("match_id", F.col("_bad").alias("problem"))
                .unionByName(seq.filter("problem is not null").select("match_id", "problem"))
                .unionByName(mis.filter("problem is not null").select("match_id", "problem")))
    return seq.filter("problem is null").drop("problem"), mis.filter("problem is null").drop("problem"), problems


# ------------------------------------------------------------------ evaluator output

# Columns and phrases of the evaluators' output.
PERCENT = {"hota": "HOTA___AUC", "deta": "DetA___AUC", "assa": "AssA___AUC", "loca": "LocA___AUC", "idf1": "IDF1"}
COUNT = {"dets": "Dets", "gt_dets": "GT_Dets"}
PHRASES = {"score": r"final score of : (\S+)", "completeness": r"completeness rate of : (\S+)",
           "jac": r"accuracy mean value :\s+(\S+)%", "precision": r"precision mean value : (\S+)%",
           "recall": r"recall mean value : (\S+)%"}


def read_tracking_scores(spark: SparkSession, path: str, suffix: str = r"\.csv") -> tuple[DataFrame, DataFrame]:
    """(per clip, combined) scores in percent; a file without its COMBINED row fails the read."""
    d = spark.read.option("header", True).csv(path).withColumn("run_id", match_of_path(suffix))
    d = d.select("run_id", "seq", *[F.round(100 * F.col(c).cast("double"), 3).alias(k) for k, c in PERCENT.items()],
                 *[F.col(c).cast("double").cast("long").alias(k) for k, c in COUNT.items()])
    whole = d.groupBy("run_id").agg(F.min(F.when(F.col("seq") == "COMBINED", F.struct(*PERCENT, *COUNT))).alias("c"))
    run = F.when(F.col("c").isNotNull(), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("no COMBINED row: "), "run_id")))
    return d.filter("seq <> 'COMBINED'"), whole.select(run.alias("run_id"), "c.*")


def parse_calibration_scores(texts: DataFrame) -> DataFrame:
    """Five numbers from the evaluator's text (column `value`, one whole text per row); nothing found is 0."""
    cols = []
    for k, pat in PHRASES.items():
        v = F.regexp_extract("value", pat, 1).try_cast("double")
        v = v * 100 if k in ("score", "completeness") else v
        cols.append(F.round(F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), 3).alias(k))
    return texts.select("run_id", *cols)


def read_calibration_scores(spark: SparkSession, path: str, suffix: str = r"\.log") -> DataFrame:
    return parse_calibration_scores(spark.read.option("wholetext", True).text(path).withColumn("run_id", match_of_path(suffix)))


# ------------------------------------------------------------------ sinks

def write_report_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each named table as CSV with a header and as Parquet; a table is computed once."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        saved = df.sparkSession.read.parquet(f"{path}/{name}.parquet")
        saved.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")


def append_results(rows: DataFrame, path: str) -> DataFrame:
    """Append run rows, a folder per run_id; returns the rows written.

    A run appended again replaces its own folder and touches no other, so repeats and retries leave one copy and the
    history is never read. Of rows that share a run_id within one append, one stays; rows without a run_id fail the job."""
    key = F.when(F.col("run_id").isNull(), F.raise_error(F.lit("run without run_id"))).otherwise(F.col("run_id"))
    once = rows.withColumn("run_id", key).dropDuplicates(["run_id"])
    once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)
    return once


def write_quality(quality: DataFrame, path: str) -> None:
    """quality as JSON lines and as Markdown bullets per match."""
    quality.write.mode("overwrite").json(f"{path}/quality")
    md = quality_markdown(quality).groupBy("match_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("value"))
    text = F.concat(F.lit("# Quality report\n\n"), "value")
    md.select("match_id", text.alias("value")).write.mode("overwrite").partitionBy("match_id").text(f"{path}/quality_md")
