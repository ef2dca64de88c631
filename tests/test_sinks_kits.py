"""Idempotent append and pooled kits on small cases."""
import numpy as np
import pytest

from matchspark.operators import teams as M
from matchspark.sources import documents as X


def test_append_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "runs")
    make = lambda *rows: spark.createDataFrame(rows, "run_id string, suite string, score double")
    read = lambda: sorted(map(tuple, spark.read.schema("run_id string, suite string, score double").json(path).select("run_id", "suite", "score").collect()))
    X.append_results(make(("a/1", "s", 1.0), ("b 2", "s", 2.0), ("b 2", "s", 2.0)), path)
    first = read()
    assert first == [("a/1", "s", 1.0), ("b 2", "s", 2.0)]
    X.append_results(make(("a/1", "s", 1.0), ("c", "t", 3.0)), path)
    X.append_results(make(("c", "t", 3.0)), path)
    assert read() == first + [("c", "t", 3.0)]
    X.append_results(make(("c", "t", 3.0)).limit(0), path)
    assert len(read()) == 3
    with pytest.raises(Exception, match="run without run_id"):
        X.append_results(make((None, "t", 3.0)), path)


def test_pooled_kits_equal_group_means(spark):
    rng = np.random.default_rng(5)
    rows, by = [], {0: [], 1: []}
    for t in range(12):
        kit = t % 2
        for f in range(10):
            d = [float(v) for v in np.r_[np.eye(2)[kit], 0.0] + rng.uniform(0, 0.1, 3)]
            by[kit].append(d)
            rows.append((f"m{t % 3}", t, f, d))
        rows.append((f"m{t % 3}", t, 99, [0.0, 0.0, 0.0]))
    rows.append(("blank", 50, 0, [0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "match_id string, track_id int, frame_idx int, descriptor array<double>")
    kits = M.pooled_kits(df)
    want = sorted((np.mean(v, axis=0) for v in by.values()), key=lambda c: c.tolist())
    assert all(np.allclose(c, w) and m == 60 for (c, m), w in zip(kits, want))
    c = {r.match_id: r for r in M.pooled_kit_clusters(df).collect()}
    assert set(c) == {"m0", "m1", "m2", "blank"} and all(abs(r.balance - 1) < 1e-12 and r.c0 == c["m0"].c0 for r in c.values())
    assert M.pooled_kits(df.filter("match_id = 'blank'")) == [] and M.pooled_kit_clusters(df.limit(0)).count() == 0


def test_match_files_are_few_and_found_by_path(spark, tmp_path):
    from matchspark.sources.feeds import read_mot
    from matchspark.sources.scratch import by_match
    rows = spark.range(0, 400, 1, 8).selectExpr("cast(id % 4 as string) as match_id", "cast(id as int) as frame", "1 as track_id", "1D as x", "2D as y",
                                                "3D as w", "4D as h", "1D as conf", "1D as cls", "1D as vis", "1D as extra")
    by_match(rows).write.partitionBy("match_id").csv(f"{tmp_path}/a=b/mot")
    assert len(list(tmp_path.glob("a=b/mot/match_id=*/part-*.csv"))) == 4
    back = read_mot(spark, f"{tmp_path}/a=b/mot", suffix=r"/part-[^/]*")
    assert {(r.match_id, r["count"]) for r in back.groupBy("match_id").count().collect()} == {(str(k), 100) for k in range(4)}
    rows.filter("match_id = '2'").drop("match_id").coalesce(1).write.csv(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("part-*.csv"))
    (tmp_path / "m-7.csv").write_bytes(part.read_bytes())
    assert {r.match_id for r in read_mot(spark, f"{tmp_path}/m-7.csv").select("match_id").collect()} == {"m-7"}


def test_only_the_end_of_a_path_is_searched_for_its_match():
    """A slash that the suffix rules out was counted as a folder: the pattern then started at every letter of the folder above."""
    from matchspark.plans.files import PART
    from matchspark.sources.feeds import match_of_path
    assert "-2)" in str(match_of_path(PART)).replace(" ", "").replace("/,", ",") and "-1)" in str(match_of_path(r"\.csv")).replace(" ", "")


def test_calibrations_are_dealt_by_match_for_the_write(spark, tmp_path):
    """Each task wrote a file for every match."""
    from matchspark.sources.documents import write_calibration
    h = "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) as h"
    c = spark.range(40).repartition(8).selectExpr("cast(id % 3 as string) as match_id", h, "array(1920, 1080) as image_size",
        "map('a', array(1D, 2D)) as named_points", "false as use_tps", "'' as notes")
    write_calibration(c, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").rglob("*.json"))) == 3
