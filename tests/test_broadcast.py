"""Tables of exploded rows, of spread frames and of arrays are never taken for small."""
import pytest
from pyspark.sql import functions as F

from matchspark.operators import calibration as C
from matchspark.operators import possession as P
from matchspark.operators import scoring as S
from matchspark.operators import shape as H
from matchspark.operators import shots as X
from matchspark.plans import catalog, derive, pitch
from matchspark.schema import finite
from conftest import SF


def size(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_people_and_labels_count_as_many_rows(spark):
    frame = size(derive.frames(spark, SF))
    assert size(derive.people(spark, SF).select("x")) > 5 * frame and size(pitch.labels_a(spark, SF).select("u")) > 5 * frame


@pytest.mark.parametrize("name", ["label_pairs", "apply_tps"])
def test_labelled_frames_are_not_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_spread_frames_are_not_broadcast(spark):
    plan = X.stinger_and_replay(derive.signals(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [match_id" in plan and "BroadcastExchange" not in plan.split("SortMergeJoin [match_id")[0]


def test_arrays_go_by_exchange(spark):
    h = spark.range(3).selectExpr("cast(id as string) as match_id", "0 as frame_idx", "array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) as h")
    lab = h.select("match_id", "frame_idx", F.lit("l").alias("landmark"), *[F.lit(1.0).alias(c) for c in ("u", "v", "lx", "ly")])
    e = C.landmark_errors(lab, h)
    assert "Broadcast" not in e._jdf.queryExecution().executedPlan().toString()
    assert [r.err_m for r in e.collect()] == [0.0] * 3


def largest_method(spark, make):
    """Bytes of the largest method generated for a query."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenStringSeq(make()._jdf.queryExecution().executedPlan())
        return max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_filters_on_positions_compile(spark):
    """The JVM does not compile methods of over 8,000 bytes; the places of people once made such methods."""
    t = lambda: derive.people(spark, SF).filter(finite(F.col("x")) & finite(F.col("y"))).select("match_id", "x", "y")
    assert largest_method(spark, t) < 8000


def test_landmark_errors_compile(spark):
    assert largest_method(spark, lambda: C.landmark_errors(pitch.labels_a(spark, SF), pitch.cams(spark, SF))) < 8000


def test_landmark_errors_leave_out_what_is_not_finite(spark):
    h = lambda w: [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, w]
    maps = spark.createDataFrame([("m", 0, h(1.0)), ("m", 1, h(0.0)), ("m", 2, None)], "match_id string, frame_idx int, h array<double>")
    at = [("m", k, n, u, 0.0, 0.0, 0.0) for k in range(3) for n, u in (("a", 3.0), ("b", float("nan")), ("c", float("inf")), ("d", None))]
    lab = spark.createDataFrame(at, "match_id string, frame_idx int, landmark string, u double, v double, lx double, ly double")
    assert [tuple(r) for r in C.landmark_errors(lab, maps).collect()] == [("m", 0, "a", 3.0)]


def test_landmark_benchmark_maps_labels_once(spark):
    """Its plan reads the frames' errors from a file: labels were once mapped three times."""
    got = catalog.QUERIES["landmark_benchmark"](spark, SF)
    assert not any("orders" in f for f in got.inputFiles())


def test_frames_are_exchanged_once(spark):
    """Turning the tracks exchanged all of them by match and period, and then again by frame."""
    n = H.normalise_direction(derive.tracks(spark, SF))
    for df in (P.control_frames(n), H.players_with_ball(n), P.possession_orientation_check(n, derive.possession_gt(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "period" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        assert "SortMergeJoin [match_id" not in plan or "frame_idx" in plan.split("SortMergeJoin [match_id")[1].split("]")[0]


def test_tasks_grow_with_the_frames(spark, monkeypatch):
    assert derive.frames(spark, SF).rdd.getNumPartitions() == 4
    monkeypatch.setattr(derive, "FRAMES_PER_TASK", 100)
    assert derive.frames(spark, SF).rdd.getNumPartitions() == 15


def test_sides_do_not_exchange_the_tracks(spark):
    t = derive.as_tracks(derive.people(spark, SF))
    plan = S.shape_error(t, t, S.team_sides(t))._jdf.queryExecution().executedPlan().toString()
    assert "team" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_moved_people_compile(spark):
    """Finite places named each formula three times: the method was too large for the JVM to compile."""
    from matchspark.operators import matching as M
    from matchspark.plans import accuracy as A
    assert largest_method(spark, lambda: M.match_people(A.gt(spark, SF), A.moved(spark, SF))) < 8000


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (-2.5,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.f for r in df.select(finite(F.col("x")).alias("f")).collect()] == [True, True, False, False, False, False]
