"""Keyed-order helpers and percentiles: chunked results equal plain ones and pandas."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchspark.functions.ordered import Ordered, lag, last_value, lead, next_value, running_max, running_sum
from matchspark.functions.quantiles import exact_percentiles


def _table(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in (("a", 300), ("b", 3), ("c", 1), ("d", 60)):
        f = np.sort(rng.choice(900, n, replace=False))
        for i in f:
            rows.append((k, int(i), float(rng.integers(0, 9)), None if rng.random() < 0.6 else float(rng.integers(0, 5))))
    return pd.DataFrame(rows, columns=["k", "f", "v", "s"])


def test_scans_match_pandas(spark, mode):
    t = _table()
    df = spark.createDataFrame(t.astype({"s": object}).where(t.notna(), None), "k string, f int, v double, s double")
    o = Ordered(df, ["k"], ["f"])
    got = (o.add(rs=running_sum(F.col("v")), rm=running_max(F.col("v"), strict=True), lg=lag(F.col("s")), ld=lead(F.col("v")))
           .add(lv=last_value(F.col("s")), lvs=last_value(F.col("s"), strict=True), nv=next_value(F.col("s")), nvs=next_value(F.col("s"), strict=True))
           .done().toPandas().sort_values(["k", "f"]).reset_index(drop=True))
    t = t.sort_values(["k", "f"]).reset_index(drop=True)
    g = t.groupby("k")
    want = {"rs": g["v"].cumsum(), "rm": g["v"].transform(lambda s: s.cummax().shift()), "lg": g["s"].shift(), "ld": g["v"].shift(-1),
            "lv": g["s"].ffill(), "lvs": g["s"].transform(lambda s: s.ffill().shift()), "nv": g["s"].bfill(),
            "nvs": g["s"].transform(lambda s: s.bfill().shift(-1))}
    for name, w in want.items():
        np.testing.assert_array_equal(got[name].to_numpy(float), w.to_numpy(float), err_msg=name)


def test_percentiles_exact(spark, mode):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 2000, p=[.9, .09, .01]), "x": np.round(rng.normal(0, 3, 2000), 3)})
    shares = {"lo": 0.005, "mid": 0.5, "hi": 0.9}
    df = spark.createDataFrame(t)
    got = exact_percentiles(df, ["k"], "x", shares).toPandas().set_index("k")
    for k, g in t.groupby("k"):
        for n, s in shares.items():
            assert abs(got.loc[k, n] - np.quantile(g["x"], s)) < 1e-9
    whole = exact_percentiles(df, [], "x", shares).toPandas().iloc[0]
    assert abs(whole["hi"] - np.quantile(t["x"], 0.9)) < 1e-9


def test_building_runs_no_job(spark):
    """Columns and percentiles are added without looking at the data."""
    df = spark.createDataFrame(_table(), "k string, f int, v double, s double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    exact_percentiles(Ordered(df, ["k"], ["f"]).add(rs=running_sum(F.col("v"))).done(), ["k"], "rs", {"mid": 0.5})
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")
