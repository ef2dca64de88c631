"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ("low_blocks_per_match", "team_block", "normalise_direction", "press_distance", "infer_possession", "transitions",
            "detect_sequences", "add_kinematics", "distance_summary", "interpolate_ball", "live_wide_segments",
            "match_people", "candidate_successors", "interval_join_closest", "map_detections", "compute_quality")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from matchspark.plans import catalog
    catalog.QUERIES["ball_view"](spark, sf_dir).count()      # start the session before the clock
    took = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(sf.group(1)) if sf else None}), flush=True)
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
