"""Schema rules, file formats, and a handful of registered queries against their SQL."""
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, compare
from conftest import SF
from matchspark.functions.geometry import landmark_terms
from matchspark.schema import TRACK_SCHEMA, conform, empty_match_state
from matchspark.sources import documents as X
from matchspark.sources import feeds as S
from matchspark.sources import game_state as G


def test_conform(spark):
    df = spark.createDataFrame([("m", "3", "x", 1, None, None, "nan", "2.5")],
                               "match_id string, frame_idx string, timestamp string, track_id int, role string, team string, x string, y string")
    r = conform(df).first()
    assert (r.frame_idx, r.timestamp, r.role, r.team, r.x, r.y, r.live_wide, r.interpolated, r.shot) == (3, None, "unknown", "unknown", None, 2.5, True, False, 0)
    kinds = [(f.name, f.dataType) for f in TRACK_SCHEMA.fields]
    assert [(f.name, f.dataType) for f in conform(df).schema.fields] == kinds
    assert empty_match_state(spark).schema == TRACK_SCHEMA and empty_match_state(spark).count() == 0
    with pytest.raises(ValueError, match="team"):
        conform(df.drop("team"))


def test_landmarks():
    names = [n for n, *_ in landmark_terms()]
    assert len(names) == len(set(names)) == 35


def test_game_state_version_is_refused(spark, tmp_path):
    doc = {"info": {"name": "S-1", "version": "1.10"}, "images": [{"image_id": "1", "file_name": "000001.jpg"}],
           "annotations": [{"image_id": "1", "supercategory": "object", "track_id": 4, "bbox_pitch": {"x_bottom_middle": 1.0, "y_bottom_middle": 2.0},
                            "attributes": {"role": "referee", "team": "left"}}]}
    (tmp_path / "ok.json").write_text(json.dumps(doc, indent=1))
    r = G.read_game_state_labels(spark, str(tmp_path / "ok.json")).first()
    assert (r.match_id, r.frame_idx, r.team, r.x) == ("S-1", 0, "official", 1.0)
    doc["info"]["version"] = "1.2"
    (tmp_path / "old.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="older than 1.3"):
        G.read_game_state_labels(spark, str(tmp_path / "old.json")).collect()


def test_feeds_read_plain_files(spark, tmp_path):
    (tmp_path / "m1.xml").write_text('<t><frame frameNumber="0" matchTime="40" eventPeriod="SECOND_HALF" ballStatus="HOME">'
                                     '<player playerId="7" loc="[0.5,0.5]" speed="1"/><player loc="[0,0]"/><ball playerId="ball" loc="[1,0]"/></frame></t>')
    rows, poss, skipped = S.read_tracker_xml(spark, str(tmp_path / "m1.xml"))
    got = {r.track_id: (r.match_id, r.frame_idx, r.period, r.x, r.y) for r in rows.collect()}
    assert got == {7: ("m1", 1, 2, 0.0, 0.0), -1: ("m1", 1, 2, 52.5, -38.0)}
    assert poss.first().ball_status == "HOME" and skipped.first().skipped == 1
    (tmp_path / "e1.json").write_text(json.dumps({"actions": [{"position": "1000", "label": "PASS", "team": "left", "player_id": 7},
                                                              {"position": "x", "label": "CROSS", "team": "left", "player_id": None}]}))
    e = sorted(S.read_events(spark, str(tmp_path / "e1.json")).collect(), key=lambda r: r.label)
    assert e[1].frame_idx == 25 and e[1].period == 1 and e[1].player_id == 7 and e[0].timestamp is None


def test_bad_labels_and_missing_combined_row_fail(spark, tmp_path):
    man = {"version": 1, "matches": {"a": {"frames": {"5": {"split": "dev", "relabel": False}}}}}
    lab = {"version": 1, "annotator": "A", "session": 1, "image_size": [1920, 1080], "frames": {"a/0000005": {"centre_spot": [10, 20], "nowhere": [1, 2]}}}
    (tmp_path / "man.json").write_text(json.dumps(man))
    (tmp_path / "lab.json").write_text(json.dumps(lab, indent=1))
    out = X.read_landmark_labels(spark, str(tmp_path / "lab.json"), X.read_manifest(spark, str(tmp_path / "man.json")))
    assert {r.landmark: r.problem for r in out.collect()} == {"centre_spot": None, "nowhere": "unknown landmark"}
    with pytest.raises(Exception, match="unknown landmark"):
        X.good_labels(out).collect()
    (tmp_path / "s.csv").write_text("seq,HOTA___AUC,DetA___AUC,AssA___AUC,LocA___AUC,IDF1,Dets,GT_Dets\nc1,0.5,0.4,0.6,0.7,0.5,10.0,12\n")
    clips, combined = X.read_tracking_scores(spark, str(tmp_path / "s.csv"))
    assert clips.first().hota == 50.0
    with pytest.raises(Exception, match="no COMBINED row"):
        combined.collect()


SAMPLE = ["low_blocks_per_match", "team_block", "formation_over_time", "infer_possession", "detect_sequences", "live_wide_segments",
          "candidate_successors", "read_landmark_labels", "interpolate_ball", "team_counts"]


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok" and len(got)


@pytest.mark.parametrize("name", ["infer_possession", "live_wide_segments", "add_kinematics"])
def test_results_do_not_depend_on_group_size(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    spark.conf.set("spark.matchspark.chunkRows", "200")
    try:
        got = entry.queries()[name](spark, SF).toPandas()
    finally:
        spark.conf.unset("spark.matchspark.chunkRows")
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"
