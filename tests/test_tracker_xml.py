"""Tracker XML: plain frames are read by columns, all others by a parser; both see the same rows."""
from xml.etree import ElementTree as ET

import pyarrow as pa
from conftest import SF

from matchspark.functions.xml_frames import RECORDS, parsed_frame, plain_frames, read_frames, read_objects
from matchspark.plans import files
from matchspark.sources import feeds as S


def records(text, match="m"):
    parts = text.split("<frame")
    return pa.RecordBatch.from_arrays([pa.array([match] * len(parts)), pa.array(parts)], ["match_id", "value"])


def seen(text):
    frames = [f["ms"] for b in read_frames([records(text)]) for f in b.to_pylist()]
    return frames, sorted((o["ms"], str(o["number"] or o["id"] or ""), o["x"], o["loc"]) for b in read_objects([records(text)]) for o in b.to_pylist())


PLAIN = ('<t>\n<frame matchTime="40" ballStatus="HOME">\n\t<player playerId="7" loc="[0.5,0.25]" speed="1"/>\n\t<player loc="[0,1]" playerId="none"/>'
         '<ball playerId="ball" loc="[1,x]"/>\n</frame>\n<frame matchTime="80" other="a>b"></frame></t>')


def test_plain_frames_equal_the_parser():
    texts = PLAIN.split("<frame")[1:]
    ok, frames, of, objects = plain_frames(pa.array(texts))
    assert ok.all() and of.tolist() == [0, 0, 0]
    for i, t in enumerate(texts):
        *attrs, found = parsed_frame(t)
        assert [c[i].as_py() for c in frames] == attrs
        mine = [[c[j].as_py() for c in objects] for j in range(len(of)) if of[j] == i]
        assert [[m[0], m[2] if m[1] is None else str(m[1]), m[3]] for m in mine] == [[f["ball"], f["id"], f["speed"]] for f in found]
    assert [c.to_pylist() for c in objects[4:]] == [[0.5, 0.0, 1.0], [0.25, 1.0, None], [None, None, "[1,x]"]]


def test_other_xml_goes_to_the_parser():
    single = seen("<frames n='2'><frame matchTime='40'><bench><player playerId='9' loc='[0,0]'/></bench><player loc='[0,1]' playerId='3'></player></frame ><frame matchTime='80'/></frames>")
    assert single == (["40", "80"], [("40", "3", None, "[0,1]")])
    entity = seen('<t><frame matchTime="4&#48;"><player playerId="&#53;" loc="[0,1]"/></frame></t>')
    assert entity == (["40"], [("40", "5", None, "[0,1]")])
    hidden = seen('\n<t><!-- <frame matchTime="1"><ball/></frame> --><frame matchTime="40"><!-- <frame matchTime="2"> --><ball loc="[0,1]"/></frame>'
                  '<x><![CDATA[<frame matchTime="3"/>]]></x></t>')
    assert hidden == (["40"], [("40", "", None, "[0,1]")])


def test_a_malformed_frame_costs_no_other():
    bad = '<t><frame matchTime="40"><player playerId="5" loc=/></frame><frame matchTime="80"><ball loc="[0,1]" loc="[0,0]"/></frame>'
    good = "".join(f'<frame matchTime="{k}"><ball loc="[0,1]"/></frame>' for k in range(RECORDS + 1))
    frames, objects = seen(bad + good + "</t>")
    assert frames.count(None) == 2 and len(frames) == RECORDS + 3 and len(objects) == RECORDS + 1


def test_malformed_frame_in_a_file_keeps_the_rest(spark, tmp_path):
    (tmp_path / "m1.xml").write_text('<t><frame matchTime="40"><player playerId="5" loc=/></frame>'
                                     '<frame matchTime="80"><player playerId="6" loc="[0.5,0.5]"/><player playerId="none"/></frame></t>')
    rows, _, skipped = S.read_tracker_xml(spark, str(tmp_path / "m1.xml"))
    assert [(r.frame_idx, r.track_id, r.x) for r in rows.collect()] == [(2, 6, 0.0)] and skipped.first().skipped == 1


def test_written_frames_are_whole_files_from_one_narrow_exchange(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(files.D, "frames_of_objects", lambda *a, _f=files.D.frames_of_objects: kept.append(_f(*a)) or kept[0])
    path = files._xml(spark, SF)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Generate" not in plan and "NestedLoop" not in plan
    written = spark.read.text(path, wholetext=True).collect()
    frames = [len(ET.fromstring(r.value.encode()).findall("frame")) for r in written]
    assert len(written) == len({r.match_id for r in written}) and sum(frames) == kept[0].count()
