import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from matchspark.llm import mixing, queries, sharding


def jump_slow(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_slow(int(k), n) for k in keys]


def test_query_one(spark, sf001):
    rows = queries.op1_jump_sharding(spark, sf001).toPandas()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").toPandas()
    m = rows.merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(rows) == len(docs) == len(m)
    assert all(a == len(t.encode()) + 1 and b == zlib.crc32(t.encode()) for a, b, t in zip(m["size"], m.text_crc32, m.text))
    moved = rows[rows.shard != rows.grown_shard]
    assert (moved.grown_shard == 8).all() and rows.shard.between(0, 7).all() and set(rows.law) == {"key"}
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_odd_rows_are_all_numbered(spark, sf001, odd_docs, no_docs):
    placed = sharding.assign(odd_docs.select("doc_id", "shard"), ["doc_id"], 3)
    rows = sharding.numbered(placed).toPandas()
    assert len(rows) == odd_docs.count()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert rows.groupby("doc_id", dropna=False).shard.nunique().max() == 1
    assert sharding.numbered(sharding.assign(no_docs.select("doc_id"), ["doc_id"], 3)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(odd_docs, ["doc_id"], 0)


def test_shards_are_written(spark, sf001, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, ["doc_id"], 3, f"file://{tmp_path}/out", 2)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == odd_docs.count() and set(back.columns) == set(odd_docs.columns)


def test_targets():
    t = mixing.targets({"b": 100, "a": 100, None: 100})
    assert t["a"] == 200 and t["b"] == pytest.approx(250 * 2 / 3) and t[None] == pytest.approx(250 / 3)
    assert mixing.targets({}) == {}
    t = mixing.targets({"a": 10, "b": 1000, "c": 0})
    assert t["a"] == 20 and t["c"] == 0 and sum(t.values()) == pytest.approx(1515)


def test_flow_reroutes_overlap_and_repeats_last():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 10)]
    flow = mixing.cheapest_flow(patterns, {"a": 150.0, "b": 60.0})
    assert flow[0, "a"] + flow[1, "a"] == 150 and flow[1, "b"] + flow[2, "b"] == 60
    assert flow[0, "a"] == 100 and flow[2, "b"] == 10        # nothing is repeated while unused words are left
    flow = mixing.cheapest_flow(patterns, {"a": 300.0, "b": 60.0})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 300


def test_query_two(spark, sf001):
    rows = queries.op2_flow_mixing(spark, sf001).toPandas()
    again = queries.op2_flow_mixing(spark, sf001).toPandas()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").toPandas()
    m = rows.merge(docs[["doc_id", "text"]], on="doc_id")
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for n, t in zip(m["size"], m.text))
    want = mixing.targets(docs.assign(n=[len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text]).groupby("source").n.sum().to_dict())
    for s, g in rows.groupby("source"):
        assert g.target.nunique() == 1 and g.target.iloc[0] == pytest.approx(want[s]) and (g.taken <= 2 * g["size"]).all()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() / 2
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mix_of_odd_rows(spark, sf001, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).toPandas()
    assert len(rows) == odd_docs.count() and rows[rows["size"] == 0].copies.sum() == 0
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    taken = defaultdict(int)
    for r in out.select("source").collect():
        taken[r.source] += 1
    assert sum(taken.values()) == rows.copies.sum()
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_mixed_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 1, 2, 3, 4) for i in range(8)], "doc_id long, text string, source string, __copies int, row int, u int, copies int")
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.count() == 12 and got.where("__copies = 1 AND row = 2 AND u = 3 AND copies = 4").count() == 12
