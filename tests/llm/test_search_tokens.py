import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from matchspark.llm import hashing_search, orc_tokens, queries
from matchspark.llm.common import shared_dir


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(orc_tokens.TOKENIZER))
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_cut_texts_encode_like_whole_ones():
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", " \n ", "a", "word", "Élan", "don't", "12", "...", "'s", " ", " ", "\x1c", "\x85", "東京", "\U0001f600", "<|endoftext|>", "!?", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "\n", "<|endoftext|>"]
    enc = orc_tokens.Encoder(orc_tokens.TOKENIZER)
    want = plain_ids(texts)
    for again in range(2):                      # the second time from memory
        ids, n = enc.encode(pa.array(texts), 7)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*x, 7] for x in want]
    orc_tokens_known, orc_tokens.KNOWN = orc_tokens.KNOWN, 5
    ids, n = enc.encode(pa.array(texts[:50]).slice(10))
    orc_tokens.KNOWN = orc_tokens_known
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[10:50]


def test_starts_hold_when_a_part_becomes_many_files(spark, sf001):
    path = shared_dir(spark)
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        orc_tokens.write_tokens(docs, path, partitions=4)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert orc_tokens.read_tokens(spark, path).select("file").distinct().count() > 60
    index = orc_tokens.token_index(spark, path).toPandas().sort_values("doc_id")
    assert index.start.tolist() == np.append(0, np.cumsum(index.n_tokens)[:-1]).tolist()


def test_query_five(spark, sf001):
    rows = queries.op5_orc_tokens(spark, sf001).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = spark.read.parquet(f"{sf001}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    ids = [x + [0] for x in plain_ids(docs.text.tolist())]
    assert rows.doc_id.tolist() == docs.doc_id.tolist() and rows.n_tokens.tolist() == [len(x) for x in ids]
    assert rows.start.tolist() == np.append(0, np.cumsum(rows.n_tokens)[:-1]).tolist()
    assert rows.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_files_hold_indexes_and_prune(spark, sf001, odd_docs, no_docs):
    path = shared_dir(spark)
    orc_tokens.write_tokens(odd_docs, path, partitions=3)
    back = orc_tokens.read_tokens(spark, path)
    assert back.count() == odd_docs.count()
    assert back.where("doc_id = 4").select("ids").first()[0] == [0]
    one = orc_tokens.read_tokens(spark, path, [7])
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    assert [r.doc_id for r in one.collect()] == [7]
    index = orc_tokens.token_index(spark, path).toPandas().sort_values("start")
    assert index.start.tolist() == np.append(0, np.cumsum(index.n_tokens)[:-1]).tolist()
    assert index.doc_id.dropna().is_monotonic_increasing and index.doc_id.isna().iloc[:2].all()
    path = shared_dir(spark)
    orc_tokens.write_tokens(no_docs, path)
    assert orc_tokens.token_index(spark, path).count() == 0


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = (x * x[i]).sum(1)
            other = np.flatnonzero(ids != ids[i])
            out[ids[i]] = other[np.lexsort((ids[other], -s[other]))][:k]
    return out


@pytest.mark.parametrize("kind", ["table", "lengths"])
def test_recall(spark, sf001, kind):
    if kind == "table":
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    else:
        rng = np.random.default_rng(1)
        rows = spark.createDataFrame([(i, (rng.normal(size=24) * rng.uniform(0.2, 3)).tolist()) for i in range(1500)], "vec_id bigint, embedding array<double>")
    got = hashing_search.nearest(rows, rows.where("vec_id % 20 = 0"), 20).toPandas()
    p = rows.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding).astype(np.float64)
    want = brute(ids, x, 20)
    hit = sum(len(set(g.vec_id) & set(ids[want[q]])) for q, g in got.groupby("query_id"))
    assert got.groupby("query_id").size().eq(20).all() and got.query_id.nunique() == len(want)
    assert hit / (20 * len(want)) >= 0.9
    place = dict(zip(ids, range(len(ids))))
    assert np.allclose(got.score, [(x[place[a]] * x[place[b]]).sum() for a, b in zip(got.query_id, got.vec_id)], rtol=0, atol=1e-12)
    assert all(g.sort_values(["score", "vec_id"], ascending=[False, True])["rank"].tolist() == list(range(1, 21)) for _, g in got.groupby("query_id"))


def test_probing_misses_no_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (4000, 8)).astype(np.uint8)
    index = hashing_search.MultiIndex(codes)
    for r in (0, 3, 7, 12, 19, 25, 40, 64):
        d = np.bitwise_count(codes ^ codes[5]).sum(1)
        assert index.within(codes[5], r).tolist() == np.flatnonzero(d <= r).tolist()


def test_search_of_odd_rows(spark, sf001):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]),
         (None, [1.0, 1.0]), (7, [0.5, 0.0]), (5, [0.5, 0.0]), (120, [-1.0, 0.0]), (9, [1.0])]
    rows = spark.createDataFrame([(a, b, 1) for a, b in v], "vec_id bigint, embedding array<double>, score int")
    got = hashing_search.nearest(rows, rows.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 5), (0, 7), (0, 120), (120, 5), (120, 7), (120, 0)]
    assert hashing_search.nearest(rows.limit(0), rows.limit(0), 20).count() == 0


def test_shard_batches_split_anywhere():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    codes = hashing_search.Codes(x, float(np.linalg.norm(x, axis=1).max()), 5)
    shard, ask = np.repeat([0, 1], 150).astype(np.int32), np.tile(np.arange(150) >= 120, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ask), pa.array(np.arange(300)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["a", "b", "c", "d"])

    def rows(n):
        parts = [batch.slice(i, n) for i in range(0, 300, n)]
        return sorted(t for b in hashing_search.shard_batches(iter(parts), codes, 5) for t in zip(*(c.to_pylist() for c in b.columns)))
    assert rows(300) == rows(7) == rows(1)


def test_queries_stream_through_a_shard():
    rng = np.random.default_rng(4)
    x, read = rng.normal(size=(300, 6)), []
    codes = hashing_search.Codes(x, float(np.linalg.norm(x, axis=1).max()), 5)
    shard, ask = np.zeros(300, np.int32), np.arange(300) >= 100
    batch = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ask), pa.array(np.arange(300)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["a", "b", "c", "d"])

    def parts():
        for i in range(0, 300, 20):
            read.append(i)
            yield batch.slice(i, 20)
    out = hashing_search.shard_batches(parts(), codes, 5)
    first = next(out)
    assert len(read) <= 7 and set(first.column(0).to_pylist()) == set(range(100, 120))
    assert sum(b.num_rows for b in out) == 180 * 5


def test_repeated_query_ids_count_once(spark, sf001):
    rows = spark.createDataFrame([(i, [1.0 + i, 1.0]) for i in range(1, 8)], "vec_id bigint, embedding array<double>")
    asks = spark.createDataFrame([(100, [1.0, float(i % 3)]) for i in range(50)], rows.schema)
    got = hashing_search.nearest(rows, asks, 3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 8.0), (6, 7.0), (5, 6.0)]
