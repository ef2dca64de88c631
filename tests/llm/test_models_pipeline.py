import random

import numpy as np
import pytest

import corpus_pipeline
from matchspark.llm import mixing, quality, simhash, toxicity
from matchspark.llm.common import table


def auc(label, score):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + rng.choice(["a", "er", "ing", ""]) for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    rng = random.Random(0)
    texts, labels = [], []
    for i in range(240):
        w = words(rng, rng.randrange(5, 220))
        if i % 3 == 0:
            for k in range(0, len(w), 30):
                w[rng.randrange(k, min(len(w), k + 30))] = rng.choice(["vile", "rottenest", "rottener"])
        texts.append(" ".join(w))
        labels.append(float(i % 3 == 0))
    return toxicity.train(texts, np.array(labels), (0.67, 0.33)), texts, labels


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Net(["ab", "cd"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some = ["ab", "cd", "efg", "hijk"]
    index = rng.integers(0, 4, (6, 7))
    mask = np.arange(7) < np.array([7, 3, 7, 5, 1, 7])[:, None]
    label, weight = np.array([1, 0, 1, 0, 0, 1.0]), np.ones(6)

    def loss():
        z = net.logits(net.inputs(some)[0].astype(np.float64), index, mask)
        return (np.logaddexp(0, z) - label * z).mean()
    g = net.gradients(some, index, mask, label, weight)
    for k in ("uf", "ub", "xf", "bb", "att", "att_v", "out", "word"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = net.p[k][at], 1e-2
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.03), k


def test_network_learns_and_reads_every_window(net):
    net, texts, labels = net
    scorer = toxicity.Scorer(net)
    assert auc(np.array(labels), scorer.score(texts)) > 0.95
    rng = random.Random(9)
    clean = words(rng, 3000)
    at_end = clean[:-1] + ["vile"]
    in_middle = clean[:1500] + ["vile"] + clean[1500:]
    s = scorer.score([" ".join(x) for x in (clean, at_end, in_middle)])
    assert s[1] > s[0] and s[2] > s[0]
    same = scorer.score(["", "", " \n"])
    assert same[0] == same[1] == same[2] and 0 <= same[0] <= 1
    assert np.isfinite(scorer.score(["x" * 200_000])).all()
    assert toxicity.windows(64) == [0] and toxicity.windows(65) == [0, 1] and toxicity.windows(200)[-1] == 136


def test_remembered_words_do_not_change_scores(net, monkeypatch):
    net, texts, _ = net
    want = toxicity.Scorer(net).score(texts[:50])
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 20)
    small = toxicity.Scorer(net)
    got = np.concatenate([small.score(texts[a:a + 5]) for a in range(0, 50, 5)])
    assert np.allclose(want, got, atol=1e-5)


def test_training_without_labels(spark, sf001, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    net = toxicity.fit(odd_docs, labels)
    assert toxicity.scored(odd_docs, net).count() == odd_docs.count()
    assert toxicity.kept(odd_docs, net).columns == odd_docs.columns
    space = quality.fit(odd_docs, labels)
    rows = quality.scored(odd_docs, space).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 0.5 for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (4, 0, None), (8, 1, 1), (None, 1, 1), (10, 0, 0), (1, 1, 0)], "doc_id bigint, toxic int, quality int")
    assert toxicity.scored(odd_docs, toxicity.fit(odd_docs, labels)).count() == odd_docs.count()
    assert quality.scored(odd_docs, quality.fit(odd_docs, labels)).count() == odd_docs.count()
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert quality.scored(no_docs, quality.fit(no_docs, labels)).count() == 0


def test_held_out_accuracy(spark, sf001):
    from matchspark.llm import queries
    sf = sf001.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    q = queries.op9_neighbour_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out]
    assert auc(q.quality.to_numpy(), q.score.to_numpy()) > 0.9 and (q.predicted == q.quality).mean() > 0.9
    t = queries.op4_bigru_toxicity(spark, sf).toPandas().merge(labels, on="doc_id")
    t = t[t.held_out]
    assert len(t) and auc(t.toxic.to_numpy(), t.score.to_numpy()) > 0.9 and (t.predicted == t.toxic).mean() > 0.9


def test_windows_are_cut_when_needed():
    docs = [list(range(200)), [5], list(range(64)), list(range(100, 165))]
    w = toxicity.Windows(docs)
    index, mask = w.rows(np.arange(len(w.owner)))
    for i, d in enumerate(docs):
        own = np.flatnonzero(w.owner == i)
        assert [index[k][mask[k]].tolist() for k in own] == [d[a:a + 64] for a in toxicity.windows(len(d))]
        assert set(range(len(d))) == {a + j for a in toxicity.windows(len(d)) for j in range(min(64, len(d)))}
    starts = toxicity.windows(5000)
    assert all(any(a <= p and p + 32 <= a + 64 for a in starts) for p in range(5000 - 32 + 1))     # a passage of 32 words is whole in a window


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, i % 2, "x" * (1 + 40 * (i % 5))) for i in range(400)] + [(1000, 0, "y" * 5000)]
    got = toxicity.bounded(spark.createDataFrame(rows, "doc_id long, y int, text string"), 4000).toPandas()
    size = got.groupby("y").text.apply(lambda t: t.str.len().sum())
    assert (size <= 4000).all() and (size > 3500).all() and 1000 not in set(got.doc_id)


def test_counts_are_byte_grams():
    texts = ["abc abc", "", "é\nX1", "ab"]
    got = quality.counts(texts)
    for i, t in enumerate(texts):
        raw = t.encode()
        grams = [raw[k:k + 3] + b"" for k in range(len(raw))]
        assert got[i, :quality.BYTE_BINS].sum() == len(grams)
        assert got[i, quality.BYTE_BINS:quality.BYTE_BINS + quality.SHAPE_BINS].sum() == len(grams)
    assert (quality.counts(["xyz", "abc abc"])[1] == got[0]).all()


def test_votes_are_plain_nearest_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, w = (rng.random(300) < 0.5).astype(float), rng.random(300) + 0.5
    space = quality.Space(np.ones(1), np.eye(8), x, y, w)
    q = x[:20] + 0.1
    for v, got in zip(q, space.vote(q)):
        near = sorted(range(300), key=lambda i: -(v @ x[i]))[:quality.NEIGHBOURS]
        weight = [(max(v @ x[i], 0) ** quality.POWER + 1e-6) * w[i] for i in near]
        assert got == pytest.approx(sum(a * y[i] for a, i in zip(weight, near)) / sum(weight))


def test_frequencies_cover_all_documents(spark, sf001):
    docs = table(spark, sf001, "documents")
    texts = [r.text for r in docs.select("text").collect()]
    n = (quality.counts(texts) > 0).sum(0)
    want = (np.log((1 + len(texts)) / (1 + n)) + 0.1).astype(np.float32)
    assert np.allclose(quality.inverse_frequency(docs.repartition(5)), want)


def test_pipeline_stages_hold_what_they_promise(spark, sf001):
    from .test_texts import slow_groups, slow_leaks, slow_print
    sf = sf001.replace("0.001", "0.01")
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark").toPandas()
    stages = dict(corpus_pipeline.STAGES)
    first = corpus_pipeline.saved(stages["toxicity"](spark, docs, sf))
    assert first.columns == docs.columns and 0.7 * docs.count() < first.count() < docs.count()
    before = first.toPandas()
    second = corpus_pipeline.saved(stages["near_duplicates"](spark, first, sf))
    roots = slow_groups([slow_print(t) for t in before.text], 4)
    low = {}
    for d, t in zip(before.doc_id, before.text):
        r = roots[slow_print(t)]
        low[r] = min(d, low.get(r, d))
    after = second.toPandas()
    assert second.columns == docs.columns and sorted(after.doc_id) == sorted(low.values())
    third = corpus_pipeline.saved(stages["decontamination"](spark, second, sf))
    bad = {d for d, _ in slow_leaks(zip(after.doc_id, after.text), zip(bench.item_id, bench.text))}
    left = third.toPandas()
    assert bad and sorted(left.doc_id) == sorted(set(after.doc_id) - bad)
    fourth = corpus_pipeline.saved(stages["mixing"](spark, third, sf))
    plan = mixing.mix(third).toPandas()
    times = fourth.toPandas().doc_id.value_counts().to_dict()
    assert times == {r.doc_id: r.copies for r in plan.itertuples() if r.copies} and fourth.columns == docs.columns
    fifth = stages["tokens"](spark, fourth, sf).toPandas().sort_values("start")
    assert fifth.doc_id.tolist() == sorted(fourth.toPandas().doc_id) and fifth.start.tolist() == np.append(0, fifth.n_tokens.cumsum()[:-1]).tolist()


def test_pipeline_of_odd_and_empty_rows(spark, sf001, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.saved(stage(spark, at, sf001))
            assert at.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, sf001).count() == at.count()
    assert simhash.RADIUS == 4


def test_labelled_rows_are_one_text_an_id(spark, sf001):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(i, f"copy {j}") for i in (1, 2, 3, 4, 6, 7) for j in range(50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    rows = [tuple(r) for r in toxicity.labelled(docs, labels, "toxic", 20)[0].select("doc_id", "y", "text").collect()]
    assert len(rows) == len({r[0] for r in rows}) and {1, 2, 3, 4, 6, 7} & {r[0] for r in rows}
    assert sorted(rows) == sorted(tuple(r) for r in toxicity.labelled(docs.repartition(7), labels, "toxic", 20)[0].select("doc_id", "y", "text").collect())
