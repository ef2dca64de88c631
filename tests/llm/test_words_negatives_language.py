"""Spelling variants, hard negatives and language: brute force, odd rows, skew, held-out accuracy."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.llm import hard_negatives, language_id, queries, spelling
from matchspark.llm.common import crc32_of, saved, table


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    words = {}
    while len(words) < 900:                     # few letters, so that bigrams repeat and tie, and many words are near
        w = "".join(rng.choice("aabcé") for _ in range(rng.randint(4, 9)))
        words[w] = rng.choice([5, 6, 30, 150, 900])
    words |= {"z" * k: 5 ** (9 - k) for k in range(4, 9)}
    got = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)
    assert got["zzzzzzzz"][:2] == ("zzzzzzz", "zzzz")


@settings(max_examples=300, deadline=None)
@given(st.text("abÿ", min_size=4, max_size=12), st.integers(0, 12), st.sampled_from(["", "a", "b", "ÿ"]), st.booleans())
def test_any_edit_shares_a_key(word, at, letter, replaced):
    """Of each pair at one edit, one's pivots meet the other's prefix."""
    other = word[:at] + letter + word[at + (replaced or not letter):]
    if len(other) < 4 or not one_edit(word, other):
        return
    counts = Counter(w[i:i + 2] for w in (word, other) for i in range(len(w) - 1))

    def keys(w, probe):
        batch = spelling.pa.RecordBatch.from_arrays([spelling.pa.array([w]), spelling.pa.array([1])], ["word", "n"])
        return set(next(spelling.key_batches(iter([batch]), counts, probe)).column(0).to_pylist())
    assert keys(word, False) & keys(other, True) or keys(other, False) & keys(word, True)


def test_pivots_are_the_cheapest_disjoint_pair():
    assert spelling.pivots([(5, "ab", 0), (1, "bc", 1), (9, "xy", 7)]) == (1, 7)
    assert spelling.pivots([(5, "ab", 0), (1, "bc", 1), (2, "cd", 2)]) == (0, 2)
    assert spelling.pivots([(1, "ab", 3), (1, "bc", 1), (1, "cd", 6)]) in {(1, 3), (1, 6), (3, 6)}


def test_word_counts_of_odd_rows(spark, odd_docs, no_docs):
    rows = {r.word: r.n for r in spelling.word_counts(odd_docs, min_chars=4, min_count=1).collect()}
    assert rows["repeated"] == 2 and rows["größe"] == 1 and rows["élève"] == 1 and "東京" not in rows
    assert sum(n for w, n in rows.items() if w.startswith("filler")) == 60_000
    assert spelling.word_counts(no_docs).count() == 0
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0


def test_keys_and_chains_of_words_are_not_broadcast(spark):
    """Spark takes the dozens of keys of a word to be one row; written words are far smaller than the rows read from them."""
    words = saved(spark.createDataFrame([("ribbon", 50), ("ribon", 1), ("ribbons", 9)], "word string, n long"))
    for df in (spelling.neighbours(words), spelling.variants(words)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_slips_follow_their_rule(spark):
    texts = [(i, f"Étude{i % 7}x Wörter wanderung, Wanderung WANDERUNG {'abcdef' * (i % 3)} ÀB÷cdef") for i in range(400)]
    plain = defaultdict(int)
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            plain[w[:h % len(w)] + w[h % len(w) + 1:] if h % 7 == 0 else w] += 1
    got = spelling.word_counts(spark.createDataFrame(texts, "doc_id long, text string"), 6, 5, slip_every=7)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in plain.items() if len(w) >= 6 and n >= 5}


# ------------------------------------------------------------------ hard negatives

@pytest.mark.parametrize("dims, largest", [(0, 5), (1, 0), (3, 1 << 20), (64, 200), (1024, 255), (700, 40_000)])
def test_residue_products_are_exact(dims, largest):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-largest, largest + 1, (17, dims)), rng.integers(-largest, largest + 1, (23, dims))
    a[0], b[0], b[1] = largest, largest, -largest
    r = hard_negatives.Residues(dims, largest)
    got = r.scores(r.parts(a), r.parts(b))
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_scores_beyond_a_long_are_refused():
    with pytest.raises(ValueError):
        hard_negatives.Residues(64, 1 << 31)


def brute_negatives(rows, step):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and np.isfinite(c) for c in r[2])]
    rows = [(i, y, [int(np.floor(256 * c)) for c in x]) for i, y, x in rows]
    first = {}
    for r in sorted(rows):
        first.setdefault(r[0], r)
    rows, out = list(first.values()), []
    for a, ya, xa in rows:
        if a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x)), i, y) for i, y, x in rows if i != a)
        for ps, p, _ in [s for s in scored if s[2] == ya][:5]:
            near = [s for s in scored if s[2] != ya and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)).round(1)
    x[100:180] = x[100]                                                     # copies: ties in every list
    rows = [(i, int(rng.integers(0, 3)), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(None, 1, [1.0] * 6), (500, None, [1.0] * 6), (505, 1, None), (510, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (515, 1, [float("nan")] * 6), (520, 1, [float("inf")] * 6), (525, 1, [0.0] * 6), (7, 2, [0.5] * 6), (10, 0, [9.0] * 6), (10, 0, [9.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, label int, embedding array<double>, x string, score double")
    # Small blocks, so that what is kept passes over many; cells of all kinds.
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 30)
    got = hard_negatives.mine(df, F.col("id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5)
    assert hard_negatives.mine(df.where("vec_id > 90 AND vec_id < 99"), F.col("id") % 5 == 0).count() >= 0
    assert hard_negatives.mine(df.limit(0), F.col("id") % 5 == 0).columns == got.columns


def test_other_lengths_take_no_part(spark):
    rows = [(i, i % 2, [1.0, float(i)]) for i in range(20)] + [(100, 0, [1.0]), (105, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 5 == 0).collect()))
    assert got == brute_negatives(rows[:20], 5)


# ------------------------------------------------------------------ language

def brute_grams(text):
    words = "".join(c if language_id.unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        b = f" {w} "
        out.update(b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1) if b[i:i + n] != " ")
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aß é'1\n中-Ñ़", max_size=30), min_size=1, max_size=5))
def test_grams_equal_brute_force(texts):
    """As many grams a text as words have, and equal grams in equal bins."""
    bins, rows, has = language_id.grams(texts)
    for i, t in enumerate(texts):
        own = brute_grams(t)
        single = language_id.grams([t])[0]
        assert sorted(bins[rows == i]) == sorted(single) and len(single) == sum(own.values())
        assert len(set(single.tolist())) <= len(own)
        assert has[i] == any(c.isalpha() for c in t.lower() if language_id.unicodedata.category(c)[0] == "L")


def test_long_texts_are_cut_between_words():
    long = "wörter und sätze, " * 200_000
    whole = [g for group in language_id.pieces(["kurz", long, "", "ende"]) for g in group]
    assert "".join(t for i, t in whole if i == 1) == long and max(len(t) for _, t in whole) <= language_id.BLOCK + 20
    n = sum(len(language_id.grams([t])[0]) for i, t in whole if i == 1)
    assert n == 200_000 * sum(brute_grams("wörter und sätze, ").values())


def test_language_equals_plain_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"),
                                                       ("a dog and the cat", "en"), ("das haus und der baum", "de"), (None, "en"), ("x", None)] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, ~language_id.kept_from_training(F.col("doc_id")))
    train = [(t or "", lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 and lang]
    langs, bins = sorted({lang for _, lang in train}), language_id.BINS
    counts = {lang: Counter() for lang in langs}
    for t, lang in train:
        counts[lang].update(language_id.grams([t])[0].tolist())
    got = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        if not t:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        logit = []
        for lang in langs:
            total = sum(counts[lang].values()) + 0.5 * bins
            share = sum(y == lang for _, y in train) / len(train)
            logit.append(np.log(share) + sum(np.log((counts[lang][b] + 0.5) / total) for b in language_id.grams([t])[0].tolist()))
        p = np.exp(np.array(logit) - max(logit))
        assert got[i].lang_pred == langs[int(np.argmax(logit))] and got[i].score == pytest.approx(p.max() / p.sum())


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.fit(odd_docs, F.lit(True))
    got = language_id.predicted(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert language_id.predicted(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs, F.lit(True))
    assert {(r.lang_pred, r.score) for r in language_id.predicted(odd_docs, nothing).collect()} == {("und", 0.0)}


def test_held_out_language_accuracy(spark, sf001):
    docs = table(spark, sf001, "documents")
    got = queries.op13_bayes_language(spark, sf001).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 30 and right >= 0.95
    assert queries.op13_bayes_language(spark, sf001).where(F.col("held_out") != ((crc32_of(F.col("doc_id")) % 3) == 1)).count() == 0
