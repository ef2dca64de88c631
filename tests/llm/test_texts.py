import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from matchspark.llm import chat, decontamination, queries, secret_scan, simhash
from matchspark.llm.secret_scan import BASE, RULES


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(4, len(words))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_groups(prints, radius):
    """Root of every distinct fingerprint, all pairs compared."""
    points = sorted(set(prints))
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_query_seven(spark, sf001):
    rows = queries.op7_bktree_simhash(spark, sf001).toPandas()
    docs = spark.read.parquet(f"{sf001}/documents.parquet").toPandas()
    prints = dict(zip(docs.doc_id, map(slow_print, docs.text)))
    roots = slow_groups(prints.values(), 4)
    low = {}
    for d, p in prints.items():
        low[roots[p]] = min(d, low.get(roots[p], d))
    assert dict(zip(rows.doc_id, rows.fingerprint)) == {d: f"{p:016x}" for d, p in prints.items()}
    assert dict(zip(rows.doc_id, rows.component_id)) == {d: low[roots[p]] for d, p in prints.items()}


@pytest.mark.parametrize("tree", [4, 4096])
def test_links_connect_what_all_pairs_connect(spark, sf001, tree):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(300)} | {0}
    for p in list(points)[:40]:                             # chains of near points around some
        for _ in range(12):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            points.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), tree=tree)
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    want = slow_groups(points, 4)
    groups, other = {}, {}
    for p, s in zip(points, signed):
        groups.setdefault(roots.get(s, s), set()).add(p)
        other.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_tree_search_equals_scan():
    rng = np.random.default_rng(0)
    points = np.unique(rng.integers(0, 1 << 20, 800, dtype=np.uint64))
    q, p = simhash.BKTree(points).near(points[:60], 4)
    d = np.bitwise_count(points[:60, None] ^ points[None])
    assert sorted(zip(q.tolist(), p.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(d <= 4))))


def test_near_duplicates_of_odd_rows(spark, sf001, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).toPandas()
    assert len(rows) == odd_docs.count()
    zero = rows[rows.fp == 0]
    assert set(zero.component_id) == {3} and len(zero) == 4     # null, empty and blank texts, one of them without an id
    assert set(rows[rows.doc_id.isin([1, 2, 7])].component_id) == {1}
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 3, 6, 8, 9, 9, 10]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0


SLOW = (("assign", re.compile(BASE[0].pattern, re.ASCII), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def slow_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(SLOW) for m in p.finditer(text or "") if len(m[g]) >= n)


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert q("[0-9a-f]{24,}") is None and q("ab[cd]") == [frozenset({"abc"}), frozenset({"abd"})]
    assert q("(abc|x)") is None
    assert frozenset({"api", "pik", "ike", "key"}) in q(RULES[0].pattern) and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q(RULES[0].pattern)


def test_scan_equals_plain_search(spark, sf001, odd_docs, no_docs):
    rng = random.Random(5)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ApiKey", '"', "'", " ", "  ", ":", "=", "abc", "abcdef", "x/y+z=", "AKIA", "A1B2C3D4E5F6G7H8",
            "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", "token: token: abcdefg", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)] + ["token=abcdef " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert sorted((s.start, s.rank, s.end) for s in got[i] if s.rank < 3) == slow_spans(t)
    assert any(s.rank == 3 for x in got.values() for s in x) and any(s.rank == 5 for x in got.values() for s in x)
    odd = secret_scan.scan(odd_docs).collect()
    assert len(odd) == odd_docs.count() and secret_scan.scan(no_docs).count() == 0
    assert secret_scan.scan(docs, (RULES[2],)).count() == len(texts)


def test_candidates_come_from_postings(spark, sf001):
    docs = spark.createDataFrame([(1, "a Token: here"), (2, "nothing"), (3, "akia only kia"), (None, "secret")], "doc_id bigint, text string")
    got = {r.doc_id: sorted(r.rules) for r in secret_scan.candidates(docs, RULES).collect()}
    assert got == {1: [0], 3: [1], None: [0]}


def test_query_six(spark, sf001):
    rows = {r.conv_id: r for r in queries.op6_event_chat(spark, sf001).collect()}
    p = spark.read.parquet(f"{sf001}/conversations.parquet").toPandas()
    for c, g in p.sort_values("turn").groupby("conv_id"):
        said = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))
        loss = "".join(t for r, t in zip(g.role, g.text) if r == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(g), hashlib.sha256(said.encode()).hexdigest())
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows[-1].loss_chars == len("</s>[INST] ok [/INST]") and len(rows) == p.conv_id.nunique() + 1


def test_fold(spark, sf001):
    log = [(1, 0, 1, 0, "delta", "user", "Hel"), (1, 0, 1, 1, "delta", "user", "lo"), (1, 1, 1, 2, "delta", "assistant", "bad"), (1, 1, 1, 3, "regenerate", "assistant", None),
           (1, 1, 1, 5, "delta", "assistant", "there"), (1, 1, 1, 4, "delta", "assistant", "Hi "), (1, 2, 1, 6, "delta", "user", "x"), (1, 2, 1, 7, "edit", "user", "why?"),
           (1, 2, 1, 8, "delta", None, " now"), (1, 3, 1, 9, "odd", "assistant", "ignored"), (None, None, 1, 0, "delta", None, None)]
    got = chat.fold(spark.createDataFrame(log, "conv_id bigint, turn bigint, tie int, seq int, event string, role string, text string"))
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in got.collect()} == {
        (1, 0): ("user", "Hello"), (1, 1): ("assistant", "Hi there"), (1, 2): ("", "why? now"), (1, 3): ("assistant", ""), (None, None): ("", "")}


def test_escapes_are_reversible_and_hide_controls(spark, sf001):
    rng = random.Random(6)
    bits = ["\\", "<", "|", ">", "s", "l", "p", "</s>", "<|user|>", "\\s", "\\l", "é", "\n", "[INST]"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(15))) for _ in range(500)]
    turns = [(i // 5, i % 5, rng.choice(["user", "assistant", "a|>b", "system"]), t) for i, t in enumerate(texts)]
    turns += [(900, i, "assistant", f"turn {i}") for i in range(700)] + [(901, 0, None, None), (901, None, "user", "first"), (901, 0, None, None), (None, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, line string")
    rows = {r.conv_id: r for r in chat.digest(chat.formatted(chat.event_log(df))).collect()}
    by = {}
    for c, n, r, t in turns:
        by.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert set(rows) == set(by)
    for c, ts in by.items():
        ts.sort()
        assert rows[c].n_turns == len(ts)
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        assert rows[c].loss_sha256 == hashlib.sha256("".join(t for _, r, t in ts if r == "assistant").encode()).hexdigest()
    pieces = chat.formatted(chat.event_log(df.where("conv_id = 900")))
    assert pieces.count() == 3                               # 700 turns in pieces of 256
    assert chat.digest(chat.formatted(chat.event_log(df.limit(0)))).count() == 0


def canon(text):
    """Plain version of the template words."""
    t = (text or "").replace("\u0001", " ")
    t = re.sub(r"(?<=[a-z0-9,;:] )([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)", " \u0001p\\1 ", t)
    t = re.sub(r"(?<![^\W_])[0-9]+(?:[.,][0-9]+)*", lambda m: f" \u0001n{m[0]} ", t)
    t = re.sub(rf"(\u0001n[0-9.,]+) \s*({decontamination.UNITS.replace(' ', '|')})(?![^\W_])", "\\1 \u0001u\\2 ", t)
    out, t = [], t.lower()
    for w in re.sub(r"(?![.,\u0001])[\W_]|[.,](?![0-9])", " ", t).split():
        out.append(w)
    return out


def slow_leaks(docs, items, share=0.8):
    def template(w):
        return w[:2] if w[0] == "\u0001" else w
    index, sizes = {}, {}
    for i, t in items:
        w = canon(t)
        sizes[i] = len(w) - 4
        for k in range(len(w) - 4):
            index.setdefault(tuple(map(template, w[k:k + 5])), []).append((i, k, w[k:k + 5]))
    out = {}
    for d, t in docs:
        w, runs = canon(t), {}
        for k in range(len(w) - 4):
            for i, j, other in index.get(tuple(map(template, w[k:k + 5])), ()):
                runs.setdefault((i, k - j), []).append((j, [(a, b) for a, b in zip(other, w[k:k + 5]) if a[0] == "\u0001"]))
        got = {}
        for (i, _), hits in runs.items():
            pairs = {p for _, ps in hits for p in ps}
            sound = len(pairs) == len({a for a, _ in pairs})
            got.setdefault(i, set()).update(j for j, ps in hits if sound or not ps)
        out |= {(d, i): len(js) for i, js in got.items() if sizes[i] > 0 and len(js) / sizes[i] >= share}
    return out


def test_query_eight(spark, sf001):
    sf = sf001.replace("0.001", "0.01")
    rows = queries.op8_template_decontamination(spark, sf).toPandas()
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = slow_leaks(zip(docs.doc_id, docs.text), zip(bench.item_id, bench.text))
    assert want and dict(zip(zip(rows.doc_id, rows.item_id), rows.matched)) == want


def test_reparameterised_questions(spark, sf001, odd_docs, no_docs):
    item = "A train leaves for Boston with 12 coaches and 340 passengers. At each stop 12 of them leave for Boston, how many kg of coal does it need after 5 km and 7 stops?"
    other = item.replace("Boston", "Lima").replace("12", "31").replace("340", "9,000").replace("5 km", "8 miles")
    mixed_up = item.replace("12 coaches", "31 coaches")       # one value of the item, two in the text
    rows = [(1, f"Intro text. {other} Thanks."), (2, item), (3, item.replace("coaches", "wagons")), (4, mixed_up), (5, "train leaves for 12"), (6, None), (7, ""), (2, item)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, windows int")
    bench = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, "", 0), (13, "too short", 0), (None, item, 0), (14, item, 0)], "item_id bigint, text string, at int")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.leaks(docs, bench).collect()}
    assert got == slow_leaks([(a, b) for a, b in dict(rows).items()], [(10, item), (14, item)])
    assert {(1, 10), (2, 10), (1, 14), (2, 14)} <= set(got) and not {k for k in got if k[0] in (4, 5, 6, 7)}
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and {5, 6, 7} <= {r.doc_id for r in kept.collect()} and not {1, 2} & {r.doc_id for r in kept.collect()}
    assert decontamination.clean(odd_docs, bench).count() == odd_docs.count()
    assert decontamination.leaks(no_docs, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_copies_whatever_stands_around_their_capitals(spark, sf001):
    short, item = "What is the capital of France?", "Tell me how Anna and Bert in Paris met Carl from Rome and then left Dora in Oslo with Emil"
    copies = [f"Question: {short} Answer: Paris.", f"1, {short}", short.upper(), f"so {short.lower()}", short.replace(" of ", " of\n"), short]
    longer = [item.lower(), item.replace(" in ", " in\n"), item.replace(" ", "  "), item.upper(), item.title(), f"Task: {item}"]
    docs = spark.createDataFrame(list(enumerate(copies + longer)) + [(99, "What is the colour of France? Tell me how")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, short), (2, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, 1.0).collect()}
    assert got == {(i, 1) for i in range(len(copies))} | {(i + len(copies), 2) for i in range(len(longer))}
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [99]
    near = spark.createDataFrame([(1, "Question: Compute 5 times 7 plus 9"), (2, "Yes. Compute 5 times 7 plus 9")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "Compute 3 times 4 plus 8")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontamination.leaks(near, asked).collect()) == [1, 2]


def test_long_rows_of_numbers(spark, sf001):
    item = "Add the numbers 4 and 5 to what is left of them"
    rows = [(1, "1" + ",2" * 50_000 + " end. " + item), (2, "7" + ".25" * 50_000), (3, "1" + ", 2" * 50_000)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()] == [(1, 1)]


def test_big_benchmark_is_shuffled_not_broadcast(spark, sf001, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf001}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontamination.leaks(docs, bench).collect())) == want


def test_main_paths_are_native(spark, sf001):
    for name in ("op3_trigram_secrets", "op6_event_chat", "op8_template_decontamination"):
        plan = queries.QUERIES[name](spark, sf001)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|MapIn", plan)


def test_near_duplicates_under_one_id_or_none(spark):
    """Rows are named by id and text: near copies under one id, or without an id, go too."""
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, text), (None, text + " more"), (5, text + " a"), (5, text + " b"), (5, text + " c"), (5, "quite another text that stays as it is"), (5, "quite another text that stays as it is")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS KEY", "1 AS text_hash")
    got = simhash.deduplicated(df)
    assert sorted((r.doc_id, r.text[:5]) for r in got.collect()) == [(1, "word0"), (5, "quite")] and got.columns == df.columns


def test_a_text_of_a_hundred_thousand_secrets(spark):
    import time
    n = 100_000
    df = spark.createDataFrame([(1, "token=abcdef " * n)], "doc_id long, text string")
    t0 = time.time()
    spans = secret_scan.scan(df).first().spans
    assert [(s.start, s.end) for s in spans[:3]] == [(0, 12), (13, 25), (26, 38)] and len(spans) == n and spans[-1].end == 13 * n - 1
    assert time.time() - t0 < 60


def test_pieces_pass_by_in_batches():
    """Small batches and a small hold give links that connect the same rows as a piece held whole, and as plain search does."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, False)) for _ in range(900)], np.uint64)
    fp = np.unique(centres[rng.integers(0, 40, 900)] ^ flips)
    piece = np.repeat(np.arange(3), len(fp))
    own = np.tile(rng.integers(0, 2, len(fp)), 3) == piece                  # piece 2 has no tree at all
    order = np.lexsort((~own, piece))
    rows = [pa.array(np.full(len(order), 9)), pa.array(piece[order]), pa.array(own[order]), pa.array(np.tile(fp, 3)[order].view(np.int64))]
    whole = pa.RecordBatch.from_arrays(rows, ["shard", "piece", "own", "fp"])
    alone = pa.RecordBatch.from_arrays([pa.array([10, 10]), pa.array([0, 0]), pa.array([True, True]), pa.array(fp[:2].view(np.int64))], ["shard", "piece", "own", "fp"])

    def groups(pairs):
        root = {int(v): int(v) for v in fp}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v
        for a, b in pairs:
            root[top(a)] = top(b)
        out = {}
        for v in root:
            out.setdefault(top(v), set()).add(v)
        return {frozenset(g) for g in out.values()}

    def linked(batches, hold):
        return [(a & (1 << 64) - 1, b & (1 << 64) - 1) for r in simhash.link_batches(iter(batches), 4, hold)
                for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist())]
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    plain = groups([(int(fp[i]), int(fp[j])) for i, j in zip(*np.nonzero(near))])
    assert len(plain) < len(fp)
    cut = [whole.slice(at, 37) for at in range(0, len(order), 37)]
    for batches, hold in (([whole], 1 << 20), ([whole], 5), (cut, 1 << 20), (cut, 50), ([*cut, alone.slice(0, 0), alone], 50)):
        got = linked(batches, hold)
        assert groups(got) == plain
        assert all(bin(a ^ b).count("1") <= 4 or {a, b} <= next(g for g in plain if a in g) for a, b in got)
