"""Secret scans through a trigram inverted index: Boolean trigram queries from each rule, postings, verified candidates."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, join_on, prefix_sums


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern (leftmost, non-overlapping matches), and how long its group must be for a match to count."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for their least length inside the pattern drops exactly the runs that are too short.
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]{16,}"), Rule("hex", r"[0-9a-f]{24,}"))
MORE = (Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"), Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"))
RULES = BASE + MORE
GAP, MOST = "\0", 64       # what breaks a literal run; how many alternatives are kept apart


def alternatives(parsed) -> list[str]:
    """Every way through a pattern as literal text, unknown parts shown as GAP; a coarser answer only drops trigrams."""
    ways = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
            own = [chr(c) for _, c in arg]
        elif name == "SUBPATTERN":
            own = alternatives(arg[-1])
        elif name == "BRANCH":
            own = [w for branch in arg[1] for w in alternatives(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            sub = alternatives(inner)
            if (low, int(high)) == (0, 1):
                own = ["", *sub]
            elif low and len(sub) <= MOST:
                own = [w if int(high) == 1 else f"{w}{GAP}{w}" if low > 1 else f"{w}{GAP}" for w in sub]
            else:
                own = [GAP]
        elif name == "AT":
            own = [""]
        else:
            own = [GAP]
        ways = [a + b for a, b in product(ways, own)] if len(ways) * len(own) <= MOST else [w + GAP for w in ways]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs: a text can match only if it holds all trigrams of one clause, letters folded; None: no trigram is mandatory."""
    clauses = [frozenset(run[i:i + 3] for run in way.lower().split(GAP) for i in range(len(run) - 2))
               for way in alternatives(re._parser.parse(pattern))]
    if not clauses or not all(clauses):
        return None
    return sorted({c for c in clauses if not any(o < c for o in clauses)}, key=sorted)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text (null: empty): what postings point to."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of the trigrams that rules ask for: (gram, doc_id, text_hash), a row for each text that holds it."""
    folded = keyed(docs).withColumn("folded", F.lower("text"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    # outer: an inner explode would be preceded by a filter that computes all its input once more
    return folded.select("doc_id", "text_hash", F.explode_outer(present).alias("gram")).where(F.col("gram").isNotNull())


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_hash, rules): which indexed rules each text must be verified for, by intersecting postings per clause."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    number = {g: i for i, g in enumerate(grams)}
    clauses = [(rule, n, len(c), number[g]) for rule, q in queries.items() for n, c in enumerate(q) for g in sorted(c)]
    held = postings(docs, grams).groupBy("doc_id", "text_hash").agg(F.collect_set("gram").alias("grams")) if grams else \
        keyed(docs).select("doc_id", "text_hash", F.array().cast("array<int>").alias("grams")).limit(0)
    by_rule: dict[int, list[Column]] = {}
    for rule, n in dict.fromkeys((rule, n) for rule, n, _, _ in clauses):
        need = [g for r, m, _, g in clauses if (r, m) == (rule, n)]
        by_rule.setdefault(rule, []).append(F.size(F.array_intersect("grams", F.array(*map(F.lit, need)))) == len(need))
    hit = [F.when(reduce(lambda a, b: a | b, conds), F.lit(rule)) for rule, conds in by_rule.items()]
    found = F.array_compact(F.array(*hit)) if hit else F.array().cast("array<int>")
    return held.select("doc_id", "text_hash", found.alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, end) in code points. Texts between matches and the matches themselves give the positions."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    both = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    lens = F.transform(both, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("hit"), F.length(m["value"]).alias("value")))

    def placed(found: Column) -> Column:
        sums = prefix_sums(F.transform(found, lambda m: m["gap"] + m["hit"]))
        return F.zip_with(found, sums, lambda m, s: F.struct((s + m["gap"]).alias("start"), F.lit(rank).alias("rank"),
                                                             (s + m["gap"] + m["hit"]).alias("end"), m["value"].alias("value")))
    return F.transform(F.filter(bound(lens, placed), lambda m: m["value"] >= rule.least), lambda m: m.dropFields("value"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end) by start, of every row of `docs`.

    Rules with mandatory trigrams are verified only in texts their postings name; rules without any are matched against every
    text. Null text is empty and has no spans; rows with a null id, and repeated rows, are all scanned and returned; other
    columns are ignored; an empty table gives none.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rows = join_on(keyed(docs), candidates(docs, rules), ["doc_id", "text_hash"], "left")
    parts = []
    for i, rule in enumerate(rules):
        asked = F.array_contains("rules", F.lit(i)) if trigram_query(rule.pattern) else F.lit(True)
        found = F.when(asked & F.col("text").rlike(rule.pattern), spans_of(F.col("text"), rule, i))
        parts.append(F.coalesce(found, none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")
