"""Spelling variants: words one edit apart, found by pivotal bigrams, and the form that most of their writers use."""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import by_exchange
from .common import saved

HELD = 200_000                                  # distinct words a task holds before it passes their counts on
WORD_BYTES = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else c if c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, one Latin-1 byte a letter."""
    return text.encode("latin-1", "replace").translate(WORD_BYTES).split()


def slipped(run: bytes, doc: int, every: int) -> bytes:
    """The run, less one letter where `every` divides the checksum of `<document>:<run>`: a repeatable typing slip."""
    h = zlib.crc32(run.decode("latin-1").encode(), doc)
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def count_batches(batches: Iterator[pa.RecordBatch], min_chars: int, slip_every: int | None) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) in, (word, n) out: counted over many documents before anything is shuffled."""
    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    held: Counter[bytes] = Counter()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            words = Counter(w for w in runs(text) if len(w) >= min_chars)
            if slip_every:
                seed, typed = zlib.crc32(f"{doc}:".encode()), Counter()
                for w, n in words.items():
                    typed[slipped(w, seed, slip_every)] += n
                words = typed
            held.update(words)
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, slip_every: int | None = None) -> DataFrame:
    """word, n: the words of all whole texts that have at least `min_chars` letters and occur `min_count` times.

    With `slip_every`, about one (document, word) in so many loses a letter first. Null and empty texts hold no words; a null id counts
    as empty text; repeated rows count again; other columns are ignored; an empty table has no words.
    """
    src = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    counted = src.mapInArrow(lambda b: count_batches(b, min_chars, slip_every), "word string, n bigint")
    return counted.where(F.length("word") >= min_chars).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring letters stands in the distinct words; of 90 letters there are at most 8,100 pairs."""
    pairs = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
    return {r.pair: r["count"] for r in pairs.groupBy("pair").count().collect()}


def rarest(word: str, counts: dict[str, int]) -> list[tuple[int, str, int]]:
    """(count, bigram, place) of all bigrams, rarest first."""
    return sorted((counts[word[i:i + 2]], word[i:i + 2], i) for i in range(len(word) - 1))


def pivots(prefix: list[tuple[int, str, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of least total count. By place, the best pair ending here is this bigram and the
    cheapest of those that end before it, which the pass carries along."""
    best, cheapest, waiting = None, None, []
    for count, pair, at in sorted(prefix, key=lambda g: g[2]):
        while waiting and waiting[0][1] + 2 <= at:
            cheapest = min(filter(None, (cheapest, waiting.pop(0))))
        if cheapest and (best is None or cheapest[0] + count < best[0]):
            best = cheapest[0] + count, cheapest[1], at
        waiting.append((count, at))
    return best[1], best[2]


def _key(kind: str, length: int, *parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join((kind, str(length), *parts)).encode()) - (1 << 63)


def index_keys(word: str, prefix: list[tuple[int, str, int]]) -> list[int]:
    """Keys of a word's pivots. One edit spares the left pivot and all before it, or the right pivot and all behind it; in the rest,
    it spares one half. Each key is a pivot with the text that such an edit leaves alone, and the word's length."""
    n, (a, b) = len(word), pivots(prefix)
    half = a + 2 + (n - a - 2) // 2
    return [_key(">1", n, word[:a + 2], word[a + 2:half]), _key(">2", n, word[:a + 2], word[half:]),
            _key("<1", n, word[b:], word[:b // 2]), _key("<2", n, word[b:], word[b // 2:b])]


def probe_keys(word: str, prefix: list[tuple[int, str, int]]) -> set[int]:
    """The keys a neighbour of this word can be indexed under: each bigram of the prefix may be the neighbour's pivot, at the same
    place from the start (edit behind it) or from the end (edit before it), and the neighbour's length differs by one at most."""
    n, keys = len(word), set()
    for _, _, at in prefix:
        for m in (n - 1, n, n + 1):
            first, rest = (m - at - 2) // 2, m - at - 2                # the neighbour's letters behind the bigram, and their first half
            if rest >= 0:
                if at + 2 + first <= n:
                    keys.add(_key(">1", m, word[:at + 2], word[at + 2:at + 2 + first]))
                if rest - first <= n - at - 2:
                    keys.add(_key(">2", m, word[:at + 2], word[n - (rest - first):]))
            head = m - (n - at)                                        # its letters before the bigram
            if head >= 0:
                if head // 2 <= at:
                    keys.add(_key("<1", m, word[at:], word[:head // 2]))
                if head - head // 2 <= at:
                    keys.add(_key("<2", m, word[at:], word[at - (head - head // 2):at]))
    return keys


def key_batches(batches: Iterator[pa.RecordBatch], counts: dict[str, int], probe: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for i, word in enumerate(batch.column(0).to_pylist()):
            grams = rarest(word, counts)
            _, last, at = grams[2]
            # A neighbour's copy of an equal bigram may stand one place on.
            prefix = grams[:4] if len(grams) > 3 and grams[3][1:] == (last, at + 1) else grams[:3]
            own = probe_keys(word, prefix) if probe else index_keys(word, grams[:3])
            keys += own
            rows += [i] * len(own)
        taken = batch.take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *taken.columns], ["key", "word", "n"])


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: each word with every other at exactly one inserted, deleted or replaced letter.

    Of two neighbours, the one whose third-rarest bigram comes first in the common order has two disjoint bigrams among its three
    rarest, one of which the edit spares; that one is among the three rarest of the other too, at most one place away. So pivots
    are joined with prefixes, by hash of pivot, place and spared text, and the pairs met are verified.
    """
    counts = bigram_counts(words)
    schema = "key bigint, word string, n bigint"
    index = words.mapInArrow(lambda b: key_batches(b, counts, False), schema)
    probe = words.mapInArrow(lambda b: key_batches(b, counts, True), schema)
    # Spark takes the keys of a word, dozens of them, to be one row.
    met = index.join(by_exchange(probe.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))), "key").where(
        (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    both = met.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"),
                                                                                    F.col("n").alias("near_n")))).alias("p"))
    return both.select("p.*").repartition("word").dropDuplicates(["word", "near"])


def followed(links: DataFrame, depth: int) -> DataFrame:
    """word, root: the end of each word's chain of forms, of at most `depth` links; each round doubles how far a word sees."""
    for _ in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = saved(links.join(by_exchange(on), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words (word, n) of at least four letters.

    form: the neighbour of largest n (ties: first in code-point order) if that is at least `ratio` times the word's own, else null.
    root: the last of the chain of forms; the word itself without a form. No word, or none with neighbours, gives null forms and
    no rows or zero counts; chains end as n grows by `ratio` (two or more) with every link.
    """
    words = saved(words.select("word", F.col("n").cast("long").alias("n")))
    span = words.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    order = F.struct(-F.col("near_n"), F.col("near"))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("top"))
    top, strong = F.col("top"), -F.col("top.col1") >= ratio * F.col("n")
    found = saved(words.join(near, "word", "left").select(
        "word", F.when(strong, top["near"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -top["col1"]).alias("form_n")))
    depth = math.floor(math.log(span.most / max(1, span.least), ratio) + 1e-9) if span.most else 0
    links = followed(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), depth)
    return found.join(by_exchange(links), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
