"""Language of a text: multinomial naive Bayes over hashed character n-grams, counted over all labelled documents."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of

BITS, ORDERS, SMOOTH, BLOCK = 16, 3, 0.5, 1 << 19          # hashed bins (a power of two), longest gram, added count, characters at once
BINS, NONE, HELD_LANGS, MOST_LANGS = 1 << BITS, "und", 64, 512
SPACE = re.compile(r"\s")


@cache
def letters() -> np.ndarray:
    """For every code point: 2 a letter, 1 a mark on one, 0 anything else."""
    kinds = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter(({"L": 2, "M": 1}.get(k, 0) for k in kinds), np.uint8, 0x110000)


def pieces(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Groups of (row, text) of about BLOCK characters; a longer text is cut at white space, which no gram crosses."""
    group, size = [], 0
    for i, text in enumerate(texts):
        a = 0
        while True:
            cut = SPACE.search(text, a + BLOCK) if len(text) - a > BLOCK else None
            b = cut.start() if cut else len(text)
            group.append((i, text[a:b]))
            size += b - a
            if size >= BLOCK:
                yield group
                group, size = [], 0
            if not cut:
                break
            a = b
    if group:
        yield group


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, their row, which rows hold a letter): grams of 1 to ORDERS characters of lower-cased words, each between one space."""
    parts = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    kind = letters()[codes]
    has = np.bincount(row[kind == 2], minlength=len(parts)) > 0
    keep = (kind > 0) | np.append(True, (kind[:-1] > 0) | (row[1:] != row[:-1]))       # one space for a run of other characters
    c, row, kind = np.where(kind > 0, codes, 32)[keep].astype(np.uint32), row[keep], kind[keep]
    bins, rows, rolling = [], [], np.zeros(len(c), np.uint32)
    inner = np.ones(len(c), bool)                                                      # no space strictly inside the gram
    for n in range(1, ORDERS + 1):
        size = max(0, len(c) - n + 1)
        rolling = rolling[:size] * np.uint32(0x01000193) ^ (c[n - 1:] + np.uint32(n))
        if n > 2:
            inner = inner[:size] & (kind[n - 2:n - 2 + size] > 0)
        inner = inner[:size]
        fits = inner & (row[:size] == row[n - 1:]) & ((kind[:size] > 0) if n == 1 else True)
        mixed = (rolling ^ rolling >> np.uint32(15)) * np.uint32(0x9E3779B1)
        bins.append((mixed >> np.uint32(32 - BITS))[fits])
        rows.append(row[:size][fits])
    return np.concatenate(bins).astype(np.int64), np.concatenate(rows), has


def count_batches(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(lang, text) in, (lang number, bin, n) out: summed over a task's documents before the shuffle."""
    held: dict[int, np.ndarray] = {}

    def out():
        for lang, n in held.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), lang), pa.int32()), pa.array(bins, pa.int32()), pa.array(n[bins], pa.int64())],
                                             ["lang", "bin", "n"])
        held.clear()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for group in pieces(texts):
            bins, rows, _ = grams([t for _, t in group])
            lang = np.array([at[langs[i]] for i, _ in group])[rows]
            for one in np.unique(lang):
                held[int(one)] = held.get(int(one), 0) + np.bincount(bins[lang == one], minlength=BINS)
        if len(held) > HELD_LANGS:
            yield from out()
    yield from out()


class Model:
    """Languages in order and, for each, the log-probabilities of the bins and of the language itself."""

    def __init__(self, langs: list[str], docs: list[int], counts: np.ndarray):
        self.langs = np.array([*langs, NONE], object)
        self.prior = np.log(np.array(docs, float) / max(1, sum(docs)))
        smooth = counts + SMOOTH
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).T.copy() if langs else np.zeros((BINS, 0))

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language, probability) of each text."""
        total, has = np.zeros((len(texts), len(self.prior))), np.zeros(len(texts), bool)
        for group in pieces(texts):
            bins, rows, letter = grams([t for _, t in group])
            at = np.array([i for i, _ in group])
            order = np.argsort(rows, kind="stable")                  # by text, then by order and place: the same sum wherever a text stands
            bins, rows = bins[order], rows[order]
            if len(bins):
                start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                np.add.at(total, at[rows[start]], np.add.reduceat(self.table[bins], start, axis=0))
            np.logical_or.at(has, at, letter)
        if not len(self.prior):
            return np.full(len(texts), NONE, object), np.zeros(len(texts))
        logit = total + self.prior
        best = logit.argmax(1)
        score = 1 / np.exp(logit - logit.max(1, keepdims=True)).sum(1)
        return np.where(has, self.langs[best], NONE), np.where(has, score, 0.0)


def fit(docs: DataFrame, train) -> Model:
    """Counts over every row for which the condition `train` holds and lang is known; what reaches the driver is one number a bin
    and language (BINS numbers for each of at most MOST_LANGS languages, checked)."""
    rows = docs.where(train & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect())
    if len(known) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: the table of probabilities would have no size bound")
    at = {lang: i for i, (lang, _) in enumerate(known)}
    sums = rows.mapInArrow(lambda b: count_batches(b, at), "lang int, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(known), BINS))
    counts[sums["lang"].to_numpy(), sums["bin"].to_numpy()] = sums["n"].to_numpy()
    return Model([lang for lang, _ in known], [n for _, n in known], counts)


def predict_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = model.predict([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest learned language of every whole text and its probability.

    A null text, one without a letter, and any text where nothing was learned, is `und` with score 0. Equal texts score alike, so repeated rows
    do; ties go to the first language by name; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda b: predict_batches(b, model), "doc_id bigint, lang_pred string, score double")


def kept_from_training(doc_id):
    """The held-out third: crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return (crc32_of(doc_id) % 3) == 1
