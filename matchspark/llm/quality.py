"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled

BYTE_BINS, SHAPE_BINS, FORM_BINS = 2048, 2048, 64
BINS = BYTE_BINS + SHAPE_BINS + FORM_BINS
TRAIN_DOCS, TOPICS, NEIGHBOURS, POWER, BLOCK = 2000, 64, 40, 8, 256      # TRAIN_DOCS: bound of the labelled sample, rows a class
SHAPE = np.zeros(256, np.uint8)                                          # lower 1, upper 2, digit 3, space 4, line 5, other bytes themselves
SHAPE[:] = np.arange(256)
SHAPE[128:] = 1
SHAPE[ord("a"):ord("z") + 1], SHAPE[ord("A"):ord("Z") + 1], SHAPE[ord("0"):ord("9") + 1] = 1, 2, 3
SHAPE[32], SHAPE[10] = 4, 5


def form(text: str) -> list[int]:
    """Terms for the form of a text: how much its lines, words and neighbouring words repeat, and how long it is."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    steps = [len(set(words)) / n, sum(map(str.__eq__, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), np.log2(n) / 16]
    return [16 * i + min(15, int(16 * x)) for i, x in enumerate(steps)]


def counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of byte 3-grams, 3-grams of character shapes, and form terms: one row of BINS a text."""
    raw = [t.encode() + b"\0\0" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8)
    row = np.repeat(np.arange(len(raw)), size) * BINS
    last = np.cumsum(size)
    live = np.ones(len(row), bool)
    live[last - 1] = live[last - 2] = False                 # no gram crosses into the next text
    out = np.zeros(len(raw) * BINS, np.int64)
    for codes, at, bins in ((text, 0, BYTE_BINS), (SHAPE[text], BYTE_BINS, SHAPE_BINS)):
        c = codes.astype(np.uint32)
        h = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        out += np.bincount((row + at + h[:len(row)] % bins)[live], minlength=len(out))
    out = out.reshape(len(raw), BINS)
    for i, t in enumerate(texts):
        out[i, [BYTE_BINS + SHAPE_BINS + f for f in form(t)]] += 3
    return out


class Space:
    """Inverse document frequencies, latent axes, and the labelled vectors with their labels and class weights."""

    def __init__(self, idf: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.idf, self.axes, self.vectors, self.labels, self.weights = idf, axes, vectors, labels, weights

    @staticmethod
    def terms(texts: list[str], idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts(texts)).astype(np.float32) * idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def place(self, texts: list[str]) -> np.ndarray:
        """Unit latent vectors; zero where a text has no term."""
        v = self.terms(texts, self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, v: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors, all cosines computed exactly."""
        if not len(self.labels):
            return np.full(len(v), 0.5)
        cosine = v @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = (np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER + 1e-6) * self.weights[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)

    def score(self, texts: list[str]) -> np.ndarray:
        return self.vote(self.place(texts))


def frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task and bin: how many of its documents hold the bin; the bin -1 counts the documents."""
    held, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            texts = [t or "" for t in batch.column(0).slice(a, BLOCK).to_pylist()]
            held += (counts(texts) > 0).sum(0)
            n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS), pa.int32()), pa.array(np.append(n, held), pa.int64())], ["bin", "n"])


def inverse_frequency(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bin over all documents; BINS + 1 numbers reach the driver."""
    sums = docs.select(F.col("text").cast("string")).mapInArrow(frequency_batches, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    n = np.zeros(BINS + 1)
    for r in sums.collect():
        n[r.bin + 1] = r.n
    return (np.log((1 + n[0]) / (1 + n[1:])) + 0.1).astype(np.float32)


def fit_space(texts: list[str], labels: np.ndarray, shares: tuple[float, float], idf: np.ndarray, seed: int = 11) -> Space:
    """Latent axes by a randomised singular value decomposition of the labelled term matrix."""
    if not texts:
        return Space(idf, np.zeros((BINS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    x = np.vstack([Space.terms(texts[a:a + BLOCK], idf) for a in range(0, len(texts), BLOCK)])
    k = min(TOPICS, len(texts))
    q = np.random.default_rng(seed).normal(size=(BINS, min(k + 16, len(texts)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0] if q.shape[1] <= BINS else q
    u, _, _ = np.linalg.svd(q.T @ (x.T @ (x @ q)))
    axes = (q @ u[:, :k]).astype(np.float32)
    v = x @ axes
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    rate = [max(1e-9, (labels == y).mean()) for y in (0, 1)]
    weights = np.where(labels > 0, shares[1] / rate[1], shares[0] / rate[0])
    return Space(idf, axes, v.astype(np.float32), labels.astype(float), weights)


def fit(docs: DataFrame, labels: DataFrame) -> Space:
    """Frequencies over all documents; axes and neighbours from a bounded sample of the labelled rows outside the held-out fold."""
    sample, counted = labelled(docs, labels, "quality", TRAIN_DOCS)
    rows = sorted((r.doc_id, r.text or "", r.y) for r in sample.collect())
    n = {r.y: r["count"] for r in counted.collect()}
    total = max(1, sum(n.values()))
    return fit_space([r[1] for r in rows], np.array([r[2] for r in rows], float), (n.get(0, 0) / total, n.get(1, 0) / total), inverse_frequency(docs))


def score_batches(batches: Iterator[pa.RecordBatch], space: Space) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            score = space.score([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64))], ["doc_id", "score"])


def scored(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts are scored as the empty text; without labelled rows every score is 0.5. Repeated rows score alike;
    ties among neighbours are cut arbitrarily but alike for equal texts. The model (labelled vectors, at most 2 x TRAIN_DOCS of
    TOPICS numbers, and the axes) is what reaches every task.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(lambda b: score_batches(b, space), "doc_id bigint, score double")
