"""Approximate nearest neighbours by multi-index hashing: learned rotated binary codes, pigeonhole probing, exact reranking."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SAMPLE, FIT_QUERIES, REACH, TABLES, SHARD_ROWS, ROUNDS = 5000, 200, 0.98, 8, 16_384, 30
MASKS = [np.array([sum(1 << b for b in pick) for n in range(r + 1) for pick in combinations(range(8), n)], np.int64) for r in range(9)]


def usable(vectors: DataFrame, vec: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is whole, finite and not zero, as doubles; of the given length."""
    v = F.col(vec).cast("array<double>")
    top = F.lit(float("inf"))
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == top)) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(v) == dims if dims else F.lit(True)))


class Codes:
    """64-bit codes: one more dimension turns inner products into angles (the shortfall to the longest vector, 0 for queries),
    principal axes, and a rotation learned to sit close to the corners of the cube (Gong and Lazebnik 2011)."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest = longest
        rng = np.random.default_rng(5)
        x = self.lifted(sample)
        self.mean = x.mean(0)
        _, _, axes = np.linalg.svd(x - self.mean, full_matrices=False)
        axes = axes[:64]
        if len(axes) < 64:                                  # fewer axes than bits: more directions inside their span
            more = rng.normal(size=(64 - len(axes), axes.shape[0])) @ axes
            axes = np.vstack([axes, more])
        self.axes = axes.T
        v = (x - self.mean) @ self.axes
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ w).T
        self.axes = self.axes @ turn
        self.radius = self.learn_radius(sample, k)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        gap = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.longest ** 2 - (x ** 2).sum(1)))
        return np.column_stack([x / self.longest, gap / self.longest])

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of 8 bytes."""
        if query:
            x = x * (self.longest / np.linalg.norm(x, axis=1, keepdims=True))
        return np.packbits((self.lifted(x, query) - self.mean) @ self.axes > 0, axis=1)

    def learn_radius(self, sample: np.ndarray, k: int) -> int:
        """The Hamming distance that holds the share REACH of the sample's own true neighbours."""
        q = np.arange(0, len(sample), max(1, len(sample) // FIT_QUERIES))
        s = sample[q] @ sample.T
        s[np.arange(len(q)), q] = -np.inf
        near = np.argsort(-s, axis=1)[:, :min(k, len(sample) - 1)]
        if not near.size:
            return 0
        own, asked = self.of(sample), self.of(sample[q], True)
        return int(np.quantile(np.bitwise_count(own[near] ^ asked[:, None, :]).sum(2), REACH))


class MultiIndex:
    """The codes of one shard, cut into 8 substrings of 8 bits, each with its postings by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = codes.copy().view(np.uint64).ravel()
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(TABLES)]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows at most `radius` bits from the code: if r + 1 more bits than the substring radii allow differ, one substring
        is inside its own radius (radii sum to radius - 8 + 1), so probing those values misses none."""
        if radius >= 64:
            return np.arange(len(self.codes))
        spare = radius - TABLES + 1
        seen = np.zeros(len(self.codes), bool)
        for j in range(TABLES):
            r = (spare + TABLES - 1 - j) // TABLES          # radii differ by one at most and sum to `spare`
            if r < 0:
                continue
            order, start = self.order[j], self.start[j]
            values = int(code[j]) ^ MASKS[min(r, 8)]
            a = start[values]
            n = start[values + 1] - a
            seen[order[np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= radius]


def search_shard(ids: np.ndarray, x: np.ndarray, codes: Codes, asks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple]:
    """(query ids, ids, scores) of each block of queries. A radius that gives fewer than k rows is widened until it does."""
    index = MultiIndex(codes.of(x)) if len(x) else None
    for qid, q in asks:
        out = []
        for i, code, v in zip(qid.tolist(), codes.of(q, True) if len(q) else (), q):
            radius, wanted = codes.radius, min(k, len(x) - int((ids == i).sum())) if index else 0
            if not wanted:
                continue
            while True:
                rows = index.within(code, radius)
                rows = rows[ids[rows] != i]
                if len(rows) >= wanted:
                    break
                radius += 4
            score = (x[rows] * v).sum(1)                    # row by row, so that equal vectors tie exactly
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), i), ids[rows][best], score[best]))
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))


def first_of_id(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector an id: of repeated ids the smallest vector in list order stays."""
    if len(np.unique(ids)) == len(ids):
        return ids, x
    order = np.lexsort((*x.T[::-1], ids))
    keep = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    return ids[keep], x[keep]


def shard_batches(batches: Iterator[pa.RecordBatch], codes: Codes, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, is_query, id, vector) sorted so that a shard's rows come first and its queries, one row an id, follow.

    Held at once: the rows of a shard and one block of queries."""
    def blocks():
        for b in batches:
            shard, ask, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1])) + 1
            for s, e in zip(np.append(0, cut), np.append(cut, len(ids))):
                if e > s:
                    yield shard[s], bool(ask[s]), ids[s:e], x[s:e]

    for _, group in groupby(blocks(), key=lambda b: b[0]):
        rows, first = [], []
        for _, ask, ids, x in group:
            if ask:
                first = [(ids, x)]
                break
            rows.append((ids, x))
        ids, x = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros((0, 1)))
        asks = chain(first, ((i, q) for _, _, i, q in group))                # one arriving block of queries at a time
        for qid, vid, score in search_shard(*first_of_id(ids, x), codes, asks, k):
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(vid, pa.int64()), pa.array(score, pa.float64())],
                                             ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by inner product among the rows of another id.

    Rows are dealt by hash of their id into shards of about SHARD_ROWS, each a multi-index that every query searches; a query's
    best k of every shard meet again. Codes and radius are learned on at most SAMPLE rows (smallest hashes). Null ids, and
    vectors null, zero, with null or non-finite parts, or of another length than most, take no part. A repeated id counts once.
    """
    v = F.col(vec).cast("array<double>")
    rows = usable(vectors, vec).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("x"))
    common = rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    schema = "query_id bigint, vec_id bigint, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("x") == common.n)
    longest = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)))).first()[0]
    sample = rows.select("id", "x").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).collect()
    codes = Codes(np.array([r.x for r in sample]), longest, k)
    shards = -(-common.c // SHARD_ROWS)
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "id", "x")
    asks = usable(queries, vec, common.n).where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("x"))
    asks = asks.groupBy("id").agg(F.min("x").alias("x"))                     # of repeated ids the smallest vector, before the copy
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "id", "x")
    dealt = own.unionByName(asks).repartition(int(shards), "shard").sortWithinPartitions("shard", "ask")
    found = dealt.mapInArrow(lambda b: shard_batches(b, codes, k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
