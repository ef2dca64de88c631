"""Hard negatives: exact integer scores from products modulo small primes in float32, then selection in a score window."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil, isqrt, prod, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

EXACT = 1 << 24                                  # whole numbers up to here are exact in float32
ANCHOR_BLOCK, ROWS, ANCHORS = 65_536, 2048, 512  # anchors a task holds; rows and anchors of one product
LEAST, MOST = -(1 << 62), 1 << 62


class Residues:
    """Products of whole-number matrices through residues: every modulus is a prime small enough that a float32 sum of products
    of centred residues is exact in any order; Chinese remaindering (mixed radix) gives the signed result back."""

    def __init__(self, dims: int, largest: int):
        need, p = 2 * max(dims, 1) * largest * largest + 1, 2 * isqrt(EXACT // max(dims, 1)) + 1
        self.primes: list[int] = []
        while prod(self.primes) <= need:
            while p > 2 and any(p % d == 0 for d in range(2, isqrt(p) + 1)):
                p -= 1
            if p < 3 or prod(self.primes) * p >= MOST:
                raise ValueError(f"scores of {dims} components up to {largest} do not fit a long")
            self.primes.append(p)
            p -= 1
        self.product = prod(self.primes)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """Centred residues by each prime."""
        return [((x + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The exact product a @ b.T of two matrices given by their parts."""
        out, weight = None, 1
        for p, left, right in zip(self.primes, a, b):
            r = (left @ right.T).astype(np.int64)
            if out is None:
                out = r % p
            else:
                out = out + weight * (((r - out) % p) * pow(weight, -1, p) % p)
            weight *= p
        return np.where(out > self.product // 2, out - self.product, out)


class First:
    """The first k rows (score falling, id rising) of every slot, over blocks of rows as they come."""

    def __init__(self, slots: int, k: int):
        self.k, self.bar = k, np.full(slots, LEAST)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ok: np.ndarray, ids: np.ndarray, slots: slice) -> None:
        """A block: scores and a flag for each (row, slot of the slice)."""
        keep = ok & (score >= self.bar[slots])
        if keep.sum() > 4 * self.k * keep.shape[1] and len(ids) > self.k:      # first blocks: few of the many can stay
            bar = np.partition(np.where(keep, score, LEAST), len(ids) - self.k, axis=0)[len(ids) - self.k]
            keep &= score >= bar
        row, col = np.nonzero(keep)
        if not len(row):
            return
        slot = np.append(self.slot, col + slots.start)
        value, vid = np.append(self.score, score[row, col]), np.append(self.id, ids[row])
        order = np.lexsort((vid, -value, slot))
        slot, value, vid = slot[order], value[order], vid[order]
        start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        stay = rank < self.k
        full = rank == self.k - 1
        self.bar[slot[full]] = value[full]
        self.slot, self.score, self.id = slot[stay], value[stay], vid[stay]


def blocks(batches: Iterator[pa.RecordBatch]):
    """(cell, is it a row, ids, labels, vectors, lowest scores, highest scores) of each stretch of one cell and kind."""
    for b in batches:
        cell, is_row, ids, label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        lists = [b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5, 6)]
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (is_row[1:] != is_row[:-1])) + 1
        ends = [np.append(0, np.cumsum(b.column(i).value_lengths().to_numpy(zero_copy_only=False))) for i in (4, 5, 6)]
        for s, e in zip(np.append(0, cut), np.append(cut, len(ids))):
            if e > s:
                yield cell[s], bool(is_row[s]), ids[s:e], label[s:e], *[x[z[s]:z[e]].reshape(e - s, -1) for x, z in zip(lists, ends)]


def cell_batches(batches: Iterator[pa.RecordBatch], residues: Residues, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Cells of sorted rows, each with its anchors first: (anchor_id, ask, vec_id, score) of the first k rows of each anchor's asks.

    Held at once: a cell's anchors and what they keep, and one block of rows; repeated ids stand together and count once."""
    for _, group in groupby(blocks(batches), key=lambda g: g[0]):
        held, tops, parts, last = [], None, None, None
        for _, is_row, ids, label, x, low, high in group:
            if not is_row:
                held.append((ids, label, x, low, high))
                continue
            if not held:
                continue
            if tops is None:
                aid, alabel, ax, alow, ahigh = (np.concatenate(c) for c in zip(*held))
                tops, parts = [First(len(aid), k) for _ in range(alow.shape[1])], residues.parts(ax)
            new = np.append(ids[:1] != last, ids[1:] != ids[:-1])
            last, ids, label, x = ids[-1], ids[new], label[new], x[new]
            for i in range(0, len(ids), ROWS):
                rows, own = slice(i, i + ROWS), residues.parts(x[i:i + ROWS])
                for j in range(0, len(aid), ANCHORS):
                    part = slice(j, j + ANCHORS)
                    score = residues.scores(own, [p[part] for p in parts])
                    ok = (label[rows, None] == alabel[part]) == same
                    ok &= ids[rows, None] != aid[part]
                    for top, lo, hi in zip(tops, alow.T, ahigh.T):
                        top.offer(score, ok & (score >= lo[part]) & (score <= hi[part]), ids[rows], part)
        for ask, top in enumerate(tops or ()):
            yield pa.RecordBatch.from_arrays([pa.array(aid[top.slot], pa.int64()), pa.array(np.full(len(top.slot), ask), pa.int32()),
                                              pa.array(top.id, pa.int64()), pa.array(top.score, pa.int64())], ["anchor_id", "ask", "vec_id", "score"])


def first_rows(rows: DataFrame, anchors: DataFrame, cells: tuple[int, int], residues: Residues, same: bool, k: int) -> DataFrame:
    """anchor_id, ask, vec_id, score, rank: for each ask (a score window) of each anchor, the first k rows of its label (`same`) or of others.

    All rows meet all anchors in a grid of row shards by anchor blocks; each cell is one stretch of work, whose best k meet again.
    """
    shards, parts = cells
    none = F.array().cast("array<bigint>")
    own = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("is_row"), "id", "label", "x",
                      none.alias("low"), none.alias("high"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    asks = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(False).alias("is_row"), "id", "label", "x",
                          "low", "high", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).alias("part"))
    columns = [(F.col("shard") * parts + F.col("part")).cast("int").alias("cell"), "is_row", "id", "label", "x", "low", "high"]
    dealt = own.select(columns).unionByName(asks.select(columns)).repartitionByRange(shards * parts, "cell")
    found = dealt.sortWithinPartitions("cell", "is_row", "id", "label", "x").mapInArrow(
        lambda b: cell_batches(b, residues, same, k), "anchor_id bigint, ask int, vec_id bigint, score bigint")
    order = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, scale: int, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, x: components as floor(scale * x). Rows with a null id, label or vector, or a null or non-finite component, take no part."""
    v = F.col(vec).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def mine(vectors: DataFrame, is_anchor, scale: int = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
         key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which the condition `is_anchor` on column `id` holds. An anchor's positives are its first rows of its label;
    a positive's negatives are the first rows of other labels that score at most the positive and at least its share. Higher scores
    come first, equal ones by smaller id. Of a repeated id the row of smallest label, then smallest vector counts; vectors of another
    length than most take no part, nor do rows that `quantised` leaves out; scores that a long cannot hold raise ValueError. An empty
    table, or an anchor without positives or without negatives in reach, gives no rows.
    """
    rows = quantised(vectors, scale, key, vec, label)
    size = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, c: F.greatest(a, F.abs(c)))
    seen = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest"),
                                                       F.count(F.when(is_anchor, 1)).alias("anchors")).orderBy(F.desc("n"), "dims").first()
    if seen is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    rows = rows.where(F.size("x") == seen.dims)
    residues = Residues(seen.dims, seen.largest)
    cells = max(1, ceil(sqrt(seen.n) / 32)), max(1, ceil(seen.anchors / ANCHOR_BLOCK))     # shards balance copied rows and copied anchors
    anchors = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")
    every = anchors.select("*", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    best = first_rows(rows, every, cells, residues, True, positives)
    score, (num, den) = F.col("score"), share
    low = F.expr(f"CASE WHEN score >= 0 THEN (score * {num} + {den - 1}) div {den} ELSE (score * {num}) div {den} END")
    # Null-free windows: an ask that an anchor has no positive for is an empty one.
    asks = saved(best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), score, low.alias("low")))).alias("p")))      # read twice below

    def padded(name: str, other: int):
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("p", i)[name], F.lit(other)))
    windows = anchors.join(asks.withColumnRenamed("anchor_id", "id"), "id").select(
        "id", "label", "x", padded("low", MOST).alias("low"), padded("score", LEAST).alias("high"))
    found = first_rows(rows, windows, cells, residues, False, negatives)
    named = asks.select("anchor_id", F.posexplode("p").alias("ask", "p")).select("anchor_id", "ask", "p.positive_id", F.col("p.score").alias("positive_score"))
    return found.join(named, ["anchor_id", "ask"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
