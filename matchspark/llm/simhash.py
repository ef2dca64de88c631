"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_on, saved

SHINGLE, SEED, RADIUS, BLOCKS, TREE, HOLD = 4, 42, 4, 6, 4096, 65_536
BITS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles: a bit is set if it is set in over half of their hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, stop[:-1] + 1)
    k = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - k
    h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), stop[k:].tolist())], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        ones += np.unpackbits(h[a:a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(BITS[2 * ones > n].sum(dtype=np.uint64))


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def named_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, text) in, (name, fp) out."""
    for batch in batches:
        for part in fingerprint_batches(iter([batch])):
            yield pa.RecordBatch.from_arrays(part.columns, ["name", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signed 64-bit fp of each whole text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        fingerprint_batches, "doc_id bigint, fp bigint")


class BKTree:
    """Children keyed by integer Hamming distance to their parent, built a level at a time over arrays.

    All nodes of a level hand their members down at once: a member's key is (parent, distance), the first of each key becomes the
    child. A search carries (query, node) pairs down and follows only the edges within the radius of the query's distance.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []     # (point of node, keys parent * 65 + distance in order)
        rest = np.arange(1, len(points))
        keys, nodes = np.zeros(1, np.int64), np.zeros(1, np.int64)
        owner = np.zeros(len(rest), np.int64)
        self.levels.append((nodes, keys))
        while len(rest):
            d = np.bitwise_count(points[rest] ^ points[nodes[owner]]).astype(np.int64)
            key = owner * 65 + d
            keys, first, owner = np.unique(key, return_index=True, return_inverse=True)
            nodes = rest[first]
            self.levels.append((nodes, keys))
            keep = np.ones(len(rest), bool)
            keep[first] = False
            rest, owner = rest[keep], owner[keep]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs at most `radius` apart."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found = []
        for depth, (nodes, _) in enumerate(self.levels):
            d = np.bitwise_count(queries[q] ^ self.points[nodes[node]]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], nodes[node[hit]]))
            if depth + 1 == len(self.levels):
                break
            keys = self.levels[depth + 1][1]
            low = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            n = high - low
            q = np.repeat(q, n)
            node = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Forest:
    """The own points of a shard's piece as a BK-tree, with the smallest point each reaches inside it.

    Its links connect whatever near pairs of (row, tree point) connect, and are fewer than all pairs: one from each tree point
    to its smallest, and one from each other row to each tree cluster it touches."""

    def __init__(self, points: np.ndarray, radius: int):
        self.points, self.radius, self.tree = points, radius, BKTree(points) if len(points) else None
        self.step = max(1, 2_000_000 // max(1, len(points)))
        self.low = low = np.arange(len(points))
        for at in range(0, len(points), self.step):
            a, b = self.tree.near(points[at:at + self.step], radius)
            a, b = low[a + at], low[b]
            while (a != b).any():                           # hook the larger root below the smaller, then shorten
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
                while (low[low] != low).any():
                    low = low[low]
                a, b = low[a], low[b]
        self.low = low

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        far = self.low != np.arange(len(self.low))
        return self.points[far], self.points[self.low[far]]

    def touched(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of rows that are not in the tree."""
        left, right = [rows[:0]], [rows[:0]]
        for at in range(0, len(rows) if self.tree is not None else 0, self.step):
            q, p = self.tree.near(rows[at:at + self.step], self.radius)
            pair = np.unique(np.stack([q, self.low[p]]), axis=1)
            left.append(rows[at:at + self.step][pair[0]])
            right.append(self.points[pair[1]])
        return np.concatenate(left), np.concatenate(right)


def _ordered(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64))], ["a", "b"])


def _closed(part: tuple[np.ndarray, ...], radius: int) -> pa.RecordBatch:
    """Links of whole pieces."""
    shard, piece, own, fp = part
    cut = np.flatnonzero((shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])) + 1
    a, b = np.append(0, cut), np.append(cut, len(fp))
    two = (b - a) == 2                                      # most shards: a pair needs no tree
    i = a[two]
    hit = (np.bitwise_count(fp[i] ^ fp[i + 1]) <= radius) & (own[i] | own[i + 1])
    left, right = [fp[i[hit]]], [fp[i[hit] + 1]]
    for s, e in zip(a[(b - a) > 2].tolist(), b[(b - a) > 2].tolist()):
        forest = Forest(fp[s:e][own[s:e]], radius)
        for x, y in (forest.inside(), forest.touched(fp[s:e][~own[s:e]])):
            left.append(x)
            right.append(y)
    return _ordered(left, right)


def link_batches(batches: Iterator[pa.RecordBatch], radius: int, hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """Rows (shard, piece, own, fp) sorted by shard and piece, own rows first: build the tree of each piece's own points, search
    all its rows. Of a piece of more than `hold` rows the tree stays and the other rows pass by, a batch at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    key, forest = None, None                                # the piece whose rows pass by
    for batch in batches:
        part = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False),
                batch.column(3).to_numpy().view(np.uint64))
        if forest is not None:
            end = int(np.argmin(np.append((part[0] == key[0]) & (part[1] == key[1]), False)))
            if end:
                x, y = forest.touched(part[3][:end])
                yield _ordered([x], [y])
            if end == len(part[0]):
                continue
            part, forest = tuple(c[end:] for c in part), None
        if not len(part[0]):
            continue
        held.append(part)
        key = part[0][-1], part[1][-1]
        rows = tuple(np.concatenate(c) for c in zip(*held)) if len(held) > 1 else part
        done = len(rows[0]) - int(np.argmin(np.append(((rows[0] == key[0]) & (rows[1] == key[1]))[::-1], False)))
        if done:
            yield _closed(tuple(c[:done] for c in rows), radius)
        rest = tuple(c[done:] for c in rows)
        held = [rest]
        if len(rest[0]) > hold and not rest[2][-1]:
            forest, held = Forest(rest[3][rest[2]], radius), []
            (a, b), (x, y) = forest.inside(), forest.touched(rest[3][~rest[2]])
            yield _ordered([a, x], [b, y])
    if held:
        yield _closed(held[0], radius)


def links(points: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree: int = TREE) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`, enough to connect all pairs at most `radius` bits apart.

    The 64 bits are cut into `blocks` parts. Two fingerprints within the radius differ in at most `radius` parts, so they agree on
    some choice of blocks - radius of them: each choice and its bits name a shard. A shard is a BK-tree, or several of at most
    about `tree` points each, which all fingerprints of the shard search; trees go to the tasks by shuffle, none through the driver.
    """
    if blocks <= radius:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in pick) for pick in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "bits")
    dealt = points.select("fp", each).select("fp", F.xxhash64("choice", "bits").alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / tree).cast("int")
    rows = join_on(dealt, sizes, ["shard"]).withColumn("pieces", pieces)
    rows = rows.withColumn("home", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("shard", "piece", (F.col("home") == F.col("piece")).alias("own"), "fp")
    return rows.repartition("shard", "piece").sortWithinPartitions("shard", "piece", F.desc("own")).mapInArrow(
        lambda b: link_batches(b, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge, root the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris and others 2014): neighbours of a node are linked to the smallest of
    them, never to each other, until nothing changes. Each step is written to the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = join_on(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_on(large, down, ["a"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = saved(small.where("a != b").distinct())
        moved = new.exceptAll(now).limit(1).count()
        now = new
        if not moved:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, group (a fingerprint shared by all documents that links reach) and component_id (smallest doc_id there).

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows share a fingerprint and are all
    returned. A null id never becomes the smallest unless a group has no other. An empty table gives none.
    """
    prints = saved(fingerprints(docs))
    points = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(points.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = saved(join_on(points, roots, ["fp"], "left").withColumn("group", F.coalesce("root", "fp")))
    lows = named.groupBy("group").agg(F.min("low").alias("component_id"))
    by_print = join_on(named.select("fp", "group"), lows, ["group"])
    return join_on(prints, by_print, ["fp"]).select("doc_id", "fp", "group", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group, with the columns of `docs`: the smallest id (null last), of repeated ids the text of smallest hash.

    A row is named by id and text, so several texts of one id are kept apart; equal rows count once; null and empty texts are one
    group with fingerprint zero; an empty table gives none.
    """
    columns = fresh(docs, "key", "text_hash")
    key, text_hash = columns
    rows = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(text_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = rows.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("doc_id"), F.col(text_hash).alias("text_hash")).alias("name"), "text")
    prints = saved(named.mapInArrow(lambda b: named_batches(b), f"name {named.schema['name'].dataType.simpleString()}, fp bigint"))
    points = saved(prints.select("fp").distinct())
    roots = components(links(points, radius)).withColumnRenamed("node", "fp")
    groups = join_on(points, roots, ["fp"], "left").select("fp", F.coalesce("root", "fp").alias("group"))
    first = prints.groupBy("fp").agg(F.min("name").alias("name"))                      # a group's copies meet as their smallest name
    best = join_on(first, groups, ["fp"]).groupBy("group").agg(F.min("name").alias("name"))
    kept = best.select(F.col("name.doc_id").alias(key), F.col("name.text_hash").alias(text_hash))
    return join_on(rows, kept, columns, "left_semi").dropDuplicates(columns).select(*docs.columns)
