"""Mixing sources to target weights: a min-cost flow routes token capacity of membership patterns to source quotas."""
from __future__ import annotations

from collections import deque
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, join_on, running_total, saved

WEIGHTS, SHARE, REPEATS, SEED, MAX_PATTERNS = (5, 2, 1), 1.5, 2, 17, 100_000


def n_words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def by_code_point(name: str | None) -> tuple[bool, str]:
    return name is None, name or ""


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = REPEATS) -> dict[str | None, float]:
    """Quotas: `share` of all sizes by weight, weights repeating over the sources in code-point order, null last.

    A quota stops at `most` times its source's size; the excess goes to the others by weight until none is above.
    """
    weight = dict(zip(sorted(sizes, key=by_code_point), cycle(weights)))
    quota, open_ = {}, set(sizes)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            quota |= {s: left * weight[s] / total for s in open_}
            break
        quota |= {s: float(most * sizes[s]) for s in full}
        left -= sum(quota[s] for s in full)
        open_ -= full
    return quota


def cheapest_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> dict[tuple[int, str | None], int]:
    """Words that each pattern (members, words) sends to each of its members; the k-th use of a word costs k squared.

    Successive shortest paths over the graph start -> pattern (one arc per repetition) -> member -> end. Its size follows the
    number of patterns and sources, not of documents. Every unit takes the cheapest way left, earlier routes are re-routed.
    """
    names = sorted({m for members, _ in patterns for m in members}, key=by_code_point)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    head: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, price = [], [], []

    def arc(a: int, b: int, cap: int, cost: int) -> int:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((cap, 0))
        price.extend((cost, -cost))
        return len(to) - 2
    routes = {}
    for i, (members, words) in enumerate(patterns):
        for k in range(1, repeats + 1):
            arc(0, 1 + i, words, k * k)
        for s in dict.fromkeys(members):
            routes[i, s] = arc(1 + i, node[s], repeats * words, 0)
    for s in names:
        arc(node[s], end, int(round(quotas.get(s, 0.0))), 0)
    while True:
        dist, came, queue, queued = [None] * (end + 1), [0] * (end + 1), deque([0]), {0}
        dist[0] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in head[a]:
                if room[e] and (dist[to[e]] is None or dist[a] + price[e] < dist[to[e]]):
                    dist[to[e]], came[to[e]] = dist[a] + price[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if dist[end] is None:
            break
        path, at = [], end
        while at:
            path.append(came[at])
            at = to[came[at] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {key: room[e ^ 1] for key, e in routes.items()}


def plan(digest: DataFrame, quotas: dict, repeats: int = REPEATS) -> DataFrame:
    """How often each row is taken. `digest` has key, members (array of sources), size, u (a seeded hash of the row).

    Rows stand in seeded order within their membership pattern; the flow out of a pattern is laid along that line, once per
    repetition, and a row is taken where at least half of it is covered. Then the one row whose size best fits what is
    missing (or too much) is added (or removed). Adds `copies`.
    """
    spark = digest.sparkSession
    pattern = F.when(F.col("members").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct("members")))
    rows = digest.withColumn("members", pattern).withColumn("__chunk", F.shiftrightunsigned("u", 52))
    placed = saved(running_total(rows, ["members"], "__chunk", ["u", "key", "size"], "size", "__before"))
    sums = placed.groupBy("members").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: the flow network is built on the driver")
    sums = sorted(((tuple(r.members), r.words) for r in sums), key=lambda p: [by_code_point(m) for m in p[0]])
    flow = cheapest_flow(sums, quotas, repeats)
    sent = [(list(members), words, sum(flow[i, s] for s in set(members))) for i, (members, words) in enumerate(sums)]
    schema = T.StructType([T.StructField("members", T.ArrayType(T.StringType())), T.StructField("__words", T.LongType()),
                           T.StructField("__flow", T.LongType())])
    lines = spark.createDataFrame(sent, schema)
    middle = F.col("__before") + F.col("size") / 2
    uses = [F.when((F.col("size") > 0) & (middle + k * F.col("__words") < F.col("__flow")), 1).otherwise(0) for k in range(repeats)]
    laid = join_on(placed, lines, ["members"]).withColumn("copies", sum(uses[1:], uses[0]))
    missing = laid.groupBy("members").agg((F.first("__flow") - F.sum(F.col("copies") * F.col("size"))).alias("__missing"))
    open_ = join_on(laid, missing, ["members"])
    misfit = F.abs(F.abs("__missing") - F.col("size"))
    fits = ((F.col("__missing") > 0) & (F.col("copies") < repeats) | (F.col("__missing") < 0) & (F.col("copies") > 0)) & \
        (misfit < F.abs("__missing"))
    best = open_.where(fits).groupBy("members").agg(
        F.min(F.struct(misfit.alias("misfit"), "__chunk", "nth", F.signum("__missing").cast("int").alias("step"))).alias("b"))
    best = best.select("members", F.col("b.__chunk").alias("__c"), F.col("b.nth").alias("__n"), F.col("b.step").alias("__step"))
    out = join_on(laid, best, ["members"], "left")
    mine = (F.col("__chunk") == F.col("__c")) & (F.col("nth") == F.col("__n"))
    return out.withColumn("copies", F.col("copies") + F.when(mine, F.col("__step")).otherwise(0)).select(*digest.columns, "copies")


def digest_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """key, members, size and u of documents that have one source each."""
    return docs.select(F.col("doc_id").alias("key"), F.array("source").alias("members"), n_words(F.col("text")).alias("size"),
                       F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("u"))


def source_sizes(digest: DataFrame) -> dict[str | None, int]:
    """Words of each source; the list of sources is what weights are given for and is bounded like the patterns."""
    rows = digest.select(F.explode_outer("members").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    return {r.s: r.n for r in rows}


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (0 to 2) of every document, repeated rows included.

    Null text: size 0, never taken. Null source: a source of its own, last in order. Equal seeds give equal results.
    An empty table gives none. Other columns are ignored.
    """
    digest = saved(digest_of(docs, seed))
    sizes = source_sizes(digest)
    quotas = targets(sizes)
    taken = plan(digest, quotas)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()),
                           T.StructField("target", T.DoubleType())])
    known = docs.sparkSession.createDataFrame([(s, sizes[s], float(quotas[s])) for s in sizes], schema)
    return join_on(taken.withColumn("source", F.col("members")[0]), known, ["source"]).select(
        F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "copies", "u")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix themselves, each row as often as it is taken, with the columns of `docs`, whatever their names.

    Null texts are never taken; the copies of repeated rows are dealt evenly among them; an empty table gives none."""
    takes = mix(docs, seed).groupBy("doc_id", "u").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    # The document travels as one struct, so its own column names cannot clash with these.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("u"))
    rows = join_on(keyed, takes, ["doc_id", "u"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "u").orderBy("u"))
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return rows.withColumn("each", share).where("each > 0").withColumn("each", F.explode(F.expr("sequence(1, each)"))).select("row.*")
