"""Tracklets: building, joining, teams, keepers, officials, and writing identity back to the rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import assign_edges
from ..functions.batches import whole_groups
from ..functions.components import components
from ..functions.joins import by_exchange
from ..functions.ordered import Ordered, running_sum
from ..sources.scratch import cut_lineage, written
from ..functions.vectors import cosine_distance
from ..schema import (AWAY, BALL, FPS, GOALKEEPER, HOME, OTHER, PITCH_LENGTH, PITCH_WIDTH, REFEREE, UNKNOWN)

ID = ["match_id", "tracklet_id"]
EDGES_PER_TASK = 1 << 20       # fixed value: edges of a match that a task holds at once, some 100 MB


def build_tracklets(tracks: DataFrame, embeddings: DataFrame | None = None, fps: float = FPS, tail: int = 10) -> DataFrame:
    """One tracklet per non-ball track: span, end points, exit velocity from its last rows, role."""
    p = tracks.filter(F.col("role") != BALL).select("match_id", F.col("track_id").alias("tracklet_id"), "frame_idx",
                                                    "role", "x", "y")
    pt = F.struct("frame_idx", "x", "y")
    g = p.groupBy(*ID).agg(F.count(F.lit(1)).alias("n_frames"), F.min_by(pt, "frame_idx").alias("a"),
                           F.max_by(pt, "frame_idx").alias("z"), F.mode("role", True).alias("role"))
    # Top rows per key: each map task keeps its own last rows, so a long track is not gathered.
    w = Window.partitionBy(*ID).orderBy(F.desc("frame_idx"))
    last = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= tail + 1)
    back = last.groupBy(*ID).agg(F.min_by(pt, "frame_idx").alias("t"))
    g = g.join(back, ID)
    dt = F.greatest((F.col("z.frame_idx") - F.col("t.frame_idx")) / fps, F.lit(1e-6))
    v = lambda c: F.when(F.col("n_frames") < 2, 0.0).otherwise((F.col(f"z.{c}") - F.col(f"t.{c}")) / dt)
    out = g.select(
        *ID, F.array("tracklet_id").alias("track_ids"), F.col("a.frame_idx").alias("start"), F.col("z.frame_idx").alias("end"),
        F.col("a.x").alias("sx"), F.col("a.y").alias("sy"), F.col("z.x").alias("ex"), F.col("z.y").alias("ey"),
        v("x").alias("vx"), v("y").alias("vy"), "n_frames", "role", F.lit(UNKNOWN).alias("team"),
        F.lit(None).cast("int").alias("jersey"), F.lit(0.0).alias("team_score"),
        F.expr("cast(map() as map<int,double>)").alias("votes"), F.lit(0).cast("long").alias("reads"))
    if embeddings is None:
        return out.withColumn("embedding", F.lit(None).cast("array<double>"))
    e = embeddings.select("match_id", F.col("track_id").alias("tracklet_id"), F.col("embedding").cast("array<double>"))
    return out.join(by_exchange(e), ID, "left")


def members(tracklets: DataFrame, *cols: str) -> DataFrame:
    """(match, track) -> tracklet, with the tracklet columns asked for."""
    return tracklets.select("match_id", "tracklet_id", *cols, F.explode("track_ids").alias("track_id"))


def _add_votes(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))


def add_jersey_reads(tracklets: DataFrame, reads: DataFrame) -> DataFrame:
    """Sum read confidence per number onto the tracklet that owns the track; null numbers are skipped."""
    r = reads.filter(F.col("number").isNotNull()).join(members(tracklets), ["match_id", "track_id"])
    per = r.groupBy(*ID, "number").agg(F.sum("confidence").alias("c"), F.count(F.lit(1)).alias("k"))
    v = per.groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("number", "c"))).alias("_v"), F.sum("k").alias("_k"))
    j = tracklets.join(v, ID, "left")
    return (j.withColumn("votes", F.when(F.col("_v").isNull(), F.col("votes")).otherwise(_add_votes(F.col("votes"), F.col("_v"))))
            .withColumn("reads", F.col("reads") + F.coalesce("_k", F.lit(0))).select(*tracklets.columns))


def best_jersey(prefix: str = "") -> tuple[Column, Column, Column]:
    """(leading number, its share of the evidence, reads); the lowest number wins a tie."""
    votes, reads = F.col(f"{prefix}votes"), F.col(f"{prefix}reads")
    top = F.array_max(F.transform(F.map_entries(votes), lambda e: F.struct(e["value"].alias("w"), (-e["key"]).alias("k"))))
    total = F.aggregate(F.map_values(votes), F.lit(0.0), lambda acc, v: acc + v)
    return -top["k"], F.coalesce(top["w"] / F.nullif(total, F.lit(0.0)), F.lit(0.0)), F.coalesce(reads, F.lit(0))


def candidate_successors(tracklets: DataFrame, fps: float = FPS, max_gap_s: float = 2.0, max_speed: float = 9.0,
                         tolerance_m: float = 2.0, weight: float = 8.0, max_cos: float = 0.45,
                         jersey_veto: bool = True, min_share: float = 0.7, min_reads: int = 2) -> DataFrame:
    """Pairs (a, b) where b may continue a, with the cost of saying so.

    A gap is at most `max_gap_s`, so a start-time bucket of that width turns the range join into an
    equi-join of neighbours in time."""
    width = max(int(max_gap_s * fps), 1)
    na, sa, ra = best_jersey()
    t = tracklets.withColumn("_num", na).withColumn("_sure", (sa >= min_share) & (ra >= min_reads))
    cols = ("tracklet_id", "start", "end", "sx", "sy", "ex", "ey", "vx", "vy", "embedding", "_num", "_sure")
    a = t.select("match_id", F.struct(*cols).alias("a")).withColumn("_b", F.explode(F.array(
        F.floor(F.col("a.end") / width), F.floor(F.col("a.end") / width) + 1)))
    b = t.select("match_id", F.struct(*cols).alias("b"), F.floor(F.col("start") / width).alias("_b"))
    j = a.join(b, ["match_id", "_b"]).filter((F.col("b.start") > F.col("a.end"))
                                            & (F.col("a.tracklet_id") != F.col("b.tracklet_id")))
    gap = (F.col("b.start") - F.col("a.end")) / fps
    jump = F.hypot(F.col("b.sx") - F.col("a.ex"), F.col("b.sy") - F.col("a.ey"))
    j = j.filter((gap <= max_gap_s) & (jump <= max_speed * gap + tolerance_m))
    if jersey_veto:
        clash = F.col("a._sure") & F.col("b._sure") & (F.col("a._num") != F.col("b._num"))
        j = j.filter(~F.coalesce(clash, F.lit(False)))
    cos = cosine_distance(F.col("a.embedding"), F.col("b.embedding"))
    j = j.withColumn("_cos", F.when(F.col("a.embedding").isNotNull() & F.col("b.embedding").isNotNull(), cos))
    j = j.filter(F.col("_cos").isNull() | (F.col("_cos") <= max_cos))
    miss = F.hypot(F.col("b.sx") - (F.col("a.ex") + F.col("a.vx") * gap), F.col("b.sy") - (F.col("a.ey") + F.col("a.vy") * gap))
    return j.select("match_id", F.col("a.tracklet_id").alias("a"), F.col("b.tracklet_id").alias("b"),
                    F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), F.col("b.start").alias("b_start"),
                    (miss + weight * F.coalesce("_cos", F.lit(0.0))).alias("cost"))


def _best_pairs(edges: DataFrame) -> DataFrame:
    """Optimal one-to-one successors: most pairs, then least cost. Edges compete only inside a connected component of
    the graph of ends and starts; components are found on Spark and dealt over tasks, each solved on its edge list."""
    ends = components(edges.select("match_id", (2 * F.col("a")).alias("a"), (2 * F.col("b") + 1).alias("b")), ["match_id"])
    e = (edges.withColumn("node", 2 * F.col("a")).join(ends, ["match_id", "node"])
         .select("match_id", "component", "a", "b", "a_start", "a_end", "cost"))

    def solve(batches):
        for df, cuts in whole_groups(batches, ["match_id", "component"]):
            a, b, cost = (df[c].to_numpy() for c in ("a", "b", "cost"))
            keep = [i + assign_edges(a[i:j], b[i:j], cost[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
            yield df.iloc[np.concatenate(keep)]
    return (e.repartition("match_id", "component").sortWithinPartitions("match_id", "component", "a_end", "a", "b")
            .mapInPandas(solve, e.schema))


def _pairs_by_match(edges: DataFrame) -> DataFrame:
    """`_alternate` of `_best_pairs`, matches whole: one pass over tasks that hold a match's edges at a time."""
    def solve(batches):
        for df, cuts in whole_groups(batches, ["match_id"]):
            a, b, start, cost = (df[c].to_numpy() for c in ("a", "b", "a_start", "cost"))
            keep = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                joined = set()                          # tracklets just joined to their own predecessor
                got = i + assign_edges(a[i:j], b[i:j], cost[i:j])
                for k in got[np.lexsort((a[got], start[got]))].tolist():
                    if a[k] not in joined:
                        joined.add(b[k])
                        keep.append(k)
            yield df.iloc[keep]
    return (edges.repartition("match_id").sortWithinPartitions("match_id", "a_end", "a", "b")
            .mapInPandas(solve, edges.schema))


def stitch_tracklets(tracklets: DataFrame, fps: float = FPS, **gates) -> DataFrame:
    """Join fragments across short gaps until no pair is left; a written table per pass. Every pass has fewer tracklets.

    Matches whose edges fit a task are solved whole there; with a larger one, Spark finds the connected components first."""
    work = cut_lineage(tracklets)
    while True:
        edges = cut_lineage(candidate_successors(work, fps, **gates))
        most = edges.groupBy("match_id").count().agg(F.max("count")).first()[0]
        if most is None:
            break
        pairs = _pairs_by_match(edges) if most <= EDGES_PER_TASK else _alternate(cut_lineage(_best_pairs(edges)))
        work = cut_lineage(_merge_pairs(work, cut_lineage(pairs)))
    return work


def _alternate(pairs: DataFrame) -> DataFrame:
    """Every other pair along a chain of successors, from its start: a pair whose first tracklet was just joined to
    its own predecessor waits for the next pass."""
    chain = components(pairs, ["match_id"]).withColumnRenamed("node", "a").withColumnRenamed("component", "_chain")
    p = pairs.join(chain, ["match_id", "a"])
    o = Ordered(p, ["match_id", "_chain"], ["a_start", "a"]).add(_i=running_sum(F.lit(1))).done()
    return o.filter(F.col("_i") % 2 == 1).select(*pairs.columns)


def _merge_pairs(t: DataFrame, pairs: DataFrame) -> DataFrame:
    p = pairs.select("match_id", F.col("a").alias("tracklet_id"), F.col("b").alias("_next"))
    nxt = t.select("match_id", F.col("tracklet_id").alias("_next"), F.struct(*[c for c in t.columns if c not in ID]).alias("q"))
    gone = p.select("match_id", F.col("_next").alias("tracklet_id"))
    j = t.join(gone, ID, "left_anti").join(p, ID, "left").join(nxt, ["match_id", "_next"], "left")
    has = F.col("q").isNotNull()
    take = lambda c: F.when(has, F.col(f"q.{c}")).otherwise(F.col(c)).alias(c)
    n, m = F.col("n_frames"), F.col("q.n_frames")
    blended = F.zip_with("embedding", F.col("q.embedding"), lambda a, b: (n * a + m * b) / (n + m))
    emb = (F.when(~has | F.col("q.embedding").isNull(), F.col("embedding"))
           .when(F.col("embedding").isNull(), F.col("q.embedding")).otherwise(blended))
    changed = {
        "track_ids": F.when(has, F.concat("track_ids", F.col("q.track_ids"))).otherwise(F.col("track_ids")).alias("track_ids"),
        **{c: take(c) for c in ("end", "ex", "ey", "vx", "vy")},
        "n_frames": (n + F.coalesce(m, F.lit(0))).alias("n_frames"), "embedding": emb.alias("embedding"),
        "votes": F.when(has, _add_votes(F.col("votes"), F.col("q.votes"))).otherwise(F.col("votes")).alias("votes"),
        "reads": (F.col("reads") + F.coalesce(F.col("q.reads"), F.lit(0))).alias("reads")}
    return j.select(*[changed.get(c, F.col(c)) for c in t.columns])


def merge_by_jersey(tracklets: DataFrame, min_share: float = 0.7, min_reads: int = 3, max_cos: float = 0.45,
                    use_team: bool = True) -> DataFrame:
    """Join tracklets that confidently carry one team's same number, strongest first; never two that
    overlap in time or look different."""
    num, share, reads = best_jersey()
    t = tracklets.withColumn("_num", num).withColumn("_power", share * reads).withColumn(
        "_ok", F.col("_num").isNotNull() & (share >= min_share) & (reads >= min_reads))
    key = F.col("team") if use_team else F.lit("")
    g = t.filter("_ok").select("match_id", key.alias("side"), "_num", "tracklet_id", "start", "end", "embedding", (-F.col("_power")).alias("w"))

    def run(batches):
        for df, cuts in whole_groups(batches, ["match_id", "side", "_num"]):
            target = np.zeros(len(df), "int64")
            for i, j in zip(cuts[:-1], cuts[1:]):
                held = []       # id, intervals' outer span, unit embedding of each identity so far
                for k in range(i, j):
                    row = df.iloc[k]
                    e = row["embedding"]
                    e = None if e is None else np.asarray(e, float) / max(np.linalg.norm(e), 1e-9)
                    for h in held:
                        if not (h[2] < row["start"] or row["end"] < h[1]):
                            continue
                        if e is not None and h[3] is not None and 1 - float(e @ h[3]) > max_cos:
                            continue
                        target[k] = h[0]
                        h[1], h[2] = min(h[1], row["start"]), max(h[2], row["end"])
                        break
                    else:
                        target[k] = row["tracklet_id"]
                        held.append([row["tracklet_id"], row["start"], row["end"], e])
            yield pd.DataFrame({"match_id": df["match_id"], "tracklet_id": df["tracklet_id"], "_num": df["_num"], "target": target,
                                "ord": np.arange(len(df))})
    where = (g.repartition("match_id", "side", "_num").sortWithinPartitions("match_id", "side", "_num", "w", "start", "tracklet_id")
             .mapInPandas(run, "match_id string, tracklet_id int, _num int, target int, ord long"))
    j = tracklets.join(where, ID, "left").withColumn("target", F.coalesce("target", "tracklet_id"))
    own = F.col("tracklet_id") == F.col("target")
    keep = [c for c in tracklets.columns if c not in ID + ["track_ids", "start", "end", "sx", "sy", "ex", "ey", "vx", "vy", "n_frames", "votes", "reads", "jersey"]]
    entries = F.flatten(F.collect_list(F.map_entries("votes")))
    m = j.groupBy("match_id", "target").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct((~own).cast("int").alias("o"), "ord", "track_ids"))), lambda s: s["track_ids"])).alias("track_ids"),
        F.min(F.struct("start", "sx", "sy")).alias("a"), F.max(F.struct("end", "ex", "ey", "vx", "vy")).alias("z"),
        F.sum("n_frames").alias("n_frames"), entries.alias("v"), F.sum("reads").alias("reads"), F.max("_num").alias("_num"),
        F.max(F.when(own, F.struct(*keep, F.col("jersey").alias("_j")))).alias("k"))
    numbers = F.array_distinct(F.transform("v", lambda e: e["key"]))
    votes = F.map_from_arrays(numbers, F.transform(numbers, lambda n: F.aggregate(
        F.filter("v", lambda e: e["key"] == n), F.lit(0.0), lambda acc, e: acc + e["value"])))
    built = {"tracklet_id": F.col("target"), "votes": votes, "jersey": F.coalesce("_num", "k._j"),
             **{c: F.col(f"a.{c}") for c in ("start", "sx", "sy")}, **{c: F.col(f"z.{c}") for c in ("end", "ex", "ey", "vx", "vy")},
             **{c: F.col(f"k.{c}") for c in keep}}
    return m.select(*[built.get(c, F.col(c)).alias(c) for c in tracklets.columns])


def assign_teams_with_roster(tracklets: DataFrame, team_size: int = 11, min_frames: int = 25) -> DataFrame:
    """Surest tracklets first, each to its preferred side unless more of its frames are over quota
    there. A match's tracklets stream in that order; the state is a head count per frame."""
    c = tracklets.filter((F.col("n_frames") >= min_frames) & (F.col("role") != BALL)).select(
        "match_id", "tracklet_id", "start", "end", "team_score", F.abs("team_score").alias("sure"))

    def run(batches):
        match, load = None, None
        for df in batches:
            out = []
            for m, s, e, score in zip(df["match_id"], df["start"], df["end"], df["team_score"]):
                if m != match:
                    match, load = m, np.zeros((2, 0), "int32")
                if e >= load.shape[1]:
                    load = np.pad(load, ((0, 0), (0, max(e + 1, 2 * load.shape[1]) - load.shape[1])))
                over = (load[:, s:e + 1] >= team_size).mean(axis=1)
                pref = int(score > 0)
                side = pref if over[pref] <= over[1 - pref] else 1 - pref
                load[side, s:e + 1] += 1
                out.append(AWAY if side else HOME)
            yield pd.DataFrame({"match_id": df["match_id"], "tracklet_id": df["tracklet_id"], "_team": out})
    got = (c.repartition("match_id").sortWithinPartitions("match_id", F.desc("sure"), "start", "tracklet_id")
           .mapInPandas(run, "match_id string, tracklet_id int, _team string"))
    return (tracklets.join(got, ID, "left").withColumn("team", F.coalesce("_team", "team")).select(*tracklets.columns))


def touchline_people(tracks: DataFrame, tracklets: DataFrame, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH,
                     on_line_m: float = 0.5, min_share: float = 0.8, min_frames: int = 25, moving_m: float = 5.0) -> DataFrame:
    """Tracklets that live on the boundary: referee when they travel along it, else other."""
    on = (F.abs("y") >= width / 2 - on_line_m) | (F.abs("x") >= length / 2 - on_line_m)
    g = tracks.join(by_exchange(members(tracklets)), ["match_id", "track_id"]).groupBy(*ID).agg(
        F.count(F.lit(1)).alias("n"), F.avg(on.cast("double")).alias("share"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    g = g.filter((F.col("n") >= min_frames) & (F.col("share") >= min_share))
    return g.select(*ID, F.when(F.col("span") > moving_m, REFEREE).otherwise(OTHER).alias("line_role"))


def frame_extremes(tracks: DataFrame) -> DataFrame:
    """Every row with the lowest and highest x of its frame."""
    w = Window.partitionBy("match_id", "frame_idx")
    return tracks.withColumn("frame_min_x", F.min("x").over(w)).withColumn("frame_max_x", F.max("x").over(w))


def goalkeeper_tracklets(tracks: DataFrame, tracklets: DataFrame, length: float = PITCH_LENGTH, box_depth: float = 16.5,
                         box_half_width: float = 20.16, min_frames: int = 25, min_in_box: float = 0.9,
                         min_deepest: float = 0.7) -> DataFrame:
    """Tracklets that keep goal, with the end they guard: -1 left, +1 right, left tested first."""
    df = frame_extremes(tracks.join(by_exchange(members(tracklets)), ["match_id", "track_id"]))
    edge, wide = length / 2 - box_depth, F.abs("y") <= box_half_width
    share = lambda c: F.avg(c.cast("double"))
    g = df.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("n"), share((F.col("x") <= -edge) & wide).alias("lb"), share((F.col("x") >= edge) & wide).alias("rb"),
        share(F.col("x") <= F.col("frame_min_x")).alias("ld"), share(F.col("x") >= F.col("frame_max_x")).alias("rd"))
    at = lambda b, d: (F.col(b) >= min_in_box) & (F.col(d) >= min_deepest)
    g = g.filter(F.col("n") >= min_frames).withColumn("end", F.when(at("lb", "ld"), -1).when(at("rb", "rd"), 1))
    return g.filter(F.col("end").isNotNull()).select(*ID, "end")


def goalkeeper_teams(tracks: DataFrame, tracklets: DataFrame, keepers: DataFrame) -> DataFrame:
    """Each keeper's team: the one whose other players stand nearer that end. Empty when undecidable."""
    others = members(tracklets.join(keepers.select(*ID), ID, "left_anti"), "team").withColumnRenamed("team", "_team")
    df = tracks.join(by_exchange(others), ["match_id", "track_id"])
    mean = lambda t: F.avg(F.when(F.col("_team") == t, F.col("x")))
    m = df.groupBy("match_id").agg(mean(HOME).alias("h"), mean(AWAY).alias("a")).filter(
        F.col("h").isNotNull() & F.col("a").isNotNull() & (F.col("h") != F.col("a")))
    left = F.when(F.col("h") < F.col("a"), HOME).otherwise(AWAY)
    right = F.when(F.col("h") < F.col("a"), AWAY).otherwise(HOME)
    return keepers.join(m, "match_id").select(*ID, F.when(F.col("end") < 0, left).otherwise(right).alias("keeper_team"))


def apply_identity(tracks: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Rows take their tracklet's id, team, role and (when known) jersey; other rows keep theirs."""
    m = members(tracklets, F.col("team").alias("_team"), F.col("role").alias("_role"), F.col("jersey").alias("_jersey"))
    j = tracks.join(by_exchange(m.withColumnRenamed("tracklet_id", "_id")), ["match_id", "track_id"], "left")
    new = {"track_id": F.coalesce("_id", "track_id"), "team": F.coalesce("_team", "team"), "role": F.coalesce("_role", "role"),
           "jersey": F.coalesce(F.col("_jersey").cast("double"), F.col("jersey"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in tracks.columns])


def resolve_identity(tracks: DataFrame, embeddings: DataFrame, fps: float = FPS, length: float = PITCH_LENGTH,
                     width: float = PITCH_WIDTH, roster: int = 11) -> DataFrame:
    """Role vote, stitching, kit sides, officials, roster quota, keepers, then identity on the rows.

    `embeddings` has one mean kit descriptor per (match, track) and its row count `n`."""
    from .ball import interpolate_ball
    from .kinematics import add_kinematics
    from .quality import resolve_roles
    from .teams import split_officials, team_scores_by_track
    tracks, embeddings = written(resolve_roles(tracks, min_frames=0)), written(embeddings)      # each is read several times
    t = stitch_tracklets(build_tracklets(tracks, embeddings, fps), fps)
    scores = members(t).join(by_exchange(team_scores_by_track(embeddings)), ["match_id", "track_id"], "left").groupBy(*ID).agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("_s"))
    t = t.join(scores, ID, "left").withColumn("team_score", F.coalesce("_s", F.lit(0.0))).drop("_s")
    official = members(t).join(by_exchange(split_officials(embeddings)), ["match_id", "track_id"]).select(*ID).distinct().withColumn("_o", F.lit(True))
    t = t.join(official, ID, "left").join(touchline_people(tracks, t, length, width), ID, "left")
    kind = F.when(F.col("_o") | (F.col("line_role") == REFEREE), REFEREE).when(F.col("line_role") == OTHER, OTHER)
    t = cut_lineage(t.withColumn("_kind", kind).drop("_o", "line_role"))
    people = assign_teams_with_roster(t.filter("_kind is null").drop("_kind"), roster)
    keepers = goalkeeper_tracklets(tracks, people, length)
    k = goalkeeper_teams(tracks, people, keepers)
    people = (people.join(k, ID, "left").withColumn("role", F.when(F.col("keeper_team").isNotNull(), GOALKEEPER).otherwise(F.col("role")))
              .withColumn("team", F.coalesce("keeper_team", "team")).drop("keeper_team"))
    side = t.filter("_kind is not null").withColumn("role", F.col("_kind")).withColumn(
        "team", F.when(F.col("_kind") == REFEREE, "official").otherwise(UNKNOWN)).drop("_kind")
    return add_kinematics(interpolate_ball(apply_identity(tracks, people.unionByName(side)), fps), fps)
