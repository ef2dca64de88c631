"""Accuracy of predictions against ground truth; clips are pooled from rows, never from averages."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..functions.joins import by_exchange
from ..functions.quantiles import exact_percentiles
from ..schema import AWAY, BALL, GOALKEEPER, HOME, PLAYING, REFEREE, TEAMS, finite
from .matching import id_switches, match_people_gated

SIDE_OF_TRUTH = {HOME: "left", AWAY: "right"}
SIDES = ("left", "right")


def _truth_side(col: str):
    return F.when(F.col(col) == HOME, "left").when(F.col(col) == AWAY, "right")


def team_sides(tracks: DataFrame) -> DataFrame:
    """(match, team) -> the goal it defends, from keepers' mean x, else the team's."""
    p = tracks.filter(F.col("role").isin(*PLAYING) & F.col("team").isin(*TEAMS))
    keeper = F.col("role") == GOALKEEPER
    g = p.groupBy("match_id", "team").agg(F.coalesce(F.avg(F.when(keeper, F.col("x"))), F.avg("x")).alias("at"))
    g = g.groupBy("match_id").agg(F.max(F.when(F.col("team") == HOME, F.col("at"))).alias("h"),
                                  F.max(F.when(F.col("team") == AWAY, F.col("at"))).alias("a"))
    both = F.col("h").isNotNull() & F.col("a").isNotNull()
    lone = lambda c: F.when(F.col(c) < 0, "left").otherwise("right")
    home = F.when(both, F.when(F.col("h") <= F.col("a"), "left").otherwise("right")).otherwise(lone("h"))
    away = F.when(both, F.when(F.col("h") <= F.col("a"), "right").otherwise("left")).otherwise(lone("a"))
    rows = F.array_compact(F.array(
        F.when(F.col("h").isNotNull(), F.struct(F.lit(HOME).alias("team"), home.alias("side"))),
        F.when(F.col("a").isNotNull(), F.struct(F.lit(AWAY).alias("team"), away.alias("side")))))
    return g.select("match_id", F.explode(rows).alias("r")).select("match_id", "r.*")


def side_accuracy(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Per match: matched people (and keepers) on their true side."""
    s = sides.select("match_id", F.col("team").alias("pred_team"), F.col("side").alias("_side"))
    p = pairs.withColumn("_truth", _truth_side("gt_team")).filter(F.col("_truth").isNotNull())
    p = p.join(s, ["match_id", "pred_team"], "left")
    ok, keeper = F.coalesce(F.col("_side") == F.col("_truth"), F.lit(False)), F.col("gt_role") == GOALKEEPER
    return p.groupBy("match_id").agg(
        F.count(F.when(ok, 1)).alias("ok"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(ok & keeper, 1)).alias("keeper_ok"), F.count(F.when(keeper, 1)).alias("keeper_n"))


def team_accuracy(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    return side_accuracy(pairs, sides).select("match_id", share("ok", "n").alias("team_accuracy"))


def keeper_side_accuracy(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    return side_accuracy(pairs, sides).select("match_id", "keeper_ok", "keeper_n")


def share(ok, n):
    return F.round(F.col(ok) / F.nullif(F.col(n), F.lit(0)), 4)


def role_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("match_id", "gt_role", "pred_role").agg(F.count(F.lit(1)).alias("n"))


def role_summary(counts: DataFrame, by=("match_id",)) -> DataFrame:
    g, p = F.col("gt_role"), F.col("pred_role")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    ratio = lambda a, b: F.round(n(a) / F.nullif(n(b), F.lit(0)), 4)
    both = lambda r: (g == r) & (p == r)
    return counts.groupBy(*by).agg(
        ratio(both(GOALKEEPER), g == GOALKEEPER).alias("keeper_recall"),
        ratio(both(REFEREE), g == REFEREE).alias("referee_recall"),
        ratio(both(REFEREE), p == REFEREE).alias("referee_precision"))


def position_summary(pairs: DataFrame, gt: DataFrame, by=("match_id",), match_m: float = 2.0) -> DataFrame:
    """Median and p90 error of matched people, and recall within `match_m` over located ones."""
    by = list(by)
    people = gt.filter(F.col("role").isin(*PLAYING) & finite(F.col("x")) & finite(F.col("y")))
    total = people.groupBy(*by).agg(F.count(F.lit(1)).alias("gt_people"))
    # Finding the pairs may be costly, and three aggregates read their distances: they are counted and written once.
    dists = written(pairs.groupBy(*by, "dist").agg(F.count(F.lit(1)).alias("n")))
    found = dists.groupBy(*by).agg(F.sum(F.when(F.col("dist") <= match_m, F.col("n"))).alias("found"))
    q = exact_percentiles(dists, by, "dist", {"pos_err_median_m": 0.5, "pos_err_p90_m": 0.9}, count="n")
    if by:
        out = total.join(found, by, "left").join(q, by, "left")
    else:
        one = F.lit(0).alias("_k")
        out = (total.select("*", one).join(found.select("*", one), "_k", "left")
               .join(q.select("*", one), "_k", "left"))
    return out.select(*by, F.round("pos_err_median_m", 3).alias("pos_err_median_m"),
                      F.round("pos_err_p90_m", 3).alias("pos_err_p90_m"),
                      F.round(F.coalesce("found", F.lit(0)) / F.col("gt_people"), 4).alias("recall_2m"), "gt_people")


def _centres(tracks: DataFrame) -> DataFrame:
    b = tracks.filter((F.col("role") == BALL) & ~F.col("interpolated") & finite(F.col("bbox_x")))
    return b.groupBy("match_id", "frame_idx").agg(F.max_by(
        F.struct((F.col("bbox_x") + F.col("bbox_w") / 2).alias("u"), (F.col("bbox_y") + F.col("bbox_h") / 2).alias("v")),
        "track_id").alias("c"))


def ball_distances(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pixel distance per ground-truth ball frame; null where there is no predicted box."""
    g = _centres(gt).withColumnRenamed("c", "g")
    p = _centres(pred).withColumnRenamed("c", "p")
    return g.join(p, ["match_id", "frame_idx"], "left").withColumn(
        "px", F.hypot(F.col("g.u") - F.col("p.u"), F.col("g.v") - F.col("p.v")))


def ball_metrics(gt: DataFrame, pred: DataFrame, by=("match_id",), hit_px: float = 20.0) -> DataFrame:
    by = list(by)
    d = ball_distances(gt, pred)
    hit = F.col("px") <= hit_px
    n = F.count(F.lit(1))
    out = d.groupBy(*by).agg(n.alias("gt_frames"), F.count(F.when(hit, 1)).alias("hits"),
                             F.count("px").alias("boxes"))
    med = exact_percentiles(d.filter(hit), by, "px", {"_m": 0.5})
    out = out.join(med, by, "left")
    return out.select(*by, F.round(F.col("hits") / F.col("gt_frames"), 4).alias("ball_recall"),
                      F.round("_m", 2).alias("ball_px_median_hits"),
                      F.round((F.col("boxes") - F.col("hits")) / F.col("gt_frames"), 4).alias("ball_wrong_share"))


def ball_loss(gt: DataFrame, candidates: DataFrame, hit_px: float = 20.0) -> DataFrame:
    """Counts per match: ball frames, frames with a near candidate, with a near kept candidate."""
    g = _centres(gt)
    c = candidates.select("match_id", "frame_idx", "kept", (F.col("bbox_x") + F.col("bbox_w") / 2).alias("u"),
                          (F.col("bbox_y") + F.col("bbox_h") / 2).alias("v"))
    near = F.hypot(F.col("c.u") - F.col("u"), F.col("c.v") - F.col("v")) <= hit_px
    per = g.join(c, ["match_id", "frame_idx"], "left").groupBy("match_id", "frame_idx").agg(
        F.coalesce(F.bool_or(near), F.lit(False)).alias("d"),
        F.coalesce(F.bool_or(near & F.col("kept")), F.lit(False)).alias("k"))
    return per.groupBy("match_id").agg(F.count(F.lit(1)).alias("gt"), F.count(F.when(F.col("d"), 1)).alias("detected"),
                                       F.count(F.when(F.col("k"), 1)).alias("on_pitch"))


def ball_loss_summary(loss: DataFrame) -> DataFrame:
    """Pooled over the matches given."""
    return loss.groupBy().agg(F.sum("gt").alias("gt"), F.sum("detected").alias("detected"),
                              F.sum("on_pitch").alias("on_pitch")).select(
        share("detected", "gt").alias("ball_det_recall"), share("on_pitch", "gt").alias("ball_cand_recall"))


def _located_sides(tracks: DataFrame, sides: DataFrame | None) -> DataFrame:
    p = tracks.filter(F.col("role").isin(*PLAYING) & finite(F.col("x")) & finite(F.col("y")))
    if sides is None:
        return p.withColumn("side", _truth_side("team")).filter(F.col("side").isNotNull())
    # One row per match and team, written: by their true size Spark need not exchange the tracks for them.
    return p.join(written(sides), ["match_id", "team"])


def _shape(tracks: DataFrame, sides: DataFrame | None, prefix: str) -> DataFrame:
    g = _located_sides(tracks, sides).groupBy("match_id", "frame_idx", "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        (F.max("y") - F.min("y")).alias("width"), (F.max("x") - F.min("x")).alias("depth"),
        F.collect_list(F.struct("x", "y")).alias("pts"))
    spread = F.aggregate("pts", F.lit(0.0), lambda acc, q: acc + F.hypot(q["x"] - F.col("cx"), q["y"] - F.col("cy")))
    return g.select("match_id", "frame_idx", "side", F.struct(
        "n", F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), "width", "depth",
        (spread / F.col("n")).alias("compactness")).alias(prefix))


SHAPE_PARTS = ("centroid_x", "centroid_y", "width", "depth", "compactness")


def shape_error(gt: DataFrame, pred: DataFrame, sides: DataFrame, min_players: int = 6) -> DataFrame:
    """Mean absolute error of each side's shape where both see enough of it, and their mean."""
    j = (_shape(gt, None, "g").join(_shape(pred, sides, "p"), ["match_id", "frame_idx", "side"])
         .filter((F.col("g.n") >= min_players) & (F.col("p.n") >= min_players)))
    e = j.groupBy("match_id").agg(*[F.round(F.avg(F.abs(F.col(f"g.{k}") - F.col(f"p.{k}"))), 3).alias(f"{k}_err")
                                    for k in SHAPE_PARTS])
    total = sum((F.col(f"{k}_err") for k in SHAPE_PARTS[1:]), F.col(f"{SHAPE_PARTS[0]}_err"))
    return e.withColumn("shape_error_m", F.round(total / len(SHAPE_PARTS), 3))


def side_counts_outer(gt: DataFrame, pred: DataFrame, sides: DataFrame) -> DataFrame:
    """Head counts per ground-truth frame and side, absent ones as 0."""
    frames = gt.select("match_id", "frame_idx").distinct().withColumn(
        "side", F.explode(F.array(*[F.lit(s) for s in SIDES])))
    keys = ["match_id", "frame_idx", "side"]
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return (frames.join(n(_located_sides(gt, None), "gt_n"), keys, "left")
            .join(n(_located_sides(pred, sides), "pred_n"), keys, "left").fillna(0, ["gt_n", "pred_n"]))


def team_counts(gt: DataFrame, pred: DataFrame, sides: DataFrame, quota: int = 11) -> DataFrame:
    c = side_counts_outer(gt, pred, sides)
    per = c.groupBy("match_id", "frame_idx").agg(
        F.sum(F.abs(F.col("pred_n") - F.col("gt_n"))).alias("e"), F.max("pred_n").alias("m"))
    return per.groupBy("match_id").agg(
        F.round(F.sum("e") / (2 * F.count(F.lit(1))), 3).alias("team_count_err"),
        F.round(F.avg((F.col("m") > quota).cast("double")), 4).alias("quota_breach_share"))


def tracking_score(gt: DataFrame, pred: DataFrame, max_dist: float = 5.0, roles=PLAYING) -> DataFrame:
    """Matched pairs, per-frame recall and precision, error percentiles, switches, and a verdict."""
    # Assignment is the costly step and four aggregates read its rows, so it is written once.
    pairs = written(match_people_gated(gt, pred, max_dist, roles).select("match_id", "frame_idx", "gt_track", "pred_track", "dist"))
    count = lambda df, name: df.filter(F.col("role").isin(*roles)).groupBy("match_id", "frame_idx").agg(
        F.count(F.lit(1)).alias(name))
    hits = pairs.groupBy("match_id", "frame_idx").agg(F.count(F.lit(1)).alias("h"))
    f = (count(gt, "g").join(count(pred, "p"), ["match_id", "frame_idx"])
         .join(by_exchange(hits), ["match_id", "frame_idx"], "left").fillna(0, ["h"]))
    rates = f.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames_scored"),
                                      F.avg(F.col("h") / F.col("g")).alias("recall"),
                                      F.avg(F.col("h") / F.col("p")).alias("precision"))
    errs = pairs.groupBy("match_id").agg(F.count(F.lit(1)).alias("matched"), F.avg("dist").alias("err_mean_m"))
    q = exact_percentiles(pairs, ["match_id"], "dist",
                          {"err_median_m": 0.5, "err_p90_m": 0.9, "err_p99_m": 0.99})
    out = rates.join(errs, "match_id").join(q, "match_id").join(id_switches(pairs), "match_id")
    m = F.col("err_median_m")
    band = F.when(m < 0.5, "fine").when(m < 1.5, "formation").when(m < 3.0, "coarse").otherwise("unusable")
    return out.withColumn("band", band)


def identity_purity(owners: DataFrame) -> DataFrame:
    """`owners` has match_id, tracklet_id, player_id: welded tracklets and how whole players are."""
    per_tracklet = owners.groupBy("match_id", "tracklet_id").agg(F.count_distinct("player_id").alias("k"))
    welded = per_tracklet.groupBy("match_id").agg(F.count(F.lit(1)).alias("tracklets"),
                                                  F.count(F.when(F.col("k") > 1, 1)).alias("welded"))
    per_player = owners.groupBy("match_id", "player_id").agg(F.count_distinct("tracklet_id").alias("f"))
    frags = per_player.groupBy("match_id").agg(
        F.percentile("f", F.lit(0.5)).alias("median_frags_per_player"),   # few distinct counts
        F.count(F.when(F.col("f") == 1, 1)).alias("players_fully_recovered"))
    return welded.join(frags, "match_id")


def active_intervals(tracklets: DataFrame) -> DataFrame:
    """Head count of each side after every change: +1 where a tracklet starts, -1 after its end."""
    from ..functions.ordered import Ordered, lead, running_sum
    change = F.explode(F.array(F.struct(F.col("start").alias("frame_idx"), F.lit(1).alias("d")),
                               F.struct((F.col("end") + 1).alias("frame_idx"), F.lit(-1).alias("d"))))
    ev = tracklets.select("match_id", "team", change.alias("c")).select("match_id", "team", "c.*")
    side = lambda t: F.sum(F.when(F.col("team") == t, F.col("d")).otherwise(0))
    ev = ev.groupBy("match_id", "frame_idx").agg(side(HOME).alias("dh"), side(AWAY).alias("da"))
    o = Ordered(ev, ["match_id"], ["frame_idx"])
    o = o.add(home_n=running_sum(F.col("dh")), away_n=running_sum(F.col("da")), until=lead(F.col("frame_idx")))
    return o.done().select("match_id", "frame_idx", "until", "home_n", "away_n")


def eleven_a_side_share(intervals: DataFrame) -> DataFrame:
    """Share of frames with anyone on that have exactly eleven a side."""
    span = F.col("until") - F.col("frame_idx")
    on = F.col("home_n") + F.col("away_n") > 0
    exact = (F.col("home_n") == 11) & (F.col("away_n") == 11)
    return intervals.filter(F.col("until").isNotNull() & on).groupBy("match_id").agg(
        (F.sum(F.when(exact, span).otherwise(0)) / F.sum(span)).alias("eleven_share"))


def cluster_diagnosis(labels: DataFrame) -> DataFrame:
    """Can a two-cluster kit split be trusted: self-agreement of tracks, balance of the split."""
    per = labels.groupBy("match_id", "track_id").agg(
        F.count(F.when(F.col("cluster") == 0, 1)).alias("c0"), F.count(F.lit(1)).alias("n"))
    agree = F.when(F.col("n") >= 3, F.greatest(F.col("c0"), F.col("n") - F.col("c0")) / F.col("n"))
    g = per.groupBy("match_id").agg(F.coalesce(F.avg(agree), F.lit(0.0)).alias("consistency"),
                                    (1 - F.abs(F.sum("c0") / F.sum("n") - 0.5) * 2).alias("balance"))
    ok = (F.col("consistency") >= 0.85) & (F.col("balance") >= 0.70)
    note = (F.when(ok, "sound").when(F.col("balance") < 0.70, "lopsided").otherwise("tracks flip"))
    return g.withColumn("ok", ok).withColumn("note", note)


def cluster_sample(labels: DataFrame, per_cluster: int) -> DataFrame:
    """The first distinct tracks of each cluster, for a person to look at."""
    first = labels.groupBy("match_id", "cluster", "track_id").agg(F.min("frame_idx").alias("frame_idx"))
    w = Window.partitionBy("match_id", "cluster").orderBy("frame_idx", "track_id")
    return first.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_cluster)
