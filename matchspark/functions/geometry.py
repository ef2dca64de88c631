"""Pitch geometry as column expressions: landmarks, lines, boxes, homographies."""
from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pitch markings in metres.
GOAL_WIDTH, PEN_DEPTH, PEN_WIDTH = 7.32, 16.5, 40.32
BOX_DEPTH, BOX_WIDTH, SPOT, CIRCLE = 5.5, 18.32, 11.0, 9.15


def landmark_terms() -> list[tuple[str, float, float, float, float]]:
    """The 35 named points as (name, sx, dx, sy, dy): x = sx * half length + dx, y = sy * half width + dy."""
    arc = sqrt(CIRCLE ** 2 - (SPOT - PEN_DEPTH) ** 2)
    pts = [(f"corner_{a}{b}", s, 0.0, t, 0.0) for a, s in (("L", -1.0), ("R", 1.0)) for b, t in (("T", -1.0), ("B", 1.0))]
    pts += [("halfway_T", 0.0, 0.0, -1.0, 0.0), ("halfway_B", 0.0, 0.0, 1.0, 0.0), ("centre_spot", 0.0, 0.0, 0.0, 0.0),
            ("centre_circle_T", 0.0, 0.0, 0.0, -CIRCLE), ("centre_circle_B", 0.0, 0.0, 0.0, CIRCLE)]
    # Markings inside each half: distance from the goal line and from the long axis.
    marks = (("pen_area", "_goalline", 0.0, PEN_WIDTH / 2), ("pen_area", "_front", PEN_DEPTH, PEN_WIDTH / 2),
             ("goal_area", "_goalline", 0.0, BOX_WIDTH / 2), ("goal_area", "_front", BOX_DEPTH, BOX_WIDTH / 2),
             ("pen_arc", "", PEN_DEPTH, arc), ("goalpost", "", 0.0, GOAL_WIDTH / 2))
    for a, s in (("L", -1.0), ("R", 1.0)):
        pts.append((f"pen_spot_{a}", s, -s * SPOT, 0.0, 0.0))
        pts += [(f"{m}_{a}{b}{tail}", s, -s * depth, 0.0, t * off)
                for m, tail, depth, off in marks for b, t in (("T", -1.0), ("B", 1.0))]
    return pts


def landmark_array(length: Column, width: Column) -> Column:
    """The named points of a pitch as an array of (landmark, lx, ly)."""
    return F.array(*[F.struct(F.lit(n).alias("landmark"), (length / 2 * sx + dx).alias("lx"),
                              (width / 2 * sy + dy).alias("ly")) for n, sx, dx, sy, dy in landmark_terms()])


def pitch_landmarks(matches: DataFrame) -> DataFrame:
    """(match, landmark, lx, ly) for each match's own pitch size."""
    return matches.select("match_id", F.inline(landmark_array(F.col("pitch_length"), F.col("pitch_width"))))


def feet_point() -> tuple[Column, Column]:
    """Bottom centre of the box: where a person stands on the ground plane."""
    return F.col("bbox_x") + F.col("bbox_w") / 2, F.col("bbox_y") + F.col("bbox_h")


def centre_origin(x: Column, y: Column, length: Column, width: Column, unit: bool = False) -> tuple[Column, Column]:
    """Corner metres (or [0, 1] shares when unit) to metres from the centre spot."""
    kx, ky = (length, width) if unit else (F.lit(1.0), F.lit(1.0))
    return x * kx - length / 2, y * ky - width / 2


def ground_line_array(half_l: float = 52.5, half_w: float = 34.0) -> Column:
    """Straight ground lines as (line, ax, ay, bx, by)."""
    lines = [("Side line top", -half_l, -half_w, half_l, -half_w),
             ("Side line bottom", -half_l, half_w, half_l, half_w),
             ("Side line left", -half_l, -half_w, -half_l, half_w),
             ("Side line right", half_l, -half_w, half_l, half_w), ("Middle line", 0.0, -half_w, 0.0, half_w)]
    for side, s in (("left", -1), ("right", 1)):
        for name, depth, hw in (("Big rect.", PEN_DEPTH, PEN_WIDTH / 2), ("Small rect.", BOX_DEPTH, BOX_WIDTH / 2)):
            far, near = s * half_l, s * (half_l - depth)
            lines += [(f"{name} {side} top", far, -hw, near, -hw), (f"{name} {side} main", near, -hw, near, hw),
                      (f"{name} {side} bottom", far, hw, near, hw)]
    return F.array(*[F.struct(F.lit(n).alias("line"), *[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), c)])
                     for n, *c in lines])


def mirror_line(col: str = "line") -> Column:
    """The name of a line seen through the centre spot: left <-> right, top <-> bottom."""
    swap = lambda w: (F.when(w == "left", "right").when(w == "right", "left")
                      .when(w == "top", "bottom").when(w == "bottom", "top").otherwise(w))
    return F.array_join(F.transform(F.split(F.col(col), " "), swap), " ")


# The 32 vertices of the keypoint model, in its order, in metres from a corner of its 120 x 70 pitch.
MODEL_LENGTH, MODEL_WIDTH = 120.0, 70.0
MODEL_VERTICES = [
    (0, 0), (0, 14.5), (0, 25.84), (0, 44.16), (0, 55.5), (0, 70), (5.5, 25.84), (5.5, 44.16), (11, 35),
    (20.15, 14.5), (20.15, 25.84), (20.15, 44.16), (20.15, 55.5), (60, 0), (60, 25.85), (60, 44.15), (60, 70),
    (99.85, 14.5), (99.85, 25.84), (99.85, 44.16), (99.85, 55.5), (109, 35), (114.5, 25.84), (114.5, 44.16),
    (120, 0), (120, 14.5), (120, 25.84), (120, 44.16), (120, 55.5), (120, 70), (50.85, 35), (69.15, 35)]


def model_vertices(length: float = 105.0, width: float = 68.0) -> list[tuple[float, float]]:
    """The vertices on a pitch of the given size, in metres from its centre."""
    return [(x * length / MODEL_LENGTH - length / 2, y * width / MODEL_WIDTH - width / 2) for x, y in MODEL_VERTICES]
