"""Detections tables: class gate, suppression, dedicated ball, mapping to the pitch."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import whole_groups
from ..schema import BALL, GOALKEEPER, OTHER, PLAYER, REFEREE

# Class-name fragments in order of precedence.
ROLE_PATTERNS = (("goalkeeper", GOALKEEPER), ("keeper", GOALKEEPER), ("referee", REFEREE), ("ref", REFEREE),
                 ("ball", BALL), ("player", PLAYER), ("person", PLAYER))


def role_of_class(name="cls_name"):
    low, out = F.lower(F.col(name)), None
    for part, role in ROLE_PATTERNS:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise(OTHER)


def class_gate(detections: DataFrame, conf: float = 0.25, ball_conf: float = 0.10) -> DataFrame:
    """Adds role from the class name and drops boxes under their class's confidence."""
    d = detections.withColumn("role", role_of_class())
    return d.filter(F.col("conf") >= F.when(F.col("role") == BALL, ball_conf).otherwise(conf))


def _kept(x, y, w, h, conf, iou: float) -> list[int]:
    x, y, w, h = (np.asarray(v, float) for v in (x, y, w, h))
    order = np.argsort(-np.asarray(conf, float), kind="stable")
    area = np.maximum(w, 0) * np.maximum(h, 0)
    alive = np.ones(len(order), bool)
    keep = []
    for i in order:
        if not alive[i]:
            continue
        keep.append(int(i))
        iw = np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x)
        ih = np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y)
        inter = np.clip(iw, 0, None) * np.clip(ih, 0, None)
        alive &= inter / np.maximum(area[i] + area - inter, 1e-9) <= iou
        alive[i] = False
    return keep


def suppress(detections: DataFrame, iou: float = 0.55) -> DataFrame:
    """Greedy suppression per frame and class, over sorted batches streamed through each task."""
    keys = ["match_id", "frame_idx", "cls_name"]

    def run(batches):
        for df, cuts in whole_groups(batches, keys):
            cols = [df[c].to_numpy() for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "conf")]
            kept = [a + k for a, b in zip(cuts[:-1], cuts[1:]) for k in _kept(*(c[a:b] for c in cols), iou)]
            yield df.iloc[kept]
    return (detections.repartition(*keys).sortWithinPartitions(*keys, "det")
            .mapInPandas(run, detections.schema))


def anti_override(detections: DataFrame, dedicated: DataFrame) -> DataFrame:
    """Dedicated-ball rows replace a frame's ball rows wherever the dedicated model fired."""
    fired = dedicated.select("match_id", "frame_idx").distinct().withColumn("role", F.lit(BALL))
    return detections.join(fired, ["match_id", "frame_idx", "role"], "left_anti").select(
        *detections.columns).unionByName(dedicated)
