"""Sets of whole-number intervals: sorted, disjoint, not touching; arrays of (first, last), both included."""
from __future__ import annotations

import numpy as np

NONE = np.zeros((0, 2), np.int64)


def joined(first: np.ndarray, last: np.ndarray, gap: int = 0) -> np.ndarray:
    """The set of sorted intervals, neighbours at most `gap` apart made one."""
    if not len(first):
        return NONE
    new = np.append(True, first[1:] - last[:-1] - 1 > gap)
    return np.column_stack([first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]])


def at_least(spans: np.ndarray, length: float) -> np.ndarray:
    return spans[spans[:, 1] - spans[:, 0] + 1 >= length]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = np.concatenate([a, b])
    both = both[np.argsort(both[:, 0], kind="stable")]
    return joined(both[:, 0], np.maximum.accumulate(both[:, 1])) if len(both) else NONE


def within(spans: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the numbers lie in the set."""
    i = np.searchsorted(spans[:, 0], at, side="right") - 1
    return (i >= 0) & (at <= spans[i, 1]) if len(spans) else np.zeros(len(at), bool)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What of `a` is not in `b`, split at the bounds of `b`."""
    if not len(a) or not len(b):
        return a
    first = np.unique(np.concatenate([a[:, 0], b[:, 1] + 1]))
    stops = np.unique(np.concatenate([a[:, 1], b[:, 0] - 1]))
    first = first[within(a, first) & ~within(b, first)]
    last = stops[np.searchsorted(stops, first)] if len(first) else first
    return joined(first, last)


def closed(spans: np.ndarray, gap: int, barred: np.ndarray) -> np.ndarray:
    """Gaps of at most `gap` filled, unless one of the sorted numbers `barred` lies in the gap or right after it."""
    if len(spans) < 2:
        return spans
    size = spans[1:, 0] - spans[:-1, 1] - 1
    hit = np.searchsorted(barred, spans[1:, 0], side="right") > np.searchsorted(barred, spans[:-1, 1] + 1)
    new = np.append(True, (size > gap) | hit)
    return np.column_stack([spans[new, 0], spans[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1), 1]])
