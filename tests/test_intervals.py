"""Interval sets against plain sets of numbers."""
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from matchspark.functions.intervals import at_least, closed, joined, minus, union, within

numbers = st.sets(st.integers(0, 60), max_size=40)


def spans(values):
    v = np.array(sorted(values), np.int64)
    return joined(v, v)


def members(s):
    return {int(i) for a, b in s for i in range(a, b + 1)}


@settings(max_examples=300, deadline=None)
@given(numbers, numbers, st.integers(0, 6))
def test_set_algebra(a, b, k):
    x, y = spans(a), spans(b)
    assert members(x) == a and members(union(x, y)) == a | b and members(minus(x, y)) == a - b
    assert within(x, np.arange(61)).tolist() == [i in a for i in range(61)]
    for got in (x, union(x, y), minus(x, y)):
        assert all(p[1] + 1 < q[0] for p, q in zip(got, got[1:]))          # sorted, disjoint, not touching
    assert members(at_least(x, k)) == {i for p, q in x if q - p + 1 >= k for i in range(p, q + 1)}
    filled = set(a)
    for p, q in zip(x, x[1:]):
        if q[0] - p[1] - 1 <= k and not any(p[1] < c <= q[0] for c in b):
            filled |= set(range(p[1] + 1, q[0]))
    assert members(closed(x, k, np.array(sorted(b), np.int64))) == filled
