from hypothesis import given
from hypothesis import strategies as st

from tidemark.plans.intervals import ALL, EMPTY, DateRange, compared

END = st.none() | st.integers(-20, 20)
RANGE = st.lists(st.tuples(END, END), max_size=5).map(lambda x: DateRange.of(*x))


def points(r: DateRange) -> set[int]:
    return {p for p in range(-30, 31) if any((a is None or a <= p) and (b is None or p < b) for a, b in r.intervals)}


@given(RANGE, RANGE)
def test_algebra_is_that_of_point_sets(a, b):
    assert points(a.union(b)) == points(a) | points(b)
    assert points(a.intersect(b)) == points(a) & points(b)
    assert points(a.complement()) == set(range(-30, 31)) - points(a)


@given(RANGE)
def test_intervals_are_sorted_and_apart(r):
    for (_, b), (c, _) in zip(r.intervals, r.intervals[1:]):
        assert b < c


def test_touching_intervals_become_one():
    assert DateRange.of((1, 3), (3, 5)).intervals == ((1, 5),)
    assert DateRange.of((1, 3), (4, 5)).intervals == ((1, 3), (4, 5))
    assert DateRange.of((None, 3), (2, None)).is_all
    assert DateRange.of((5, 5), (7, 6)).is_empty


@given(st.sampled_from([">", ">=", "<", "<=", "=", "!="]), st.integers(-10, 10))
def test_comparisons(op, v):
    want = {p for p in range(-30, 31) if {">": p > v, ">=": p >= v, "<": p < v, "<=": p <= v, "=": p == v, "!=": p != v}[op]}
    assert points(compared(op, v)) == want


def test_ends():
    assert ALL.complement() == EMPTY and EMPTY.complement() == ALL
