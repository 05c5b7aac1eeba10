"""Unions of half-open intervals on a timeline: of datetimes, or of epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

Point = datetime | int
Interval = tuple[Point | None, Point | None]


def after(v: Point) -> Point:
    """The next point; Spark's timestamps have microseconds."""
    return v + timedelta(microseconds=1) if isinstance(v, datetime) else v + 1


def before(v: Point) -> Point:
    return v - timedelta(microseconds=1) if isinstance(v, datetime) else v - 1


def _low(i: Interval):
    return (i[0] is not None, i[0])


@dataclass(frozen=True)
class DateRange:
    """Sorted intervals ``[low, high)`` that neither overlap nor touch; None is an open end."""

    intervals: tuple[Interval, ...]

    @staticmethod
    def of(*intervals: Interval) -> DateRange:
        kept = [i for i in intervals if i[0] is None or i[1] is None or i[0] < i[1]]
        kept.sort(key=lambda i: (i[0] is not None, i[0] if i[0] is not None else 0))
        out: list[Interval] = []
        for low, high in kept:
            if out and (out[-1][1] is None or low is None or low <= out[-1][1]):
                last = out[-1]
                out[-1] = (last[0], None if last[1] is None or high is None else max(last[1], high))
            else:
                out.append((low, high))
        return DateRange(tuple(out))

    @property
    def is_all(self) -> bool:
        return self.intervals == ((None, None),)

    @property
    def is_empty(self) -> bool:
        return not self.intervals

    def union(self, other: DateRange) -> DateRange:
        return DateRange.of(*self.intervals, *other.intervals)

    def intersect(self, other: DateRange) -> DateRange:
        out = []
        for a in self.intervals:
            for b in other.intervals:
                low = b[0] if a[0] is None else a[0] if b[0] is None else max(a[0], b[0])
                high = b[1] if a[1] is None else a[1] if b[1] is None else min(a[1], b[1])
                out.append((low, high))
        return DateRange.of(*out)

    def complement(self) -> DateRange:
        sides = [DateRange.of(*([(None, low)] if low is not None else []), *([(high, None)] if high is not None else [])) for low, high in self.intervals]
        return reduce(DateRange.intersect, sides, ALL)


ALL = DateRange(((None, None),))
EMPTY = DateRange(())


def compared(op: str, v: Point) -> DateRange:
    """The range of points p with ``p op v``."""
    return {
        ">": DateRange.of((after(v), None)), ">=": DateRange.of((v, None)), "<": DateRange.of((None, v)), "<=": DateRange.of((None, after(v))),
        "=": DateRange.of((v, after(v))), "!=": DateRange.of((None, v), (after(v), None)),
    }[op]
