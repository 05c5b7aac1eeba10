"""From steps to a DataFrame.

Where a query has LATEST BY, its time range is applied first, the latest rows are taken second, and all
else is filtered last, in whatever order the clauses came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnsupportedQueryError
from ..functions import predicates as P
from ..operators.latest import latest_by, latest_by_each
from ..spec import JournalSpec
from .intervals import ALL, DateRange
from .ir import Latest, Project, Reverse, Skip, Sort, Step, Take, Where

Keys = tuple[tuple[str, bool], ...]


def default_order(spec: JournalSpec, descending: bool = True) -> Keys:
    return tuple((c, descending) for c in spec.order_key)


def order_columns(keys: Keys):
    """Nulls first ascending, last descending."""
    return [F.desc(f"`{c}`") if down else F.asc(f"`{c}`") for c, down in keys]


def timestamp_order_first(steps: tuple[Step, ...], spec: JournalSpec) -> tuple[Step, ...]:
    """Compatibility: orderings by the timestamp alone, and reversals of them, act before any slice."""
    flip, rest, down = False, [], True
    for s in steps:
        if isinstance(s, Sort) and len(s.keys) == 1 and s.keys[0][0] == spec.timestamp:
            down, flip = s.keys[0][1], False
        elif isinstance(s, Reverse) and not any(isinstance(r, Sort) for r in rest):
            flip = not flip
        else:
            rest.append(s)
    return (Sort(((spec.timestamp, down ^ flip),)), *rest)


def restricted(df: DataFrame, spec: JournalSpec, r: DateRange, scan=None) -> DataFrame:
    """Rows in a time range; ``scan`` gives, instead of ``df``, a frame over the files that may hold such rows."""
    if scan is not None:
        df = scan(r)
    if r.is_all:
        return df
    return df.where(P.range_column(r, spec.timestamp, df.schema[spec.timestamp].dataType))


def _branches(p: P.Predicate | None, ts: str) -> list[P.Predicate | None]:
    """The alternatives of a predicate that differ in their times. An OR of one time range, or of nothing but times, stays whole."""
    parts = P.conjuncts(p)
    for i, q in enumerate(parts):
        if isinstance(q, P.Or) and not P.only_time(q, ts) and len({P.time_range(alt, ts) for alt in q.parts}) > 1:
            rest = parts[:i] + parts[i + 1 :]
            return [b for alt in q.parts for b in _branches(P.And((alt, *rest)), ts)]
    return [p]


def filtered(df: DataFrame, spec: JournalSpec, p: P.Predicate | None, latest: Latest | None, scan=None) -> DataFrame:
    """All filters and LATEST BY."""
    r = P.time_range(p, spec.timestamp) if p is not None else ALL
    rest = [q for q in P.conjuncts(p) if not (spec.timestamp and P.only_time(q, spec.timestamp))]
    if latest is None:
        out = restricted(df, spec, r, scan)
        return out.where(P.to_column(P.And(tuple(rest)), df.schema)) if rest else out
    if latest.split and spec.timestamp:
        by: dict[DateRange, list[P.Predicate]] = {}
        for branch in _branches(p, spec.timestamp):
            by.setdefault(P.time_range(branch, spec.timestamp), []).append(branch)
        if len(by) > 1:
            kind = df.schema[spec.timestamp].dataType
            among = lambda t: F.lit(True) if t.is_all else P.range_column(t, spec.timestamp, kind)
            keep = lambda bs: reduce(lambda a, b: a | b, [P.to_column(b, df.schema) for b in bs])
            return latest_by_each(restricted(df, spec, r, scan), latest.key, spec.order_key, [(among(t), keep(bs)) for t, bs in by.items()])
    out = latest_by(restricted(df, spec, r, scan), latest.key, spec.order_key)
    return out.where(P.to_column(P.And(tuple(rest)), df.schema)) if rest else out


def lower(df: DataFrame, spec: JournalSpec, steps: tuple[Step, ...], scan=None, ordered: bool = True, hidden: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``steps`` over ``df``; with ``ordered`` in their order, newest first by default."""
    first = next((i for i, s in enumerate(steps) if isinstance(s, (Take, Skip))), len(steps))
    if any(isinstance(s, (Where, Latest)) for s in steps[first:]):
        raise UnsupportedQueryError("Where and LatestBy can't be applied after Take, Skip, First, Last, Single or Count")
    parts = [s.predicate for s in steps if isinstance(s, Where)]
    latest = [s for s in steps if isinstance(s, Latest)]
    if len(latest) > 1:
        raise UnsupportedQueryError("LATEST BY may be given once")
    split = latest and any(isinstance(s, Where) for s in steps[: steps.index(latest[0])])
    out = filtered(df, spec, P.And(tuple(parts)) if len(parts) > 1 else parts[0] if parts else None, Latest(latest[0].key, bool(split and latest[0].split)) if latest else None, scan)
    keys, is_sorted, columns = default_order(spec), False, None
    tie = default_order(spec)
    for s in steps:
        if isinstance(s, Sort):
            named = {c for c, _ in s.keys}
            if len(s.keys) == 1 and s.keys[0][0] == spec.timestamp:
                keys = default_order(spec, s.keys[0][1])
            else:
                keys = s.keys + tuple(k for k in tie if k[0] not in named)
            is_sorted = False
        elif isinstance(s, Reverse):
            keys, is_sorted = tuple((c, not down) for c, down in keys), False
        elif isinstance(s, (Take, Skip)):
            if s.n < 0:
                raise UnsupportedQueryError(f"A slice can't have {s.n} rows")
            if not is_sorted and keys:
                out, is_sorted = out.orderBy(*order_columns(keys)), True
            out = out.limit(s.n) if isinstance(s, Take) else out.offset(s.n)
        elif isinstance(s, Project):
            columns = s.columns
    if ordered and not is_sorted and keys:
        out = out.orderBy(*order_columns(keys))
    if columns is not None:
        return out.select(*[F.col(f"`{c}`").alias(a) for c, a in columns])
    return out.drop(*hidden) if hidden else out
