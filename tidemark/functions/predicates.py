"""Predicates as values: resolved against a schema, read as time ranges, and turned into columns.

Equality is null-safe: ``= NULL`` asks for nulls, ``!=`` keeps null rows, IN with a null element matches
null rows. So every predicate is true or false, never null, and NOT is a plain complement.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UnsupportedQueryError
from ..plans import intervals
from ..plans.intervals import ALL, EMPTY, DateRange

_EPOCH = datetime(1970, 1, 1)
_MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Param:
    """A bind parameter; names are case-insensitive."""

    name: str


@dataclass(frozen=True)
class Cmp(Predicate):
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class In(Predicate):
    """``values`` may hold parameters, and a parameter may stand for the list itself."""

    column: str
    values: object


@dataclass(frozen=True)
class IsNull(Predicate):
    column: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


class Col:
    """``col("price") > 3``: comparisons that make predicates."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, v):  # type: ignore[override]
        return Cmp(self.name, "=", v)

    def __ne__(self, v):  # type: ignore[override]
        return Cmp(self.name, "!=", v)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, v):
        return Cmp(self.name, "<", v)

    def __le__(self, v):
        return Cmp(self.name, "<=", v)

    def __gt__(self, v):
        return Cmp(self.name, ">", v)

    def __ge__(self, v):
        return Cmp(self.name, ">=", v)

    def isin(self, *values):
        return In(self.name, values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset, Param)) else values)

    def is_null(self):
        return IsNull(self.name)

    def is_not_null(self):
        return Not(IsNull(self.name))


def col(name: str) -> Col:
    return Col(name)


def mirrored(op: str) -> str:
    """The operator for ``column op value`` when the text says ``value op column``."""
    return _MIRROR[op]


def find_column(schema: T.StructType, name: str, journal: str, where: str = "") -> T.StructField:
    hits = [f for f in schema.fields if f.name == name] or [f for f in schema.fields if f.name.lower() == name.lower()]
    if not hits:
        raise QueryError(f"{where}Column [{name}] does not exist in journal {journal}")
    return hits[0]


def coerce(value: object, kind: T.DataType, column: str) -> object:
    """A literal as a value of the column's type, or QueryError."""
    if value is None:
        return None
    bad = QueryError(f"{value!r} can't be compared with column [{column}] of type {kind.simpleString()}")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        try:
            if isinstance(value, str):
                value = datetime.fromisoformat(value)
            elif isinstance(value, bool):
                raise bad
            elif isinstance(value, int):
                value = _EPOCH + timedelta(milliseconds=value)
        except (ValueError, OverflowError):
            raise bad from None
        if isinstance(value, datetime):
            return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        if isinstance(value, date):
            return datetime(value.year, value.month, value.day)
        raise bad
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
        raise bad
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if isinstance(value, datetime) and isinstance(kind, T.LongType):
            value = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
            return (value - _EPOCH) // timedelta(milliseconds=1)
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise bad
        return int(value) if isinstance(value, int) or (math.isfinite(value) and value == int(value)) else value
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise bad
        return float(value)
    if isinstance(kind, T.StringType):
        if isinstance(value, str):
            return value
        raise bad
    raise UnsupportedQueryError(f"Column [{column}] of type {kind.simpleString()} can't be compared")


def resolve(p: Predicate, schema: T.StructType, journal: str, timestamp: str | None, params: dict[str, object], strict: bool = False) -> Predicate:
    """Columns by their own names, parameters replaced, literals of the columns' types."""
    again = lambda q: resolve(q, schema, journal, timestamp, params, strict)

    def value(v: object) -> object:
        if isinstance(v, Param):
            hit = {k.lower(): x for k, x in params.items()}
            if v.name.lower() not in hit:
                raise QueryError(f"Parameter @{v.name} has no value")
            return hit[v.name.lower()]
        return v

    if isinstance(p, And):
        return And(tuple(map(again, p.parts)))
    if isinstance(p, Or):
        return Or(tuple(map(again, p.parts)))
    if isinstance(p, Not):
        return Not(again(p.part))
    if not isinstance(p, (Cmp, In, IsNull)):
        raise UnsupportedQueryError(f"{p!r} is not a predicate")
    f = find_column(schema, p.column, journal)
    if isinstance(p, IsNull):
        return IsNull(f.name)
    if isinstance(p, In):
        values = value(p.values)
        if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
            raise QueryError(f"IN on [{f.name}] needs a list, not {values!r}")
        return In(f.name, tuple(dict.fromkeys(coerce(value(v), f.dataType, f.name) for v in values)))
    v = coerce(value(p.value), f.dataType, f.name)
    if p.op in ("=", "!="):
        if v is None:
            return IsNull(f.name) if p.op == "=" else Not(IsNull(f.name))
        return Cmp(f.name, p.op, v)
    if strict and f.name != timestamp:
        raise UnsupportedQueryError(f"With strict=True only the timestamp can be ordered, not [{f.name}]")
    if v is None:
        raise QueryError(f"[{f.name}] can't be ordered against NULL")
    return Cmp(f.name, p.op, v)


def time_range(p: Predicate, timestamp: str | None) -> DateRange:
    """The least range that holds the time of every row for which a resolved predicate is true."""
    if isinstance(p, Cmp) and p.column == timestamp and isinstance(p.value, (datetime, int)):
        return intervals.compared(p.op, p.value)
    if isinstance(p, In) and p.column == timestamp:
        return reduce(DateRange.union, (intervals.compared("=", v) for v in p.values if isinstance(v, (datetime, int))), EMPTY) if all(v is not None for v in p.values) else ALL
    if isinstance(p, And):
        return reduce(DateRange.intersect, (time_range(q, timestamp) for q in p.parts), ALL)
    if isinstance(p, Or):
        return reduce(DateRange.union, (time_range(q, timestamp) for q in p.parts), EMPTY)
    if isinstance(p, Not) and only_time(p.part, timestamp):
        return time_range(p.part, timestamp).complement()
    return ALL


def only_time(p: Predicate, timestamp: str | None) -> bool:
    """Whether a resolved predicate says nothing but a time range."""
    if isinstance(p, (And, Or)):
        return all(only_time(q, timestamp) for q in p.parts)
    if isinstance(p, Not):
        return only_time(p.part, timestamp)
    if isinstance(p, In):
        return p.column == timestamp and all(v is not None for v in p.values)
    return isinstance(p, Cmp) and p.column == timestamp


def conjuncts(p: Predicate | None) -> list[Predicate]:
    if p is None:
        return []
    return [q for part in p.parts for q in conjuncts(part)] if isinstance(p, And) else [p]


def literal(v: object, kind: T.DataType) -> Column:
    """A constant that Parquet filters understand; timestamps never pass through the session's time zone."""
    if isinstance(v, datetime):
        if isinstance(kind, T.TimestampType):  # an instant; values without a zone are UTC
            return F.timestamp_micros(F.lit((v - _EPOCH) // timedelta(microseconds=1)).cast("long"))
        return F.lit(v.isoformat(sep=" ")).cast(kind)
    if isinstance(v, float) and isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit(v)  # 2.5 equals no integer
    if isinstance(v, int) and not isinstance(v, bool) and not isinstance(kind, (T.DoubleType, T.FloatType)) and not -(1 << 31) <= v < 1 << 31:
        return F.lit(v).cast("long")
    return F.lit(v).cast(kind)


def to_column(p: Predicate, schema: T.StructType, negated: bool = False) -> Column:
    """A resolved predicate as a Spark column for a filter. Null instead of false selects the same rows, and reaches the scan, but below a NOT."""
    if isinstance(p, And):
        return reduce(Column.__and__, (to_column(q, schema, negated) for q in p.parts), F.lit(True))
    if isinstance(p, Or):
        return reduce(Column.__or__, (to_column(q, schema, negated) for q in p.parts), F.lit(False))
    if isinstance(p, Not):
        return ~to_column(p.part, schema, True)
    c, kind = F.col(f"`{p.column}`"), schema[p.column].dataType
    if isinstance(p, IsNull):
        return c.isNull()
    if isinstance(p, In):
        some = [literal(v, kind) for v in p.values if v is not None]
        hit = F.coalesce(c.isin(*some), F.lit(False)) if some and negated and schema[p.column].nullable else c.isin(*some) if some else F.lit(False)
        return hit | c.isNull() if None in p.values else hit
    v = literal(p.value, kind)
    if p.op == "=":
        return c.eqNullSafe(v)
    if p.op == "!=":
        return ~c.eqNullSafe(v)
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[p.op] & c.isNotNull()


def range_column(r: DateRange, name: str, kind: T.DataType) -> Column:
    """A time range as a Spark column; a null time is in the whole range only."""
    c = F.col(f"`{name}`")
    if r.is_all:
        return F.lit(True)
    sides = [[c >= literal(low, kind)] * (low is not None) + [c < literal(high, kind)] * (high is not None) for low, high in r.intervals]
    return reduce(Column.__or__, (reduce(Column.__and__, s) for s in sides), F.lit(False)) if sides else F.lit(False)
