"""The fluent query over a journal's snapshot. Queries are values: every call returns a new one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .errors import EmptyResultError, NotSingleError, QueryError, UnsupportedQueryError
from .functions.predicates import Col, Cmp, Or, Predicate, col, find_column, resolve
from .operators.setops import compound, same_rows
from .plans.ir import Latest, Project, Reverse, Skip, Sort, Step, Take, Where
from .plans.lower import lower, timestamp_order_first
from .spec import JournalSpec

_NO_LIMIT = (1 << 31) - 1


@dataclass(frozen=True)
class Query:
    source: DataFrame
    spec: JournalSpec
    steps: tuple[Step, ...] = ()
    params: dict = field(default_factory=dict)
    scan: object = None  # a frame over the files of a time range, if ``source`` has no rows but the schema
    hidden: tuple[str, ...] = ()
    strict: bool = False
    compat_ts_order: bool = False

    @staticmethod
    def over(df: DataFrame, spec: JournalSpec, **options) -> Query:
        for c in spec.order_key:
            find_column(df.schema, c, spec.name)
        return Query(df, spec, **options)

    def _with(self, *steps: Step) -> Query:
        return replace(self, steps=self.steps + steps)

    def _name(self, column: str | Col) -> str:
        return find_column(self.source.schema, column.name if isinstance(column, Col) else column, self.spec.name).name

    def bind(self, **params) -> Query:
        return replace(self, params=self.params | params)

    @property
    def _sliced(self) -> bool:
        return any(isinstance(s, (Take, Skip)) for s in self.steps)

    def where(self, predicate: Predicate) -> Query:
        """Several where() are a conjunction."""
        if self._sliced:
            raise UnsupportedQueryError("A slice has been taken; filter before take(), skip() and what else ends a query")
        return self._with(Where(resolve(predicate, self.source.schema, self.spec.name, self.spec.timestamp, self.params, self.strict)))

    def latest_by(self, column: str | Col, split: bool = True) -> Query:
        if self._sliced:
            raise UnsupportedQueryError("LatestBy cannot be applied after Take, Skip, Single, First or Count")
        if any(isinstance(s, Latest) for s in self.steps):
            raise UnsupportedQueryError("LATEST BY may be given once")
        return self._with(Latest(self._name(column), split))

    def order_by(self, column: str | Col, descending: bool = False) -> Query:
        return self._with(Sort(((self._name(column), descending),)))

    def order_by_desc(self, column: str | Col) -> Query:
        return self.order_by(column, True)

    def then_by(self, column: str | Col, descending: bool = False) -> Query:
        if not self.steps or not isinstance(self.steps[-1], Sort):
            raise UnsupportedQueryError("ThenBy needs an OrderBy before it")
        return replace(self, steps=self.steps[:-1] + (Sort(self.steps[-1].keys + ((self._name(column), descending),)),))

    def then_by_desc(self, column: str | Col) -> Query:
        return self.then_by(column, True)

    def reverse(self) -> Query:
        return self._with(Reverse())

    def take(self, n: int) -> Query:
        return self if n >= _NO_LIMIT else self._with(Take(n))

    def skip(self, n: int) -> Query:
        return self._with(Skip(n)) if n else self

    def select(self, *columns: str | tuple[str, str]) -> Query:
        """Columns, or pairs of a column and the name it gets."""
        pairs = [(c, None) if isinstance(c, (str, Col)) else c for c in columns]
        return self._with(Project(tuple((n := self._name(c), a or n) for c, a in pairs)))

    def union(self, other: Query) -> Query:
        """Rows of either query over the same journal, each once."""
        if self.spec != other.spec:
            raise QueryError("Union needs two queries over one journal")
        plain = lambda q: all(isinstance(s, Where) for s in q.steps)
        if plain(self) and plain(other) and self.source is other.source:
            if not self.steps or not other.steps:
                return replace(self, steps=())
            both = lambda q: reduce(lambda a, b: a & b, (s.predicate for s in q.steps))
            return replace(self, steps=(Where(Or((both(self), both(other)))),))
        rows = same_rows(self._rows(), other._rows(), self.spec.order_key)
        return replace(self, source=rows, steps=(), scan=None)

    def _with_rows(self, rows: DataFrame) -> Query:
        return replace(self, source=rows, steps=(), scan=None)

    def intersect(self, other: Query) -> Query:
        """Different rows that both queries have."""
        return self._with_rows(compound("INTERSECT", self._rows(), other._rows()))

    def except_(self, other: Query) -> Query:
        """Different rows of this query that the other doesn't have."""
        return self._with_rows(compound("EXCEPT", self._rows(), other._rows()))

    def concat(self, other: Query) -> Query:
        """All rows of both queries."""
        return self._with_rows(compound("UNION ALL", self._rows(), other._rows()))

    def distinct(self) -> Query:
        return self._with_rows(self._rows().distinct())

    def _rows(self, ordered: bool = False) -> DataFrame:
        steps = tuple(s for s in self.steps if not isinstance(s, Project))
        return replace(self, steps=steps, hidden=()).to_df(ordered)

    # results

    def to_df(self, ordered: bool = True) -> DataFrame:
        """Rows in order; ``ordered=False`` spares the sort where order doesn't matter."""
        steps = timestamp_order_first(self.steps, self.spec) if self.compat_ts_order and self.spec.timestamp else self.steps
        return lower(self.source, self.spec, steps, self.scan, ordered, self.hidden)

    def count_df(self, predicate: Predicate | None = None) -> DataFrame:
        q = self.where(predicate) if predicate is not None else self
        return q.to_df(ordered=False).agg(F.count("*").alias("cnt"))

    def count(self, predicate: Predicate | None = None) -> int:
        return self.count_df(predicate).first()["cnt"]

    long_count = count

    def _ends(self, predicate: Predicate | None, last: bool, n: int = 1) -> DataFrame:
        q = self.where(predicate) if predicate is not None else self
        return (q.reverse() if last else q).take(n).to_df()

    def first_df(self, predicate: Predicate | None = None) -> DataFrame:
        return self._ends(predicate, False)

    def last_df(self, predicate: Predicate | None = None) -> DataFrame:
        return self._ends(predicate, True)

    def first_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return self.first_df(predicate).first()

    def last_or_none(self, predicate: Predicate | None = None) -> Row | None:
        return self.last_df(predicate).first()

    def first(self, predicate: Predicate | None = None) -> Row:
        row = self.first_or_none(predicate)
        if row is None:
            raise EmptyResultError("The query has no rows")
        return row

    def last(self, predicate: Predicate | None = None) -> Row:
        row = self.last_or_none(predicate)
        if row is None:
            raise EmptyResultError("The query has no rows")
        return row

    def single(self, predicate: Predicate | None = None) -> Row:
        rows = self._ends(predicate, False, 2).collect()
        if not rows:
            raise EmptyResultError("The query has no rows")
        if len(rows) > 1:
            raise NotSingleError("The query has more than one row")
        return rows[0]

    # direct access

    def all(self) -> DataFrame:
        """Every row, oldest first."""
        return (self.order_by(self.spec.timestamp) if self.spec.timestamp else self).to_df()

    enumerate = all

    def all_by_symbol(self, column: str, value: object) -> DataFrame:
        """Rows of one symbol, newest first."""
        return self.where(Cmp(column, "=", value)).to_df()

    def all_by_symbol_over_interval(self, column: str, value: object, start: object, end: object) -> DataFrame:
        """Rows of one symbol in ``[start, end)``, newest first."""
        ts = col(self.spec.timestamp)
        return self.where(Cmp(column, "=", value)).where(ts >= start).where(ts < end).to_df()

    def ql(self, text: str, *, ordered: bool = True, **params) -> DataFrame:
        """A statement's rows; ``ordered=False`` spares the sort where order doesn't matter."""
        from .plans.ql import run

        return run(text, lambda name: self, params, ordered)
