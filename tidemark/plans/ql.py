"""The query language: a hand-written lexer and a precedence-climbing parser onto Query.

    SELECT [TOP n [OFFSET m]] columns FROM journal [LATEST BY column] [WHERE condition]
      [{UNION [ALL] | INTERSECT | EXCEPT} SELECT ...] [ORDER BY column [ASC | DESC], ...]

From loosest to tightest: OR, AND, NOT, then comparisons, IN and IS.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import QlSyntaxError, QueryError, UnsupportedQueryError
from ..functions import predicates as P
from ..operators.setops import compound

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)
    |(?P<param>[@:$][A-Za-z_]\w*)|(?P<quoted>"(?:[^"]|"")*"|\[[^\]]*\]|`(?:[^`]|``)*`)|(?P<name>[A-Za-z_]\w*)
    |(?P<sign><>|!=|==|<=|>=|&&|\|\||<<|>>|[=<>(),.*;+\-~/%&|^])""",
    re.X | re.S,
)
_RESERVED = set("SELECT FROM WHERE LATEST BY ORDER TOP OFFSET UNION ALL INTERSECT EXCEPT AND OR NOT IN IS NULL AS ASC DESC GROUP HAVING DISTINCT JOIN LIKE BETWEEN CASE EXISTS CAST".split())
_OPS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text if self.kind == "sign" else ""


def tokens(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QlSyntaxError(line, at - start, f"token recognition error at: {text[at]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], line, at - start))
        for nl in re.finditer("\n", m[0]):
            line, start = line + 1, at + nl.end()
        at = m.end()
    out.append(Token("end", "<EOF>", line, at - start))
    return out


@dataclass(frozen=True)
class Name:
    """A column as written, with its place for messages."""

    text: str
    token: Token = field(compare=False, repr=False)


@dataclass(frozen=True)
class Select:
    journal: str
    columns: tuple[tuple[Name | None, str | None], ...]  # None: all columns
    latest: Name | None = None
    where: P.Predicate | None = None
    top: object = None
    offset: object = None
    names: tuple[Name, ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Statement:
    first: Select
    more: tuple[tuple[str, Select], ...] = ()
    order: tuple[tuple[Name, bool], ...] = ()


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.i, self.names = tokens(text), 0, []

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, expected: str):
        raise QlSyntaxError(self.now.line, self.now.column, f"mismatched input {self.now.text!r}, expecting {expected}")

    def take(self, *words: str) -> bool:
        """Consumes these words if they come next."""
        if [t.word for t in self.tokens[self.i : self.i + len(words)]] == list(words):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(word)

    def name(self, what: str) -> Name:
        t = self.now
        if t.kind == "quoted":
            text = t.text[1:-1].replace(t.text[0] * 2, t.text[0])
        elif t.kind == "name" and t.word not in _RESERVED:
            text = t.text
        else:
            self.fail(what)
        self.i += 1
        return Name(text, t)

    def column(self) -> Name:
        n = self.name("a column")
        while self.take("."):
            n = self.name("a column")
        self.names.append(n)
        return n

    def statement(self) -> Statement:
        first, more, order = self.select(), [], []
        while True:
            if self.take("UNION"):
                op = "UNION ALL" if self.take("ALL") else "UNION"
            elif self.take("INTERSECT"):
                op = "INTERSECT"
            elif self.take("EXCEPT"):
                op = "EXCEPT"
            else:
                break
            more.append((op, self.select()))
        if self.take("ORDER"):
            self.need("BY")
            while True:
                c = self.column()
                order.append((c, not self.take("ASC") and self.take("DESC")))
                if not self.take(","):
                    break
        self.take(";")
        if self.now.kind != "end":
            self.fail("the end")
        return Statement(first, tuple(more), tuple(order))

    def select(self) -> Select:
        self.need("SELECT")
        self.names = []
        top = offset = latest = where = None
        if self.now.word == "DISTINCT":
            raise UnsupportedQueryError("DISTINCT is not supported")
        if self.take("TOP"):
            top = self.amount()
            if self.take("OFFSET") or self.take(","):
                offset = self.amount()
        columns = [self.result()]
        while self.take(","):
            columns.append(self.result())
        self.need("FROM")
        journal = self.name("a journal").text
        while self.take("."):
            journal = self.name("a journal").text
        if self.now.word in ("JOIN", ","):
            raise UnsupportedQueryError("FROM takes one journal")
        if self.take("LATEST"):
            self.need("BY")
            latest = self.column()
        if self.take("WHERE"):
            where = self.either()
        if self.now.word in ("GROUP", "HAVING"):
            raise UnsupportedQueryError(f"{self.now.word} is not supported; group the DataFrame that the query returns")
        return Select(journal, tuple(columns), latest, where, top, offset, tuple(self.names))

    def amount(self) -> object:
        t = self.now
        if t.kind == "param":
            self.i += 1
            return P.Param(t.text[1:])
        if t.kind != "number" or not t.text.isdigit():
            self.fail("a number of rows")
        self.i += 1
        return int(t.text)

    def result(self) -> tuple[Name | None, str | None]:
        if self.take("*"):
            return None, None
        if self.now.kind in ("number", "string", "param"):
            raise UnsupportedQueryError("Only columns can be selected")
        n = self.name("a column")
        while self.take("."):
            if self.take("*"):
                return None, None
            n = self.name("a column")
        if self.now.word in ("(", "+", "-", "*", "/", "%", "||"):
            raise UnsupportedQueryError("Only columns can be selected")
        self.names.append(n)
        if self.take("AS") or self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in _RESERVED:
            return n, self.name("a name").text
        return n, None

    def either(self) -> P.Predicate:
        parts = [self.both()]
        while self.take("OR") or self.take("||"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else P.Or(tuple(parts))

    def both(self) -> P.Predicate:
        parts = [self.negated()]
        while self.take("AND") or self.take("&&"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else P.And(tuple(parts))

    def negated(self) -> P.Predicate:
        if self.take("NOT"):
            return P.Not(self.negated())
        if self.now.word == "(":
            self.take("(")
            inner = self.either()
            self.need(")")
            if self.now.word in _OPS or self.now.word in ("IN", "IS"):
                self.fail("AND or OR after a condition")
            return inner
        return self.comparison()

    def operand(self) -> object:
        """A Name, or a value in a tuple of one."""
        t = self.now
        if t.word in ("+", "-") and self.tokens[self.i + 1].kind == "number":
            self.i += 1
            (v,) = self.operand()
            return (-v if t.word == "-" else v,)
        if t.kind == "number":
            self.i += 1
            return (int(t.text) if t.text.isdigit() else float(t.text),)
        if t.kind == "string":
            self.i += 1
            return (t.text[1:-1].replace("''", "'"),)
        if t.kind == "param":
            self.i += 1
            return (P.Param(t.text[1:]),)
        if t.word == "NULL":
            self.i += 1
            return (None,)
        if t.word in ("~", "+", "-", "CASE", "CAST", "EXISTS"):
            raise UnsupportedQueryError(f"{t.text} is not supported in conditions")
        return self.column()

    def comparison(self) -> P.Predicate:
        left = self.operand()
        t = self.now
        if t.word in ("+", "-", "*", "/", "%", "<<", ">>", "&", "|", "^", "(", "LIKE", "BETWEEN"):
            raise UnsupportedQueryError(f"{t.text} is not supported in conditions")
        if self.take("IS"):
            negative = self.take("NOT")
            self.need("NULL")
            p: P.Predicate = P.IsNull(self.only_column(left, t))
            return P.Not(p) if negative else p
        negative = self.take("NOT")
        if self.take("IN"):
            p = P.In(self.only_column(left, t), self.values())
            return P.Not(p) if negative else p
        if negative or t.word not in _OPS:
            self.fail("a comparison, IN or IS")
        self.i += 1
        right = self.operand()
        op = _OPS[t.word]
        if self.now.word in ("+", "-", "*", "/", "%", "<<", ">>", "&", "|", "^"):
            raise UnsupportedQueryError(f"{self.now.text} is not supported in conditions")
        if isinstance(left, Name) and isinstance(right, tuple):
            return P.Cmp(left.text, op, right[0])
        if isinstance(left, tuple) and isinstance(right, Name):
            return P.Cmp(right.text, P.mirrored(op), left[0])
        raise UnsupportedQueryError("A comparison needs one column and one value")

    def only_column(self, x: object, at: Token) -> str:
        if not isinstance(x, Name):
            raise QlSyntaxError(at.line, at.column, "expecting a column before it")
        return x.text

    def values(self) -> object:
        if self.now.kind == "param":
            self.i += 1
            return P.Param(self.tokens[self.i - 1].text[1:])
        self.need("(")
        out = []
        while not self.take(")"):
            if self.now.word == "SELECT":
                raise UnsupportedQueryError("IN takes values, not a query")
            v = self.operand()
            if not isinstance(v, tuple):
                raise UnsupportedQueryError("IN takes values, not columns")
            out.append(v[0])
            if self.now.word != ")":
                self.need(",")
        return tuple(out)


def parse(text: str) -> Statement:
    return _Parser(text).statement()


def _query(s: Select, find: Callable, params: dict):
    q = find(s.journal).bind(**params)
    for n in (*s.names,):
        P.find_column(q.source.schema, n.text, q.spec.name, f"line {n.token.line}:{n.token.column} ")
    if s.latest is not None:
        q = q.latest_by(s.latest.text, split=False)
    return q.where(s.where) if s.where is not None else q


def _amount(v: object, params: dict) -> int | None:
    if isinstance(v, P.Param):
        hit = {k.lower(): x for k, x in params.items()}
        if v.name.lower() not in hit:
            raise QueryError(f"Parameter @{v.name} has no value")
        v = hit[v.name.lower()]
    if v is not None and (isinstance(v, bool) or not isinstance(v, int)):
        raise QueryError(f"{v!r} is not a number of rows")
    return v


def _finish(q, s: Select, params: dict):
    """Slices after the order, columns last."""
    offset, top = _amount(s.offset, params), _amount(s.top, params)
    q = q.skip(offset) if offset else q
    q = q.take(top) if top is not None else q
    if all(c is None for c, _ in s.columns):
        return q
    every = [(f, None) for f in q.source.columns if f not in q.hidden]
    return q.select(*[(c if isinstance(c, str) else c.text, a) for n, a in s.columns for c, a in (every if n is None else [(n, a)])])


def run(text: str, find: Callable, params: dict, ordered: bool = True) -> DataFrame:
    """The rows of a statement; ``find`` gives the query over a journal by its name. Without ORDER BY the order may be waived."""
    st = parse(text)
    q = _query(st.first, find, params)
    if not st.more:
        if st.order:
            (c, down), *rest = st.order
            q = q.order_by(c.text, down)
            for c, down in rest:
                q = q.then_by(c.text, down)
        return _finish(q, st.first, params).to_df(ordered or bool(st.order))
    out = _finish(q, st.first, params).to_df(ordered=False)
    for op, s in st.more:
        out = compound(op, out, _finish(_query(s, find, params), s, params).to_df(ordered=False))
    if st.order:
        from .lower import order_columns

        out = out.orderBy(*order_columns(tuple((P.find_column(out.schema, c.text, st.first.journal).name, down) for c, down in st.order)))
    return out
