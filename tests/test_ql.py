import pytest
from model import SCHEMA, quotes

from tidemark.errors import QlSyntaxError, QueryError, UnsupportedQueryError
from tidemark.functions.predicates import And, Cmp, In, IsNull, Not, Or, Param
from tidemark.plans.ql import parse
from tidemark.query import Query
from tidemark.sources.journal import Catalog
from tidemark.spec import JournalSpec


@pytest.fixture(scope="module")
def q(spark):
    return Query.over(spark.createDataFrame(quotes(nulls=True), SCHEMA).cache(), JournalSpec("quote", "timestamp"))


def times(df) -> list[int]:
    return [r["timestamp"] for r in df.collect()]


A, B, C = Cmp("a", "=", 1), Cmp("b", "=", "x"), IsNull("c")


@pytest.mark.parametrize("text, want", [
    ("a = 1", A), ("1 = a", A), ("1 < a", Cmp("a", ">", 1)), ("@t >= a", Cmp("a", "<=", Param("t"))), ("a = -5", Cmp("a", "=", -5)), ("a = 2.5e1", Cmp("a", "=", 25.0)),
    ("a = 1 AND b = 'x' OR c IS NULL", Or((And((A, B)), C))), ("a = 1 or b = 'x' && c is null", Or((A, And((B, C))))), ("(a = 1 OR b = 'x') AND c IS NULL", And((Or((A, B)), C))),
    ("NOT a = 1 AND b = 'x'", And((Not(A), B))), ("NOT (a = 1 AND b = 'x')", Not(And((A, B)))), ("a = 1 AND b IN @v", And((A, In("b", Param("v"))))), ("b NOT IN ('x', @y)", Not(In("b", ("x", Param("y"))))),
    ("c IS NOT NULL", Not(C)), ("c = NULL", Cmp("c", "=", None)), ("t.[a b] = 'it''s'", Cmp("a b", "=", "it's")), ('"a""b" <> 1', Cmp('a"b', "!=", 1)), ("b IN ()", In("b", ())),
])
def test_conditions(text, want):
    assert parse(f"SELECT * FROM t WHERE {text}").first.where == want


def test_clauses():
    s = parse("select top 5 offset 10 a, b as x, t.c y from t latest by a where b = 1 order by a desc, b; ")
    assert (s.first.journal, s.first.latest.text, s.first.top, s.first.offset) == ("t", "a", 5, 10)
    assert [(n.text, a) for n, a in s.first.columns] == [("a", None), ("b", "x"), ("c", "y")]
    assert [(n.text, d) for n, d in s.order] == [("a", True), ("b", False)]
    assert parse("SELECT TOP 3, 4 * FROM t -- why\n/* not */").first.offset == 4
    assert [op for op, _ in parse("SELECT * FROM a UNION ALL SELECT * FROM b EXCEPT SELECT * FROM c").more] == ["UNION ALL", "EXCEPT"]


@pytest.mark.parametrize("text, at", [("SELECT", "1:6"), ("SELECT * FORM t", "1:9"), ("SELECT * FROM t WHERE", "1:21"), ("SELECT *\nFROM t WHERE a =", "2:16"), ("SELECT * FROM t WHERE a = 'x", "1:26"), ("SELECT * FROM t x y", "1:16"), ("SELECT TOP 'a' * FROM t", "1:11")])
def test_syntax_errors_have_places(text, at):
    with pytest.raises(QlSyntaxError, match=f"line {at} "):
        parse(text)


@pytest.mark.parametrize("text", [
    "SELECT a FROM t GROUP BY a", "SELECT a FROM t WHERE a = 1 HAVING a = 2", "SELECT DISTINCT a FROM t", "SELECT a FROM t JOIN u", "SELECT a FROM t, u", "SELECT count(a) FROM t", "SELECT a + b FROM t", "SELECT 1 FROM t",
    "SELECT a FROM t WHERE a + 1 = 2", "SELECT a FROM t WHERE a = b + 1", "SELECT a FROM t WHERE lower(a) = 'x'", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT a FROM t WHERE a BETWEEN 1 AND 2",
    "SELECT a FROM t WHERE a IN (SELECT b FROM u)", "SELECT a FROM t WHERE a = b", "SELECT a FROM t WHERE CASE a = 1", "SELECT a FROM t WHERE ~a = 1",
])
def test_what_isnt_supported_is_refused(text):
    with pytest.raises(UnsupportedQueryError):
        parse(text)


def test_rows(q):
    assert times(q.ql("SELECT * FROM quote WHERE timestamp > 296")) == [299, 298, 297]
    assert times(q.ql("SELECT * FROM quote WHERE sym IN @s AND timestamp < 30", S=["Symbol_7", "Symbol_8"])) == [28, 27, 8, 7]
    assert times(q.ql("SELECT TOP 2 OFFSET 1 * FROM quote WHERE sym = 'Symbol_3' ORDER BY timestamp")) == [23, 43]
    assert times(q.ql("SELECT TOP @n * FROM quote", N=2)) == [299, 298]
    assert times(q.ql("SELECT * FROM quote LATEST BY sym WHERE timestamp < 10 ORDER BY timestamp")) == list(range(10))
    assert times(q.ql("SELECT * FROM quote WHERE sym IS NULL AND timestamp < 50")) == [40, 20, 0]
    df = q.ql("SELECT Ask AS price, quote.* FROM quote WHERE timestamp = 4")
    assert df.columns == ["price", "timestamp", "sym", "bid", "ask", "bid_size", "ask_size", "mode", "ex"]
    assert df.first()["price"] == 4.0


def test_errors_name_columns_and_parameters(q):
    with pytest.raises(QueryError, match=r"line 1:7 Column \[nothing\] does not exist in journal quote"):
        q.ql("SELECT nothing FROM quote")
    with pytest.raises(QueryError, match="@t has no value"):
        q.ql("SELECT * FROM quote WHERE timestamp < @t")
    with pytest.raises(QueryError, match="needs a list"):
        q.ql("SELECT * FROM quote WHERE sym IN @t", t="abc")
    with pytest.raises(QueryError, match="number of rows"):
        q.ql("SELECT TOP @t * FROM quote", t="abc")


def test_compound(q):
    a, b = "SELECT sym FROM quote WHERE timestamp < 5", "SELECT sym FROM quote WHERE timestamp >= 3 AND timestamp < 8"
    names = lambda df: sorted(r[0] or "" for r in df.collect())
    s = lambda *n: [f"Symbol_{i}" for i in n]
    assert names(q.ql(f"{a} UNION {b}")) == ["", *s(1, 2, 3, 4, 5, 6, 7)]
    assert names(q.ql(f"{a} UNION ALL {b}")) == ["", *s(1, 2, 3, 3, 4, 4, 5, 6, 7)]
    assert names(q.ql(f"{a} INTERSECT {b}")) == s(3, 4)
    assert names(q.ql(f"{a} EXCEPT {b}")) == ["", *s(1, 2)]
    assert [r[0] for r in q.ql(f"{a} UNION {b} ORDER BY sym DESC").collect()] == [*s(7, 6, 5, 4, 3, 2, 1), None]
    with pytest.raises(QueryError):
        q.ql(f"{a} UNION SELECT sym, ex FROM quote")


def test_catalog(q):
    c = Catalog(quote=q)
    c.register("Other", q.where(Cmp("timestamp", "<", 3)))
    assert times(c.ql("SELECT * FROM other UNION SELECT * FROM QUOTE WHERE timestamp = 7 ORDER BY timestamp")) == [0, 1, 2, 7]
    with pytest.raises(QueryError, match="no journal"):
        c.ql("SELECT * FROM missing")
