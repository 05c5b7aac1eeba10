from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from model import SCHEMA, holds, latest, quotes
from pyspark.sql import functions as F

from tidemark.errors import EmptyResultError, NotSingleError, QueryError, UnsupportedQueryError
from tidemark.functions.predicates import And, Cmp, In, IsNull, Not, Or, Param, col
from tidemark.query import Query
from tidemark.sources.journal import Journal
from tidemark.spec import JournalSpec, schema_of

SPEC = JournalSpec("quote", "timestamp", (), ("sym", "ex"))


@pytest.fixture(scope="module")
def q(spark):
    return Query.over(spark.createDataFrame(quotes(), SCHEMA).repartition(3, "bid").cache(), SPEC)


@pytest.fixture(scope="module")
def qn(spark):
    return Query.over(spark.createDataFrame(quotes(nulls=True), SCHEMA).repartition(3, "ask").cache(), SPEC)


def times(x) -> list[int]:
    return [r["timestamp"] for r in (x.to_df() if isinstance(x, Query) else x).collect()]


def expected(p, nulls=False) -> list[int]:
    return [r["timestamp"] for r in reversed(quotes(nulls=nulls)) if holds(p, r)]


@pytest.mark.parametrize("p", [
    col("timestamp") > 100, col("timestamp") >= 100, col("timestamp") < 7, col("timestamp") <= 7, col("timestamp") == 50, col("timestamp") != 3,
    (col("timestamp") > 10) & (col("timestamp") < 20), (col("timestamp") < 5) | (col("timestamp") >= 290), col("sym") == "Symbol_7", col("sym") != "Symbol_7",
    col("sym").isin("Symbol_1", "Symbol_3", "Symbol_1", "none"), col("sym").isin([]), (col("sym") == "Symbol_7") & (col("ex") == "Ex_7") & (col("timestamp") > 200),
    ((col("sym") == "Symbol_1") & (col("timestamp") < 50)) | ((col("sym") == "Symbol_2") & (col("timestamp") > 250)), ~(col("bid") == 3), ~((col("bid") == 3) | (col("timestamp") < 250)),
    col("mode").is_null() & (col("timestamp") < 4), col("mode").is_not_null(), col("bid_size") < -290, (col("timestamp") > 20) & (col("timestamp") < 10),
], ids=str)
def test_filters_newest_first(q, p):
    assert times(q.where(p)) == expected(p)


@pytest.mark.parametrize("p", [
    col("sym") == None, col("sym") != None, col("sym").is_null(), col("sym") != "Symbol_4", ~(col("sym") == "Symbol_4"), In("sym", ("Symbol_1", None)), ~In("sym", ("Symbol_1", None)),  # noqa: E711
    ~In("ask_size", (1, 2)), col("bid") < 2, ~(col("bid") < 2), (col("ask_size").is_null()) | (col("bid") == 4),
], ids=str)
def test_nulls_are_values(qn, p):
    p2 = IsNull("sym") if isinstance(p, Cmp) and p.value is None and p.op == "=" else Not(IsNull("sym")) if isinstance(p, Cmp) and p.value is None else p
    assert times(qn.where(p)) == expected(p2, nulls=True)


def atoms():
    return st.one_of(
        st.builds(Cmp, st.just("timestamp"), st.sampled_from(["<", "<=", ">", ">=", "=", "!="]), st.integers(-5, 305)),
        st.builds(Cmp, st.just("sym"), st.sampled_from(["=", "!="]), st.sampled_from([f"Symbol_{i}" for i in range(0, 20, 3)])),
        st.builds(Cmp, st.just("ask_size"), st.sampled_from(["<", ">=", "=", "!="]), st.integers(0, 20)),
        st.builds(In, st.sampled_from(["sym", "ex"]), st.lists(st.sampled_from(["Symbol_1", "Symbol_7", "Ex_7", None]), max_size=3).map(tuple)),
        st.builds(IsNull, st.sampled_from(["sym", "bid", "ask_size"])),
    )


TREES = st.recursive(atoms(), lambda p: st.one_of(st.builds(Not, p), st.lists(p, min_size=2, max_size=3).map(lambda x: And(tuple(x))), st.lists(p, min_size=2, max_size=3).map(lambda x: Or(tuple(x)))), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREES)
def test_random_predicates(qn, p):
    assert times(qn.where(p)) == expected(p, nulls=True)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(atoms(), st.integers(0, 300), st.sampled_from(["sym", "ask_size"]))
def test_random_latest(qn, p, t, key):
    rows = [r for r in quotes(nulls=True) if r["timestamp"] < t]
    if p.column == "timestamp":
        want = latest([r for r in rows if holds(p, r)], key)
    else:
        want = [r for r in latest(rows, key) if holds(p, r)]
    want = [r["timestamp"] for r in reversed(want)]
    assert times(qn.where(p).where(col("timestamp") < t).latest_by(key)) == want
    assert times(qn.latest_by(key).where(col("timestamp") < t).where(p)) == want


def test_latest_keeps_a_group_of_nulls(qn):
    rows = [r for r in quotes(nulls=True)]
    assert times(qn.latest_by("sym")) == [r["timestamp"] for r in reversed(latest(rows, "sym"))]
    assert any(r["sym"] is None for r in qn.latest_by("sym").to_df().collect())


def test_latest_of_equal_times_is_the_last_by_tiebreak(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "a"), (1, 2, "a"), (0, 9, "b")], "timestamp long, seq long, sym string")
    got = Query.over(df, JournalSpec("x", "timestamp", ("seq",))).latest_by("sym").to_df().collect()
    assert [(r.timestamp, r.seq) for r in got] == [(1, 3), (0, 9)]


def test_latest_over_branches_of_own_ranges(q):
    a = (col("timestamp") < 40) & (col("ex") == "Ex_3")
    b = (col("timestamp") >= 200) & (col("ex") == "Ex_5")
    assert times(q.where(a | b).latest_by("sym")) == [285, 23]
    assert times(q.latest_by("sym").where(a | b)) == [285]
    assert times(q.ql("SELECT * FROM quote LATEST BY sym WHERE (timestamp < 40 AND ex = 'Ex_3') OR (timestamp >= 200 AND ex = 'Ex_5')")) == [285]


def test_latest_over_branches_reads_once(q):
    """Many ORs, some with ranges of their own: one scan, one shuffle before the sort."""
    a = ((col("timestamp") < 100) & (col("sym") == "Symbol_3")) | ((col("timestamp") >= 200) & (col("sym") == "Symbol_5"))
    b = (col("bid") < 5) | (col("sym") == "Symbol_3")
    c = ((col("timestamp") < 250) & (col("ask") >= 0)) | (col("ask") < 0)
    plan = q.where(a).where(b).where(c).latest_by("sym").to_df(ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Union" not in plan and "max_by" in plan
    assert times(q.where(a).where(b).where(c).latest_by("sym")) == [245, 83]


def test_latest_over_branches_of_symbols_is_one_latest(q):
    p = [(col("sym") == f"Symbol_{i}") | (col("sym") == f"Symbol_{i + 1}") | (col("bid") >= 0) for i in range(12)]
    for x in p:
        q = q.where(x)
    assert "max_by" not in q.latest_by("sym").to_df(ordered=False)._jdf.queryExecution().toString() and q.latest_by("sym").count() == 20


def test_latest_needs_a_comparable_key(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"))], "timestamp long, blob binary")
    with pytest.raises(UnsupportedQueryError):
        Query.over(df, JournalSpec("x", "timestamp")).latest_by("blob").to_df()


def test_orders_and_slices(q):
    rows = quotes()
    by = lambda key, down=False: [r["timestamp"] for r in sorted(sorted(rows, key=lambda r: -r["timestamp"]), key=key, reverse=down)]
    assert times(q) == list(range(299, -1, -1))
    assert times(q.order_by("timestamp").take(5)) == [0, 1, 2, 3, 4]
    assert times(q.order_by("timestamp").reverse().take(3)) == [299, 298, 297]
    assert times(q.reverse().skip(2).take(3)) == [2, 3, 4]
    assert times(q.order_by("bid").take(70)) == by(lambda r: r["bid"])[:70]
    assert times(q.order_by("sym").then_by_desc("ask").take(20)) == [r["timestamp"] for r in sorted(rows, key=lambda r: (r["sym"], -r["ask"]))[:20]]
    assert times(q.take(10).order_by("bid").take(4)) == [r["timestamp"] for r in sorted(sorted(rows[-10:], key=lambda r: -r["timestamp"]), key=lambda r: r["bid"])[:4]]
    assert times(q.take(10).reverse().take(2)) == [290, 291]
    assert times(q.take(0)) == [] and len(times(q.take((1 << 31) - 1))) == 300


def test_timestamp_order_before_slices_if_asked(spark):
    df = spark.createDataFrame(quotes(), SCHEMA)
    q = Query.over(df, SPEC, compat_ts_order=True)
    assert times(q.take(10).reverse()) == list(range(10))
    assert times(q.take(3).order_by("timestamp")) == [0, 1, 2]


def test_nulls_come_first_ascending_and_last_descending(qn):
    asc = [r["sym"] for r in qn.order_by("sym").to_df().collect()]
    assert asc[:15] == [None] * 15 and asc[15:] == sorted(asc[15:])
    assert [r["sym"] for r in qn.order_by_desc("sym").to_df().collect()][-15:] == [None] * 15


def test_single_rows(q):
    assert q.first().timestamp == 299 and q.last().timestamp == 0
    assert q.order_by("timestamp").first(col("sym") == "Symbol_3").timestamp == 3
    assert q.order_by("timestamp").last(col("sym") == "Symbol_3").timestamp == 283
    assert q.single(col("timestamp") == 7).timestamp == 7
    assert q.first_or_none(col("timestamp") > 999) is None and q.last_or_none(col("timestamp") > 999) is None
    for f in (q.first, q.last, q.single):
        with pytest.raises(EmptyResultError):
            f(col("timestamp") > 999)
    with pytest.raises(NotSingleError):
        q.single()


def test_counts(q):
    assert q.count() == 300 and q.long_count(col("sym") == "Symbol_1") == 15 and q.skip(295).take(9).count() == 5
    assert q.latest_by("sym").count() == 20


def test_unions_hold_each_row_once(q):
    a, b = q.where(col("sym") == "Symbol_1"), q.where(col("timestamp") < 25)
    want = expected((col("sym") == "Symbol_1") | (col("timestamp") < 25))
    assert times(a.union(b)) == want and times(b.union(a)) == want
    assert times(a.latest_by("sym").union(b.take(3))) == [281, 24, 23, 22]
    with pytest.raises(QueryError):
        a.union(Query.over(q.source, JournalSpec("other", "timestamp")))


def test_direct_access(q):
    assert times(q.all()) == list(range(300)) == times(q.enumerate())
    assert times(q.all_by_symbol("SYM", "Symbol_2")) == expected(col("sym") == "Symbol_2")
    assert times(q.all_by_symbol_over_interval("sym", "Symbol_2", 22, 62)) == [42, 22]


def test_projection_is_case_insensitive(q):
    df = q.select("ASK", ("Sym", "s")).take(1).to_df()
    assert df.columns == ["ask", "s"] and df.first() == (299.0, "Symbol_19")


def test_parameters(q):
    assert times(q.bind(T=3).where(col("timestamp") < Param("t"))) == [2, 1, 0]
    assert times(q.bind(L=["Symbol_1", "Symbol_2"]).where(col("sym").isin(Param("l")) & (col("timestamp") < 30))) == [22, 21, 2, 1]
    with pytest.raises(QueryError, match="no value"):
        q.where(col("timestamp") < Param("t"))


def test_refusals(q):
    with pytest.raises(UnsupportedQueryError):
        q.take(3).where(col("sym") == "x")
    with pytest.raises(QueryError, match="does not exist"):
        q.where(col("nothing") == 1)
    with pytest.raises(QueryError):
        q.where(col("sym") == 3)
    with pytest.raises(QueryError):
        q.where(col("sym").isin("a", 3))
    with pytest.raises(QueryError):
        q.where(In("sym", "abc"))
    with pytest.raises(UnsupportedQueryError):
        Query.over(q.source, SPEC, strict=True).where(col("ask") > 3)
    with pytest.raises(UnsupportedQueryError):
        q.then_by("ask")
    with pytest.raises(UnsupportedQueryError):
        q.latest_by("sym").latest_by("ex")


def test_timestamps_without_zone(spark):
    start = datetime(2013, 1, 1)
    rows = [(start + timedelta(seconds=i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, n int")
    q = Query.over(df, JournalSpec("t", "ts"))
    assert [r.n for r in q.where(col("ts") > start + timedelta(seconds=97)).to_df().collect()] == [99, 98]
    assert [r.n for r in q.where(col("ts") <= start + timedelta(seconds=1)).to_df().collect()] == [1, 0]
    assert [r.n for r in q.where(col("ts") == "2013-01-01 00:00:05").to_df().collect()] == [5]
    ms = int((start - datetime(1970, 1, 1)).total_seconds() * 1000) + 98_000
    assert [r.n for r in q.where(col("ts") >= ms).to_df().collect()] == [99, 98]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(quotes(), SCHEMA).write.parquet(str(tmp_path / "q"))
    q = Query.over(spark.read.parquet(str(tmp_path / "q")), SPEC)
    plan = q.where((col("timestamp") >= 5) & (col("sym") == "Symbol_1")).select("ask").to_df(ordered=False)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp,5)" in plan and "EqualNullSafe(sym,Symbol_1)" in plan
    assert "ReadSchema: struct<timestamp:bigint,sym:string,ask:double>" in plan
    plan = q.latest_by("sym").to_df(ordered=False)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_field_types():
    s = schema_of(a="Byte", b="DateTime?", c="Symbol", d="Binary")
    assert s["a"].dataType.simpleString() == "smallint" and s["b"].nullable and not s["a"].nullable
    with pytest.raises(QueryError):
        schema_of(a="BitSet")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_instants_do_not_depend_on_the_zone(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(48).select("id", F.timestamp_micros(F.lit(1704412800000000) + F.col("id") * 3_600_000_000).alias("ts"))  # from 2024-01-05T00:00Z
        spec = JournalSpec("j", "ts", ("id",), (), "DAY")
        want = list(range(5, 30))
        low, high = datetime(2024, 1, 5, 5, tzinfo=timezone.utc), datetime(2024, 1, 6, 6)
        assert sorted(r.id for r in Query.over(df, spec).where(col("ts") >= low).where(col("ts") < high).to_df().collect()) == want
        j = Journal(spark, str(tmp_path / zone.replace("/", "_")), spec, df.schema)
        j.append(df)
        assert sorted(j.manifest().files) == ["2024-01-05", "2024-01-06"]
        assert sorted(r.id for r in j.read().where(col("ts") >= low).where(col("ts") < high).to_df().collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_in_reaches_the_scan_and_nothing_is_sorted(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    q = Query.over(df, JournalSpec("events", "ts", ("event_id",)))
    plan = q.ql("SELECT * FROM events WHERE user_id IN (1, 2)", ordered=False)._jdf.queryExecution().toString()
    assert "In(user_id" in plan.split("PushedFilters:")[1].split("]")[0] + "]" and "Exchange" not in plan
