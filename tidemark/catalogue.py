"""The engine's queries by name over the TPC-H-like tables, each with the SQL that says the same.

Rows are compared as sets, so a query skips the final sort unless order decides which rows it returns.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import Param, col
from .query import Query
from .sources.journal import Catalog, Journal
from .sources.scratch import scratch_path
from .spec import JournalSpec
from .streaming.latest import append_stream, latest_by_stream, read_stream

EVENTS = JournalSpec("events", "ts", ("event_id",), ("event_type",), "DAY")
ORDERS = JournalSpec("orders", "o_orderdate", ("o_orderkey",), ("o_orderstatus", "o_orderpriority"), "MONTH")
LINEITEM = JournalSpec(
    "lineitem", "l_shipdate",
    ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"),
    ("l_returnflag", "l_linestatus"), "MONTH",
)

A, B, C, D = datetime(2024, 1, 5), datetime(2024, 1, 10, 12), datetime(2024, 1, 20), datetime(2024, 1, 25, 6, 30)
DAY = datetime(1995, 3, 15)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str, **options) -> Query:
    return Query.over(spark.read.parquet(f"{sf_dir}/events.parquet"), EVENTS, **options)


def events_with_nulls(spark: SparkSession, sf_dir: str) -> Query:
    """Events whose type is null instead of ``error``, and whose value is null below 5."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumn("event_type", F.nullif("event_type", F.lit("error"))).withColumn("value", F.when(F.col("value") >= 5, F.col("value")))
    return Query.over(df, EVENTS)


def orders(spark: SparkSession, sf_dir: str) -> Query:
    return Query.over(spark.read.parquet(f"{sf_dir}/orders.parquet"), ORDERS)


def lineitem(spark: SparkSession, sf_dir: str) -> Query:
    return Query.over(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), LINEITEM)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(events=events(spark, sf_dir), orders=orders(spark, sf_dir), lineitem=lineitem(spark, sf_dir), events_with_nulls=events_with_nulls(spark, sf_dir))


def _add(name: str, sql: str, query: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _ql(name: str, text: str, sql: str, **params) -> None:
    """A statement of the query language."""
    _add(name, sql, lambda spark, sf_dir: catalog(spark, sf_dir).ql(text, ordered=False, **params))


def _fluent(name: str, sql: str, build: Callable[[Query], Query | DataFrame], source: Callable = events) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = build(source(spark, sf_dir))
        return q.to_df(ordered=False) if isinstance(q, Query) else q

    _add(name, sql, run)


def _latest(key: str, where: str = "", table: str = "events") -> str:
    return f"SELECT * FROM {table} {where} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ts DESC, event_id DESC) = 1"


_NULLS = "(SELECT * REPLACE (nullif(event_type, 'error') AS event_type, CASE WHEN value >= 5 THEN value END AS value) FROM events)"
_a, _b, _c, _d = (f"TIMESTAMP '{t}'" for t in (A, B, C, D))
_NEWEST = "ts DESC, event_id DESC"

# scans and time

_fluent("scan_all", "SELECT * FROM events", lambda q: q)
_fluent("scan_oldest_first", "SELECT * FROM events", lambda q: q.all())
for _name, _op in (("ts_gt", ">"), ("ts_ge", ">="), ("ts_lt", "<"), ("ts_le", "<=")):
    _ql(_name, f"SELECT * FROM events WHERE ts {_op} @t", f"SELECT * FROM events WHERE ts {_op} {_b}", t=B)
_ql("ts_eq", "SELECT * FROM orders WHERE o_orderdate = @t", f"SELECT * FROM orders WHERE o_orderdate = TIMESTAMP '{DAY}'", t=DAY)
_ql("ts_ne", "SELECT * FROM orders WHERE o_orderdate <> @t", f"SELECT * FROM orders WHERE o_orderdate <> TIMESTAMP '{DAY}'", t=DAY)
_ql("ts_epoch_ms", "SELECT * FROM events WHERE ts >= 1704412800000 AND ts < 1704499200000", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
_ql("ts_interval", "SELECT * FROM events WHERE ts >= @a AND ts < @b", f"SELECT * FROM events WHERE ts >= {_a} AND ts < {_b}", a=A, b=B)
_ql(
    "ts_multi_interval", "SELECT * FROM events WHERE (ts >= @a AND ts < @b) OR (ts >= @c AND ts < @d)",
    f"SELECT * FROM events WHERE (ts >= {_a} AND ts < {_b}) OR (ts >= {_c} AND ts < {_d})", a=A, b=B, c=C, d=D,
)
_ql("ts_literal_left", "SELECT * FROM events WHERE @t <= ts", f"SELECT * FROM events WHERE {_c} <= ts", t=C)

# equality, IN, nulls, connectives

_fluent("sym_eq", "SELECT * FROM events WHERE event_type = 'click'", lambda q: q.all_by_symbol("event_type", "click"))
_fluent("sym_eq_interval", f"SELECT * FROM events WHERE event_type = 'click' AND ts >= {_a} AND ts < {_b}", lambda q: q.all_by_symbol_over_interval("event_type", "click", A, B))
_ql("sym_in_list", "SELECT * FROM events WHERE event_type IN ('click', 'view', 'click', 'nothing')", "SELECT * FROM events WHERE event_type IN ('click', 'view')")
_ql("sym_in_empty", "SELECT * FROM events WHERE event_type IN @list", "SELECT * FROM events WHERE false", list=[])
_ql("sym_in_param", "SELECT * FROM events WHERE event_type IN @list", "SELECT * FROM events WHERE event_type IN ('signup', 'error')", list=["signup", "error"])
_ql("sym_in_mixed", "SELECT * FROM events WHERE event_type IN (@x, 'view')", "SELECT * FROM events WHERE event_type IN ('error', 'view')", x="error")
_ql("sym_in_null", "SELECT * FROM events_with_nulls WHERE event_type IN ('view', NULL)", f"SELECT * FROM {_NULLS} WHERE event_type = 'view' OR event_type IS NULL")
_ql("sym_ne_null_safe", "SELECT * FROM events_with_nulls WHERE event_type <> 'click'", f"SELECT * FROM {_NULLS} WHERE event_type IS DISTINCT FROM 'click'")
_ql("is_null", "SELECT * FROM events_with_nulls WHERE event_type IS NULL", f"SELECT * FROM {_NULLS} WHERE event_type IS NULL")
_ql("is_not_null", "SELECT * FROM events_with_nulls WHERE value IS NOT NULL", f"SELECT * FROM {_NULLS} WHERE value IS NOT NULL")
_ql("eq_null_synonym", "SELECT * FROM events_with_nulls WHERE value = NULL", f"SELECT * FROM {_NULLS} WHERE value IS NULL")
_ql("ne_null_synonym", "SELECT * FROM events_with_nulls WHERE event_type <> NULL", f"SELECT * FROM {_NULLS} WHERE event_type IS NOT NULL")
_ql(
    "and_or_mix", "SELECT * FROM events WHERE ts < @b AND event_type = 'click' OR user_id IN (1, 2, 3) AND event_type <> 'view'",
    f"SELECT * FROM events WHERE (ts < {_b} AND event_type = 'click') OR (user_id IN (1, 2, 3) AND event_type <> 'view')", b=B,
)
_ql("ts_or_symbol", "SELECT * FROM events WHERE ts > @d OR event_type = 'signup'", f"SELECT * FROM events WHERE ts > {_d} OR event_type = 'signup'", d=D)
_ql(
    "same_symbol_own_ranges", "SELECT * FROM events WHERE (event_type = 'click' AND ts < @a) OR (event_type = 'view' AND ts > @d)",
    f"SELECT * FROM events WHERE (event_type = 'click' AND ts < {_a}) OR (event_type = 'view' AND ts > {_d})", a=A, d=D,
)
_ql(
    "not_paren", "SELECT * FROM events_with_nulls WHERE NOT (event_type = 'click' OR value < 20) && ts >= @a",
    f"SELECT * FROM {_NULLS} WHERE NOT (coalesce(event_type = 'click', false) OR coalesce(value < 20, false)) AND ts >= {_a}", a=A,
)
_fluent("where_after_where", f"SELECT * FROM events WHERE event_type = 'click' AND user_id <> 3 AND ts >= {_c}", lambda q: q.where(col("event_type") == "click").where(col("user_id") != 3).where(col("ts") >= C))
_ql("eq_int64", "SELECT * FROM events WHERE user_id = 3", "SELECT * FROM events WHERE user_id = 3")
_ql("eq_int32", "SELECT * FROM lineitem WHERE l_linenumber = 7", "SELECT * FROM lineitem WHERE l_linenumber = 7")
_ql("eq_double", "SELECT * FROM lineitem WHERE l_quantity = 17", "SELECT * FROM lineitem WHERE l_quantity = 17")
_ql("in_int64", "SELECT * FROM events WHERE user_id IN (1, 4, 9, 9)", "SELECT * FROM events WHERE user_id IN (1, 4, 9)")
_ql("range_any_column", "SELECT * FROM events WHERE value > 50 AND value <= 75.5", "SELECT * FROM events WHERE value > 50 AND value <= 75.5")
_fluent("bind_parameter", "SELECT * FROM events WHERE user_id = 5 AND event_type = 'view'", lambda q: q.bind(USER=5, kind="view").where((col("user_id") == Param("user")) & (col("event_type") == Param("Kind"))))

# projection

_ql("project_cols", "SELECT user_id, TS FROM events WHERE event_type = 'view'", "SELECT user_id, ts FROM events WHERE event_type = 'view'")
_ql("project_alias", "SELECT e.ts, [value] AS v, \"user_id\" u FROM events WHERE value < 10", "SELECT ts, value AS v, user_id AS u FROM events WHERE value < 10")
_fluent("project_fluent", "SELECT event_id, event_type AS kind FROM events", lambda q: q.select("event_id", ("event_type", "kind")))

# LATEST BY

_ql("latest_by_symbol", "SELECT * FROM events LATEST BY event_type", _latest("event_type"))
_ql("latest_by_int", "SELECT * FROM events LATEST BY user_id", _latest("user_id"))
_ql("latest_by_asof", "SELECT * FROM events LATEST BY user_id WHERE ts < @t", _latest("user_id", f"WHERE ts < {_b}"), t=B)
_ql("latest_by_post_filter", "SELECT * FROM events LATEST BY user_id WHERE event_type = 'click'", f"SELECT * FROM ({_latest('user_id')}) WHERE event_type = 'click'")
_ql(
    "latest_by_asof_post_filter", "SELECT * FROM events LATEST BY user_id WHERE value > 10 AND ts >= @a AND ts < @c",
    f"SELECT * FROM ({_latest('user_id', f'WHERE ts >= {_a} AND ts < {_c}')}) WHERE value > 10", a=A, c=C,
)
_ql("latest_by_keys", "SELECT * FROM events LATEST BY user_id WHERE user_id IN (1, 2, 5, 1)", _latest("user_id", "WHERE user_id IN (1, 2, 5)"))
_fluent("latest_by_or", f"SELECT * FROM ({_latest('user_id')}) WHERE event_type = 'click' OR user_id IN (1, 2)", lambda q: q.where((col("event_type") == "click") | col("user_id").isin(1, 2)).latest_by("user_id"))
_fluent(
    "latest_by_branch_ranges",
    f"SELECT * FROM ({_latest('user_id', f'WHERE ts < {_a}')}) WHERE event_type = 'click' UNION SELECT * FROM ({_latest('user_id', f'WHERE ts >= {_c}')}) WHERE event_type = 'view'",
    lambda q: q.where(((col("ts") < A) & (col("event_type") == "click")) | ((col("ts") >= C) & (col("event_type") == "view"))).latest_by("user_id"),
)
_ql(
    "latest_by_ql_or", "SELECT * FROM events LATEST BY user_id WHERE (ts < @a AND event_type = 'click') OR (ts >= @c AND event_type = 'view')",
    f"SELECT * FROM ({_latest('user_id', f'WHERE ts < {_a} OR ts >= {_c}')}) WHERE (ts < {_a} AND event_type = 'click') OR (ts >= {_c} AND event_type = 'view')", a=A, c=C,
)
_ql("latest_by_null_key", "SELECT * FROM events_with_nulls LATEST BY event_type", _latest("event_type", table=_NULLS))
_ql(
    "latest_by_orders", "SELECT * FROM orders LATEST BY o_custkey WHERE o_orderdate < @t",
    f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{DAY}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1", t=DAY,
)

# orders, slices, single rows

_ql("order_by_ts_top", "SELECT TOP 10 * FROM events ORDER BY ts", "SELECT * FROM events ORDER BY ts, event_id LIMIT 10")
_ql("order_by_ts_desc_top", "SELECT TOP 10 * FROM events ORDER BY ts DESC", f"SELECT * FROM events ORDER BY {_NEWEST} LIMIT 10")
_ql("top_default_order", "SELECT TOP 7 * FROM events WHERE event_type = 'error'", f"SELECT * FROM events WHERE event_type = 'error' ORDER BY {_NEWEST} LIMIT 7")
_ql("top_zero", "SELECT TOP 0 * FROM events", "SELECT * FROM events LIMIT 0")
_ql("top_offset", "SELECT TOP 10 OFFSET 20 * FROM events", f"SELECT * FROM events ORDER BY {_NEWEST} LIMIT 10 OFFSET 20")
_ql("top_comma_params", "SELECT TOP @n, @m * FROM events ORDER BY ts", "SELECT * FROM events ORDER BY ts, event_id LIMIT 5 OFFSET 15", n=5, m=15)
_ql("order_by_value_top", "SELECT TOP 25 * FROM events ORDER BY value", f"SELECT * FROM events ORDER BY value, {_NEWEST} LIMIT 25")
_ql("order_by_nulls_top", "SELECT TOP 600 * FROM events_with_nulls ORDER BY value", f"SELECT * FROM {_NULLS} ORDER BY value NULLS FIRST, {_NEWEST} LIMIT 600")
_ql("order_by_nulls_desc_top", "SELECT TOP 9800 * FROM events_with_nulls ORDER BY value DESC", f"SELECT * FROM {_NULLS} ORDER BY value DESC NULLS LAST, {_NEWEST} LIMIT 9800")
_ql("order_by_two_top", "SELECT TOP 30 * FROM orders ORDER BY o_orderpriority DESC, o_totalprice", "SELECT * FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderdate DESC, o_orderkey DESC LIMIT 30")
_fluent("then_by_desc_top", f"SELECT * FROM events ORDER BY event_type, value DESC, {_NEWEST} LIMIT 20", lambda q: q.order_by("event_type").then_by_desc("value").take(20))
_fluent("take_then_order", f"SELECT * FROM (SELECT * FROM events ORDER BY {_NEWEST} LIMIT 20) ORDER BY value, {_NEWEST} LIMIT 5", lambda q: q.take(20).order_by("value").take(5))
_fluent("skip_take", f"SELECT * FROM events ORDER BY {_NEWEST} LIMIT 15 OFFSET 100", lambda q: q.skip(100).take(15))
_fluent("reverse_take", "SELECT * FROM events ORDER BY ts, event_id LIMIT 10", lambda q: q.reverse().take(10))
_fluent("take_then_reverse", f"SELECT * FROM (SELECT * FROM events ORDER BY {_NEWEST} LIMIT 10) ORDER BY ts, event_id LIMIT 4", lambda q: q.take(10).reverse().take(4))
_add("take_reverse_compat", "SELECT * FROM events ORDER BY ts, event_id LIMIT 10", lambda spark, sf_dir: events(spark, sf_dir, compat_ts_order=True).take(10).reverse().to_df())
_fluent("count_all", "SELECT count(*) AS cnt FROM events", lambda q: q.count_df())
_fluent("count_where", f"SELECT count(*) AS cnt FROM events WHERE event_type = 'click' AND ts < {_b}", lambda q: q.where(col("event_type") == "click").count_df(col("ts") < B))
_fluent("count_slice", "SELECT count(*) AS cnt FROM (SELECT * FROM events LIMIT 100 OFFSET 50)", lambda q: q.skip(50).take(100).count_df())
_fluent("first", f"SELECT * FROM events ORDER BY {_NEWEST} LIMIT 1", lambda q: q.first_df())
_fluent("first_pred", "SELECT * FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1", lambda q: q.order_by("ts").first_df(col("event_type") == "signup"))
_fluent("last", "SELECT * FROM events ORDER BY ts, event_id LIMIT 1", lambda q: q.last_df())
_fluent("last_pred", f"SELECT * FROM events WHERE user_id = 2 ORDER BY {_NEWEST} LIMIT 1", lambda q: q.order_by("ts").last_df(col("user_id") == 2))
_fluent("single", "SELECT * FROM events WHERE event_id = 42", lambda q: q.source.sparkSession.createDataFrame([q.single(col("event_id") == 42)], q.source.schema))

# set operations

_fluent(
    "union_queries", f"SELECT * FROM events WHERE (event_type = 'click' AND ts < {_b}) OR user_id = 7",
    lambda q: q.where(col("event_type") == "click").where(col("ts") < B).union(q.where(col("user_id") == 7)),
)
_fluent("intersect_queries", "SELECT * FROM events WHERE user_id = 7 INTERSECT SELECT * FROM events WHERE event_type = 'click'", lambda q: q.where(col("user_id") == 7).intersect(q.where(col("event_type") == "click")))
_fluent("except_queries", "SELECT * FROM events WHERE user_id = 7 EXCEPT SELECT * FROM events WHERE event_type = 'click'", lambda q: q.where(col("user_id") == 7).except_(q.where(col("event_type") == "click")))
_fluent("concat_distinct", "SELECT * FROM events WHERE user_id IN (7, 8)", lambda q: q.where(col("user_id") == 7).concat(q.where(col("user_id").isin(7, 8))).distinct())
_fluent("union_latest", f"({_latest('user_id', f'WHERE ts < {_b}')}) UNION ({_latest('user_id')})", lambda q: q.where(col("ts") < B).latest_by("user_id").union(q.latest_by("user_id")))
for _name, _op in (("ql_union", "UNION"), ("ql_union_all", "UNION ALL"), ("ql_intersect", "INTERSECT"), ("ql_except", "EXCEPT")):
    _sql = f"SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '{B}' {_op} SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{B}' AND value > 40"
    _ql(_name, _sql.replace(f"TIMESTAMP '{B}'", "@b"), _sql, b=B)
_ql(
    "ql_compound_order", "SELECT user_id FROM events WHERE value > 90 UNION SELECT o_custkey FROM orders WHERE o_orderdate = @t ORDER BY user_id DESC",
    f"SELECT user_id FROM events WHERE value > 90 UNION SELECT o_custkey FROM orders WHERE o_orderdate = TIMESTAMP '{DAY}'", t=DAY,
)

# other journals

_ql("orders_interval", "SELECT * FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' AND o_orderstatus = 'F'", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
_ql("orders_in_priority", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 200000")
_ql("lineitem_interval", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= @a AND l_shipdate < @b", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01'", a=datetime(1997, 1, 1), b=datetime(1997, 7, 1))
_ql("lineitem_flags", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_shipdate < '1996-06-01'", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_shipdate < TIMESTAMP '1996-06-01'")
_fluent("lineitem_count", "SELECT count(*) AS cnt FROM lineitem WHERE l_returnflag = 'A'", lambda q: q.count_df(col("l_returnflag") == "A"), lineitem)
_ql(
    "lineitem_latest", "SELECT l_suppkey, l_shipdate FROM lineitem LATEST BY l_suppkey WHERE l_shipdate < '1998-01-01'",
    "SELECT l_suppkey, max(l_shipdate) AS l_shipdate FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey",
)


# journals on disk


def _new_journal(spark: SparkSession, spec: JournalSpec, df: DataFrame) -> Journal:
    return Journal(spark, scratch_path(spark, spec.name), spec, df.schema)


def journal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two commits and read back."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = _new_journal(spark, EVENTS, df)
    j.append(df.where(F.col("ts") < F.lit(str(B)).cast("timestamp_ntz")))
    j.append(df.where(F.col("ts") >= F.lit(str(B)).cast("timestamp_ntz")))
    return Journal(spark, j.path, read_only=True).read().to_df(ordered=False)


def journal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly partitions of orders, of which a time range reads few."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    j = _new_journal(spark, ORDERS, df)
    j.append(df)
    return j.read().ql("SELECT * FROM orders WHERE o_orderdate >= '1996-02-10' AND o_orderdate < '1996-05-03' AND o_orderstatus <> 'P'")


def journal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = _new_journal(spark, EVENTS, df)
    j.append(df)
    return j.read().where(col("ts") < C).latest_by("user_id").to_df(ordered=False)


def snapshot_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader opened before the second commit; a third batch is rolled back."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    j = _new_journal(spark, EVENTS, df)
    j.append(df.where(F.col("ts") < cut(A)))
    reader = j.read()
    j.append(df.where((F.col("ts") >= cut(A)) & (F.col("ts") < cut(B))))
    with j.writer() as w:
        w.append(df.where(F.col("ts") >= cut(B)))
    return reader.select("event_id", "ts").to_df(ordered=False).withColumn("version", F.lit(1)).unionByName(j.read().select("event_id", "ts").to_df(ordered=False).withColumn("version", F.lit(2)))


def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day replaced by its purchases, then compacted."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = _new_journal(spark, EVENTS, df)
    j.append(df)
    day = j.read().where(col("ts") >= datetime(2024, 1, 6)).where(col("ts") < datetime(2024, 1, 7)).where(col("event_type") == "purchase")
    j.overwrite_partition("2024-01-06", day.to_df(ordered=False))
    j.compact("2024-01-06")
    return j.read().to_df(ordered=False)


def _finished(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may be one file, which a stream reads only by a pattern."""
    return read_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet").schema)


def stream_latest_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running latest row of each user once the stream has caught up."""
    last = latest_by_stream(_event_stream(spark, sf_dir), EVENTS, "user_id")
    out, checkpoint = scratch_path(spark, "latest"), scratch_path(spark, "offsets")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    _finished(last.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start())
    return spark.read.schema(last.schema).parquet(out)


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream appended to a journal."""
    stream = _event_stream(spark, sf_dir)
    j = _new_journal(spark, EVENTS, stream)
    _finished(append_stream(stream, j, scratch_path(spark, "offsets")).trigger(availableNow=True).start())
    return j.read().where(col("event_type") == "view").to_df(ordered=False)


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thing that the engine refuses, with the error it gives."""
    q = events(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = _new_journal(spark, EVENTS, df)
    j.append(df.where(F.col("ts") >= F.lit(str(B)).cast("timestamp_ntz")))
    tried = {
        "where after take": lambda: q.take(5).where(col("user_id") == 1), "arithmetic": lambda: q.ql("SELECT * FROM events WHERE user_id + 1 = 2"), "join": lambda: q.ql("SELECT * FROM events, orders"),
        "single of many": lambda: q.single(col("event_type") == "click"), "single of none": lambda: q.single(col("event_id") == -1), "first of none": lambda: q.first(col("event_id") == -1),
        "append before the last row": lambda: j.append(df.where(F.col("ts") < F.lit(str(A)).cast("timestamp_ntz"))), "first of none, or none": lambda: q.first_or_none(col("event_id") == -1),
    }
    rows = []
    for what, call in tried.items():
        try:
            rows.append((what, "none" if call() is None else "accepted"))
        except (ValueError, RuntimeError) as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


def journal_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal emptied, and begun anew with earlier rows."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    j = _new_journal(spark, ORDERS, df)
    j.append(df.where(F.col("o_orderdate") >= F.lit(str(DAY)).cast("timestamp_ntz")))
    j.truncate()
    j.append(df.where(F.col("o_orderdate") < F.lit(str(DAY)).cast("timestamp_ntz")))
    return j.read().to_df(ordered=False)


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ranges over a column of instants (TIMESTAMP), from the epoch in microseconds."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))))
    return Query.over(df, EVENTS).where(col("ts") >= A.replace(tzinfo=timezone.utc)).where(col("ts") < B).select("event_id", "event_type").to_df(ordered=False)


_add("refused", "SELECT * FROM (VALUES ('where after take', 'UnsupportedQueryError'), ('arithmetic', 'UnsupportedQueryError'), ('join', 'UnsupportedQueryError'), ('single of many', 'NotSingleError'), ('single of none', 'EmptyResultError'), ('first of none', 'EmptyResultError'), ('append before the last row', 'OutOfOrderError'), ('first of none, or none', 'none')) t(what, error)", refused)
_add("journal_truncate", f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{DAY}'", journal_truncate)
_add("instants", f"SELECT event_id, event_type FROM events WHERE ts >= {_a} AND ts < {_b}", instants)
_add("journal_roundtrip", "SELECT * FROM events", journal_roundtrip)
_add("journal_interval", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-10' AND o_orderdate < TIMESTAMP '1996-05-03' AND o_orderstatus <> 'P'", journal_interval)
_add("journal_latest", _latest("user_id", f"WHERE ts < {_c}"), journal_latest)
_add("snapshot_isolation", f"SELECT event_id, ts, 1::integer AS version FROM events WHERE ts < {_a} UNION ALL SELECT event_id, ts, 2::integer AS version FROM events WHERE ts < {_b}", snapshot_isolation)
_add("partition_overwrite", "SELECT * FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-07') OR event_type = 'purchase'", partition_overwrite)
_add("stream_latest_by", _latest("user_id"), stream_latest_by)
_add("stream_append", "SELECT * FROM events WHERE event_type = 'view'", stream_append)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each type as of a point in time, in order of time."""
    return catalog(spark, sf_dir).ql("SELECT * FROM events LATEST BY event_type WHERE ts < @t ORDER BY ts", t=C)


_add("flagship", _latest("event_type", f"WHERE ts < {_c}"), flagship)
