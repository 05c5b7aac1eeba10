import re

import duckdb
import pytest
from brute import frame, words

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def fill(sizes: dict, max_epochs: int = 3) -> dict:
    """Targets by rounds of clamping and sharing out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        each = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * each > max_epochs * sizes[s]}
        for s in over or free:
            target[s] = max_epochs * sizes[s] if over else weight[s] * each
        left -= sum(target[s] for s in over)
        free -= over or free
    return target


def by_source(rows, plan):
    out: dict = {}
    source = {r[0]: r[2] for r in rows}
    for r in plan:
        out.setdefault(source[r.doc_id], []).append(r)
    return out


def check(rows, plan):
    assert len(plan) == len(rows)
    text = {r[0]: r[1] for r in rows}
    groups = by_source(rows, plan)
    sizes = {s: sum(r.size for r in g) for s, g in groups.items()}
    want = fill(sizes)
    for s, g in groups.items():
        taken, largest = sum(r.taken for r in g), max(r.size for r in g)
        for r in g:
            assert r.size == len(words(text[r.doc_id])) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.repeats
        assert abs(taken - want[s]) <= largest / 2 + 1


def test_documents(spark, larger):
    rows = [tuple(r) for r in larger("documents").select("doc_id", "text", "source").collect()]
    plan = mixing.plan(frame(spark, rows, SCHEMA)).collect()
    check(rows, plan)
    again = mixing.plan(frame(spark, rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(again) == sorted(plan)
    assert sorted(mixing.plan(frame(spark, rows, SCHEMA), seed=1).collect()) != sorted(plan)


def test_a_hot_source_and_small_ones(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 20}") for i in range(400)] + [(1000, "one two", None), (1001, None, "empty"), (1002, "", "zero"), (1003, "x " * 9, "Ä")]
    check(rows, mixing.plan(frame(spark, rows, SCHEMA)).collect())


def test_plan_against_sql(spark, larger):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    got = sorted(mixing.plan(larger("documents")).drop("repeats").collect())
    assert [tuple(r) for r in got] == want


def test_rows_that_differ_in_a_map_only(spark):
    docs = spark.createDataFrame([(1, "a b", "x", {"k": 1}), (1, "a b", "x", {"k": 2})], "doc_id long, text string, source string, extra map<string,int>")
    assert sorted(r.extra["k"] for r in mixing.mix(docs).collect()) == [1, 2]


def test_a_hot_row_is_taken_in_part(spark):
    rows = [(1, "a b c", "x")] * 3000 + [(i, "w " * (1 + i % 9), "y") for i in range(10, 400)] + [(5, "z " * 50, "z")]
    plan = mixing.plan(frame(spark, rows, SCHEMA)).collect()
    hot = [r for r in plan if r.doc_id == 1]
    assert abs(sum(r.taken for r in hot) - hot[0].target) < 0.05 * hot[0].target and max(r.repeats for r in hot) <= 3


def test_odd_rows(spark):
    assert mixing.plan(frame(spark, [], SCHEMA)).collect() == []
    got = mixing.plan(frame(spark, [(1, None, None), (2, "", None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    got = mixing.plan(frame(spark, [(None, "a b", "x"), (None, "a b", "x"), (7, "a b", "x")], SCHEMA)).collect()
    assert sum(r.taken for r in got) == 6
    assert [r.size for r in mixing.plan(frame(spark, [(1, "a\x1cb c\x0bd", "x")], SCHEMA)).collect()] == [2]


def test_rows_are_repeated_whole(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 3}", i) for i in range(60)], "doc_id long, text string, source string, _often int")
    plan = {r.doc_id: r.repeats for r in mixing.plan(docs).collect()}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    count: dict[int, int] = {}
    for r in got.collect():
        assert r["_often"] == r.doc_id
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: n for i, n in plan.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0
    twins = spark.createDataFrame([(None, "a b", "x", 1), (None, "a b", "x", 2), (7, "a b", "x", 3), (7, "a b", "x", 3)], docs.schema)
    assert sorted(r[3] for r in mixing.mix(twins).collect()) == [1, 2, 3, 3]


def test_no_python_on_the_way(spark, small):
    plan = mixing.plan(small("documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
