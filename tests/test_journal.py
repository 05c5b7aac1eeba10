from datetime import datetime, timedelta

import pytest

from tidemark.errors import CommitConflictError, OutOfOrderError, QueryError
from tidemark.functions.predicates import col
from tidemark.sources.journal import Journal
from tidemark.spec import JournalSpec, schema_of

SCHEMA = schema_of(ts="DateTime", sym="Symbol", data="Int32?", blob="Binary")
SPEC = JournalSpec("j", "ts", (), ("sym",), "MONTH")
START = datetime(2015, 1, 1)


def frame(spark, days):
    return spark.createDataFrame([(START + timedelta(days=d), f"s{d % 3}", d if d % 4 else None, bytearray(range(d % 5))) for d in days], SCHEMA)


@pytest.fixture
def journal(spark, tmp_path):
    return Journal(spark, str(tmp_path / "j"), SPEC, SCHEMA)


def days(q) -> list[int]:
    return [(r.ts - START).days for r in q.to_df().collect()]


def test_what_is_written_is_read(spark, journal):
    assert days(journal.read()) == []
    rows = frame(spark, range(40))
    assert journal.append(rows) == 1 and journal.append(frame(spark, range(40, 70))) == 2
    again = Journal(spark, journal.path)
    assert again.schema == SCHEMA and again.spec.partition_by == "MONTH"
    assert days(again.read()) == list(range(69, -1, -1))
    assert {tuple(r) for r in again.read().to_df().collect()} == {tuple(r) for r in rows.union(frame(spark, range(40, 70))).collect()}
    assert again.read().to_df().columns == ["ts", "sym", "data", "blob"]
    assert again.manifest().rows == 70 and sorted(again.manifest().files) == ["2015-01", "2015-02", "2015-03"]


def test_a_time_range_reads_its_partitions_only(spark, journal):
    journal.append(frame(spark, range(100)))
    q = journal.read().where((col("ts") >= START + timedelta(days=35)) & (col("ts") < START + timedelta(days=37)))
    assert days(q) == [36, 35]
    plan = q.to_df()._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "2015-02" in plan and "GreaterThanOrEqual(ts" in plan
    assert days(journal.read().where((col("ts") < START + timedelta(days=2)) | (col("ts") >= START + timedelta(days=98)))) == [99, 98, 1, 0]


def test_only_files_of_the_time_range_are_opened(spark, journal):
    journal.append(frame(spark, range(60)))
    journal.append(frame(spark, range(60, 100)))
    opened = lambda q: {f.split("/p=")[1].split("/")[0] for f in q.to_df(ordered=False).inputFiles()}
    month = journal.read().where((col("ts") >= START + timedelta(days=31)) & (col("ts") < datetime(2015, 3, 1)))
    assert opened(month) == {"2015-02"} and len(month.to_df().collect()) == 28
    assert opened(journal.read()) == {"2015-01", "2015-02", "2015-03", "2015-04"}
    either = journal.read().where((col("ts") < datetime(2015, 1, 3)) | (col("ts") >= datetime(2015, 4, 1)))
    assert opened(either) == {"2015-01", "2015-04"} and days(either) == [99, 98, 97, 96, 95, 94, 93, 92, 91, 90, 1, 0]
    assert opened(month.latest_by("sym")) == {"2015-02"}
    none = journal.read().where((col("ts") > datetime(2016, 1, 1)) & (col("ts") < datetime(2015, 1, 1)))
    assert opened(none) == set() and days(none) == []


def test_appends_are_in_order(spark, journal):
    journal.append(frame(spark, [5, 3, 4]))
    assert days(journal.read()) == [5, 4, 3]
    with pytest.raises(OutOfOrderError):
        journal.append(frame(spark, [4, 9]))
    assert days(journal.read()) == [5, 4, 3]
    journal.append(frame(spark, [5, 6]))
    assert days(journal.read()) == [6, 5, 5, 4, 3]


def test_equal_times_are_in_the_order_of_appends(spark, journal):
    for n in range(3):
        journal.append(spark.createDataFrame([(START, "a", n, None)], SCHEMA))
    assert [r.data for r in journal.read().to_df().collect()] == [2, 1, 0]
    assert journal.read().latest_by("sym").single().data == 2
    journal.compact("2015-01")
    journal.append(spark.createDataFrame([(START, "a", 7, None)], SCHEMA))
    assert [r.data for r in journal.read().to_df().collect()] == [7, 2, 1, 0]


def test_readers_keep_their_snapshot(spark, journal):
    journal.append(frame(spark, range(3)))
    old = journal.read()
    with journal.writer() as w:
        w.append(frame(spark, [3]))
        assert days(journal.read()) == [2, 1, 0]
        w.append(frame(spark, [4]))
        w.commit()
        w.append(frame(spark, [5]))
    assert days(old) == [2, 1, 0] and days(journal.read()) == [4, 3, 2, 1, 0] and days(journal.read(1)) == [2, 1, 0]


def test_rollback_leaves_no_files(spark, journal):
    journal.append(frame(spark, range(3)))
    before = journal.store.files("data")
    with journal.writer() as w:
        w.append(frame(spark, [3]))
    assert journal.store.files("data") == before and journal.manifest().version == 1


def test_of_two_writers_one_commits(spark, journal):
    a, b = journal.writer(), journal.writer()
    a.append(frame(spark, [1]))
    b.append(frame(spark, [2]))
    assert a.commit() == 1
    with pytest.raises(CommitConflictError):
        b.commit()
    assert days(journal.read()) == [1]


def test_partitions_are_replaced_by_version(spark, journal):
    journal.append(frame(spark, range(40)))
    old = journal.read()
    journal.overwrite_partition("2015-01", frame(spark, []))
    assert days(journal.read()) == list(range(39, 30, -1)) and len(days(old)) == 40
    assert journal.manifest().generations == {"2015-01": 1} and journal.manifest().rows == 9
    journal.compact("2015-02", lambda df: df.where("sym = 's0'"))
    assert days(journal.read()) == [39, 36, 33]
    with pytest.raises(QueryError):
        journal.overwrite_partition("2015-02", frame(spark, [80]))


def test_truncate_and_hooks(spark, journal):
    seen = []
    journal.on_commit.append(lambda version, rows: seen.append((version, rows)))
    journal.append(frame(spark, range(3)))
    journal.truncate()
    assert days(journal.read()) == [] and seen == [(1, 3), (2, 0)]
    journal.append(frame(spark, [1]))
    assert days(journal.read()) == [1]


def test_times_are_never_null(spark, journal):
    with pytest.raises(QueryError, match="null in 1 rows"):
        journal.append(spark.createDataFrame([(None, "a", 1, None)], "ts timestamp_ntz, sym string, data int, blob binary"))


def test_opening_checks_what_is_there(spark, journal, tmp_path):
    with pytest.raises(QueryError):
        Journal(spark, journal.path, SPEC, schema_of(ts="DateTime"))
    with pytest.raises(QueryError):
        Journal(spark, journal.path, JournalSpec("j", "ts", (), (), "DAY"))
    with pytest.raises(QueryError):
        Journal(spark, str(tmp_path / "nothing"))
    with pytest.raises(QueryError):
        Journal(spark, journal.path, read_only=True).append(frame(spark, [1]))


@pytest.mark.parametrize("unit, names", [("DAY", ["1970-01-01", "1970-01-02"]), ("YEAR", ["1970"]), ("NONE", ["default"])])
def test_units_and_epoch_milliseconds(spark, tmp_path, unit, names):
    schema = schema_of(t="Int64", v="Double")
    j = Journal(spark, str(tmp_path / "m"), JournalSpec("m", "t", (), (), unit), schema)
    j.append(spark.createDataFrame([(i * 3_600_000, float(i)) for i in range(48)], schema))
    assert sorted(j.manifest().files) == names
    assert [r.v for r in j.read().where((col("t") >= 86_400_000) & (col("t") < 86_400_001)).to_df().collect()] == [24.0]


def test_a_journal_without_time_keeps_the_order_of_appends(spark, tmp_path):
    schema = schema_of(v="Int32")
    j = Journal(spark, str(tmp_path / "n"), JournalSpec("n"), schema)
    j.append(spark.createDataFrame([(1,), (2,)], schema).coalesce(1))
    j.append(spark.createDataFrame([(0,)], schema))
    assert [r.v for r in j.read().to_df().collect()] == [0, 2, 1]


def test_vacuum_keeps_what_readers_need(spark, journal):
    journal.append(frame(spark, range(5)))
    journal.append(frame(spark, range(5, 10)))
    journal.compact("2015-01")
    old, new = journal.read(2), journal.read()
    files = lambda: len(journal.store.files("data"))
    n = files()
    assert journal.vacuum(1, hours=1) == 0 and files() == n  # too young
    assert days(journal.read()) == days(new) == list(range(9, -1, -1)) and days(old) == days(new)
    with journal.writer() as w:
        w.append(frame(spark, [20]))
        assert journal.vacuum(1, hours=1) == 0
        w.commit()
    assert journal.vacuum(2, hours=0) > 0 and days(journal.read()) == [20, *range(9, -1, -1)] and days(journal.read(3)) == list(range(9, -1, -1))
    assert set(journal.store.files("data")) == {f for fs in journal.manifest().files.values() for f in fs}
    assert journal.vacuum(1, hours=0) == 0 and journal.append(frame(spark, [21])) == 5
    with pytest.raises(QueryError):
        journal.vacuum(0)


def test_closed_partitions_are_compacted(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"), SPEC, SCHEMA, compact_closed=True)
    for d in (0, 1, 2, 3):
        journal.append(frame(spark, [d]))
    assert journal.manifest().version == 4 and len(journal.manifest().files["2015-01"]) == 4
    assert journal.append(frame(spark, range(25, 35))) == 6
    m = journal.manifest()
    assert m.generations == {"2015-01": 1} and len(m.files["2015-01"]) < 4 and m.rows == 14
    assert days(journal.read()) == [*range(34, 24, -1), 3, 2, 1, 0] and days(journal.read(4)) == [3, 2, 1, 0]
    assert journal.append(frame(spark, [40])) == 7 and journal.manifest().last is not None
