from datetime import datetime

from tidemark.sources.journal import Journal
from tidemark.spec import JournalSpec
from tidemark.streaming.latest import append_stream, latest_by_stream, read_stream

SCHEMA = "ts timestamp_ntz, seq long, sym string, v int"
SPEC = JournalSpec("s", "ts", ("seq",))
ROWS = [[(datetime(2024, 1, 1, 0, i), i, None if i % 4 == 0 else f"s{i % 4}", i) for i in range(a, a + 10)] for a in (0, 10, 20)]


def batches(spark, path):
    for i, rows in enumerate(ROWS):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


def test_latest_by(spark, tmp_path):
    stream = latest_by_stream(batches(spark, str(tmp_path / "in")), SPEC, "sym")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("last").start()
    q.processAllAvailable()
    q.stop()
    assert stream.columns == ["ts", "seq", "sym", "v"]
    assert {r.sym: r.v for r in spark.table("last").collect()} == {"s1": 29, "s2": 26, "s3": 27, None: 28}


def test_appends_once(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"))
    j = Journal(spark, str(tmp_path / "j"), JournalSpec("s", "ts"), stream.schema)
    run = lambda: append_stream(stream, j, str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert j.read().count() == 30 and j.manifest().version == 3
    for p in (tmp_path / "offsets" / "commits").glob("*2*"):  # as if the driver was lost between the last commit and Spark's note of it
        p.unlink()
    run()
    assert j.read().count() == 30 and j.manifest().version == 3
