"""LATEST BY over a stream, and journals as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import JournalSpec


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below a path as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def latest_by_stream(stream: DataFrame, spec: JournalSpec, key: str) -> DataFrame:
    """The last row of each key so far; for output modes ``update`` and ``complete``. State is a row for each key.

    Rows may come in any order: a late row counts if it is the key's last by time. State grows with the keys, and stays.
    """
    rest = [c for c in stream.columns if c != key]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in spec.order_key])).alias("_row")
    return stream.groupBy(F.col(f"`{key}`")).agg(last).select(*[F.col(f"`{key}`") if c == key else F.col(f"_row.`{c}`").alias(c) for c in stream.columns])


def append_stream(stream: DataFrame, journal, checkpoint: str):
    """Appends each micro-batch to a journal. The manifest names the last batch of each checkpoint, so one that was committed before a failure is not appended again."""

    def each(batch: DataFrame, number: int) -> None:
        if journal.manifest().streams.get(checkpoint, -1) < number:
            with journal.writer() as w:
                w.append(batch)
                w.commit(stream=(checkpoint, number))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
