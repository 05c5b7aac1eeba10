"""Journals on shared storage: Parquet files, and a log of manifests that says which of them count.

    <path>/data/c=<commit>/p=<partition>/part-*.parquet     files of one commit, by time partition
    <path>/_log/<version>.json                              the files of a version

A commit is the creation of the next manifest, by a rename that fails if it exists: readers see all of a
commit or none of it, and of two writers one fails. A reader keeps the version it opened. Files go through
Hadoop's file systems, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflictError, OutOfOrderError, QueryError
from ..plans.intervals import DateRange, before
from ..query import Query
from ..spec import PARTITION_FORMATS, JournalSpec

#: Where rows stand within their timestamp: the commit and the place in it.
HIDDEN = ("_commit", "_row")
#: Batches of one commit are numbered below this.
BATCHES = 1_000_000
_EPOCH = datetime(1970, 1, 1)


class _Store:
    """Files below a path."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._utf8 = jvm.org.apache.commons.io.IOUtils
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(self._conf)

    def at(self, name: str):
        return self._path(self.root, name)

    def names(self, folder: str) -> list[str]:
        p = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def files(self, folder: str, before: float | None = None) -> list[str]:
        """Data files below a folder, relative to the root; those last written before a time, if given, in seconds since 1970."""
        p, out = self.at(folder), []
        if self.fs.exists(p):
            base, it = self.fs.makeQualified(self.root).toString().rstrip("/") + "/", self.fs.listFiles(p, True)
            while it.hasNext():
                status = it.next()
                f = status.getPath()
                if f.getName().endswith(".parquet") and (before is None or status.getModificationTime() < 1000 * before):
                    out.append(f.toString().removeprefix(base))
        return sorted(out)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._utf8.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whole and new, or not at all."""
        tmp = self.at(f"_log/.{uuid.uuid4().hex}")
        out = self.fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.fs.exists(self.at(name)) and self.fs.rename(tmp, self.at(name))
        if not done:
            self.fs.delete(tmp, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass(frozen=True)
class Manifest:
    version: int
    files: dict[str, tuple[str, ...]]  # by partition
    generations: dict[str, int]  # how often a partition was replaced
    last: int | None = None  # the last timestamp, as microseconds or the column's own number
    rows: int = 0
    streams: dict[str, int] = field(default_factory=dict)  # the last batch of each stream, by its checkpoint

    def text(self) -> str:
        return json.dumps({"version": self.version, "files": self.files, "generations": self.generations, "last": self.last, "rows": self.rows, "streams": self.streams})


def partition_of(ts: Column, kind: T.DataType, unit: str) -> Column:
    """The partition's name; of epoch milliseconds, instants and timestamps without zone alike in UTC, whatever the session's zone."""
    form = PARTITION_FORMATS[unit]
    if form is None:
        return F.lit("default")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        ts = F.timestamp_add("MICROSECOND", F.unix_micros(ts), zero)
    elif not isinstance(kind, T.TimestampNTZType):
        ts = F.timestamp_add("MILLISECOND", ts.cast("long"), zero)
    return F.date_format(ts, form)


def _named(v: datetime | int, unit: str) -> str:
    if not isinstance(v, datetime):
        v = _EPOCH + timedelta(milliseconds=v)
    return v.strftime({"DAY": "%Y-%m-%d", "MONTH": "%Y-%m", "YEAR": "%Y"}[unit])


def partition_filter(r: DateRange, unit: str) -> Column:
    """What a time range says about partition names, which sort as their times do."""
    out = F.lit(False)
    for low, high in r.intervals:
        c = F.lit(True)
        if low is not None:
            c = c & (F.col("p") >= _named(low, unit))
        if high is not None:
            c = c & (F.col("p") <= _named(before(high), unit))
        out = out | c
    return out


def in_range(partition: str, r: DateRange, unit: str) -> bool:
    """Whether a partition may hold rows of a time range."""
    low = lambda v: v is None or partition >= _named(v, unit)
    high = lambda v: v is None or partition <= _named(before(v), unit)
    return any(low(a) and high(b) for a, b in r.intervals)


class Journal:
    """A journal at ``path``. Opening it without a spec takes schema and spec from disk.

    With ``compact_closed``, a commit that begins a later partition compacts those it leaves behind, if they have several files.
    """

    def __init__(self, spark: SparkSession, path: str, spec: JournalSpec | None = None, schema: T.StructType | None = None, read_only: bool = False, compact_closed: bool = False):
        self.spark, self.path, self.store, self.read_only = spark, path.rstrip("/"), _Store(spark, path), read_only
        self.on_commit: list[Callable[[int, int], None]] = []
        self.compact_closed = compact_closed
        if self.store.fs.exists(self.store.at("_spec.json")):
            d = json.loads(self.store.read("_spec.json"))
            own = JournalSpec(d["name"], d["timestamp"], (), tuple(d["symbols"]), d["partition_by"])
            there = T.StructType.fromJson(d["schema"])
            if schema is not None and [(f.name.lower(), f.dataType) for f in schema] != [(f.name.lower(), f.dataType) for f in there]:
                raise QueryError(f"{path} has the schema {there.simpleString()}, not {schema.simpleString()}")
            if spec is not None and (spec.timestamp, spec.partition_by.upper()) != (own.timestamp, own.partition_by):
                raise QueryError(f"{path} is ordered by {own.timestamp} in partitions {own.partition_by}")
            self.spec, self.schema = own, there
        else:
            if spec is None or schema is None or read_only:
                raise QueryError(f"{path} is no journal; a new one needs a spec and a schema")
            self.spec, self.schema = JournalSpec(spec.name, spec.timestamp, (), spec.symbols, spec.partition_by.upper()), schema
            text = {"name": spec.name, "timestamp": spec.timestamp, "symbols": list(spec.symbols), "partition_by": spec.partition_by.upper(), "schema": schema.jsonValue()}
            self.store.fs.mkdirs(self.store.at("_log"))
            self.store.create("_spec.json", json.dumps(text))

    # snapshots

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = max((int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json")), default=0)
        if not version:
            return Manifest(0, {}, {})
        d = json.loads(self.store.read(f"_log/{version}.json"))
        return Manifest(d["version"], {k: tuple(v) for k, v in d["files"].items()}, d["generations"], d["last"], d["rows"], d["streams"])

    def read(self, version: int | None = None) -> Query:
        """A query over the rows of the newest version, or of an older one; later commits don't change it."""
        m, unit = self.manifest(version), self.spec.partition_by

        def scan(r: DateRange) -> DataFrame:
            if r.is_all or unit == "NONE":
                return self._open(m.files)
            return self._open({p: fs for p, fs in m.files.items() if in_range(p, r, unit)}).where(partition_filter(r, unit))

        spec = JournalSpec(self.spec.name, self.spec.timestamp, HIDDEN, self.spec.symbols, unit)
        return Query(self._open({}), spec, scan=scan, hidden=(*HIDDEN, "c", "p"))

    def _open(self, by: dict[str, tuple[str, ...]]) -> DataFrame:
        """Rows of files by partition; Spark is told of these alone."""
        stored = T.StructType([*self.schema.fields, T.StructField("_commit", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("c", T.StringType()), T.StructField("p", T.StringType())])
        files = [f"{self.path}/{f}" for fs in by.values() for f in fs]
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/data").parquet(*files) if files else self.spark.createDataFrame([], stored)

    # writing

    def _stage(self, df: DataFrame, commit: int) -> tuple[dict[str, list[str]], int | None, int | None, int]:
        """Writes files that no manifest names yet: by partition, with the first and last time and the number of rows."""
        if self.read_only:
            raise QueryError(f"{self.path} was opened for reading")
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        name, ts = uuid.uuid4().hex, self.spec.timestamp
        kind = self.schema[ts].dataType if ts else None
        df = df.withColumn("_commit", F.lit(commit).cast("long")).withColumn("_row", F.monotonically_increasing_id())
        df = df.withColumn("p", partition_of(F.col(f"`{ts}`"), kind, self.spec.partition_by) if ts else F.lit("default"))
        if ts:  # ranges of time, so that a file's statistics and its partition cover little of it
            df = df.repartitionByRange("p", F.col(f"`{ts}`")).sortWithinPartitions("p", F.col(f"`{ts}`"), "_row")
        where = f"{self.path}/data/c={name}"
        df.write.partitionBy("p").parquet(where)
        by: dict[str, list[str]] = {}
        for f in self.store.files(f"data/c={name}"):
            by.setdefault(f.split("/")[2].removeprefix("p="), []).append(f)
        if not ts or not by:
            n = self.spark.read.schema(self.schema).parquet(where).count() if by else 0
            return by, None, None, n
        c = F.col(f"`{ts}`")
        number = F.unix_micros(c.cast("timestamp")) if isinstance(kind, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) if isinstance(kind, T.TimestampNTZType) else c.cast("long")
        r = self.spark.read.schema(self.schema).parquet(where).agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count("*").alias("n"), F.sum(c.isNull().cast("long")).alias("nulls")).first()
        if r["nulls"]:
            self.store.delete(f"data/c={name}")
            raise QueryError(f"[{ts}] is null in {r['nulls']} rows")
        return by, r["a"], r["b"], r["n"]

    def _publish(self, m: Manifest) -> None:
        if not self.store.create(f"_log/{m.version}.json", m.text()):
            raise CommitConflictError(f"version {m.version} of {self.path} was committed by another writer")
        for hook in self.on_commit:
            hook(m.version, m.rows)

    def writer(self) -> Writer:
        return Writer(self)

    def append(self, df: DataFrame) -> int:
        """Appends and commits one batch; the new version."""
        with self.writer() as w:
            w.append(df)
            return w.commit()

    def overwrite_partition(self, partition: str, df: DataFrame) -> int:
        """Replaces one partition; readers of older versions keep the old one."""
        m = self.manifest()
        by, _, last, n = self._stage(df, (m.version + 1) * BATCHES)
        if set(by) - {partition}:
            raise QueryError(f"rows of partitions {sorted(set(by) - {partition})} can't replace {partition}")
        gone = m.files.get(partition, ())
        lost = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in gone]).count() if gone else 0
        files = {k: v for k, v in m.files.items() if k != partition} | ({partition: tuple(by[partition])} if by else {})
        newest = m.last if last is None else last if m.last is None else max(m.last, last)
        generations = m.generations | {partition: m.generations.get(partition, 0) + 1}
        self._publish(replace(m, version=m.version + 1, files=files, generations=generations, last=newest, rows=m.rows - lost + n))
        return m.version + 1

    def compact(self, partition: str, rewrite: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Replaces a partition by what ``rewrite`` makes of it; fewer, sorted files by default."""
        q = self.read()
        order = [F.col(f"`{c}`") for c in q.spec.order_key]
        rows = self._open({partition: self.manifest().files.get(partition, ())}).orderBy(*order).drop(*q.hidden)
        return self.overwrite_partition(partition, rewrite(rows))

    def vacuum(self, versions: int = 10, hours: float = 168) -> int:
        """Removes what no reader of the last ``versions`` versions needs; the number of data files removed.

        Files younger than ``hours`` stay, as a writer may have staged them and not committed yet: no
        transaction may last longer. Readers of older versions, if any are left, fail.
        """
        if self.read_only:
            raise QueryError(f"{self.path} was opened for reading")
        if versions < 1:
            raise QueryError("the newest version can't be removed")
        old = self.store.files("data", time.time() - 3600 * hours)  # before the log is read: what is committed since is younger
        log = sorted(int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json"))
        needed = {f for v in log[-versions:] for fs in self.manifest(v).files.values() for f in fs}
        for v in log[:-versions]:
            self.store.delete(f"_log/{v}.json")
        gone = [f for f in old if f not in needed]
        for f in gone:
            self.store.delete(f)
        return len(gone)

    def truncate(self) -> int:
        m = self.manifest()
        self._publish(replace(m, version=m.version + 1, files={}, last=None, rows=0))
        return m.version + 1


class Writer:
    """A write transaction: batches are staged, and count once committed. Leaving it without commit() rolls back."""

    def __init__(self, journal: Journal):
        self.journal, self.base = journal, journal.manifest()
        self.files, self.last, self.rows, self.staged = {k: list(v) for k, v in self.base.files.items()}, self.base.last, self.base.rows, []

    def append(self, df: DataFrame) -> None:
        """A batch may not begin before the last row so far; rows of one batch are put in order."""
        by, first, last, n = self.journal._stage(df, (self.base.version + 1) * BATCHES + len(self.staged))
        folder = next((f.split("/p=")[0] for fs in by.values() for f in fs), None)
        if first is not None and self.last is not None and first < self.last:
            self.journal.store.delete(folder)
            raise OutOfOrderError(f"the batch begins at {first}, before {self.last}")
        self.staged += [folder] if folder else []
        for p, fs in by.items():
            self.files.setdefault(p, []).extend(fs)
        self.last, self.rows = self.last if last is None else last, self.rows + n

    def commit(self, stream: tuple[str, int] | None = None) -> int:
        """Publishes the staged batches; ``stream`` notes the batch of a stream that they are."""
        version = self.base.version + 1
        streams = self.base.streams | dict([stream] if stream else [])
        self.journal._publish(replace(self.base, version=version, files={k: tuple(v) for k, v in self.files.items()}, last=self.last, rows=self.rows, streams=streams))
        before = set(self.base.files)
        self.staged, self.base = [], self.journal.manifest(version)
        if self.journal.compact_closed and before and max(self.base.files) > max(before):
            for p in sorted(self.base.files)[:-1]:
                if p >= max(before) and len(self.base.files[p]) > 1:
                    version = self.journal.compact(p)
            self.base = self.journal.manifest(version)
        return version

    def rollback(self) -> None:
        for folder in self.staged:
            self.journal.store.delete(folder)
        self.__init__(self.journal)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.rollback()


class Catalog:
    """Journals by name, for statements that name more than one."""

    def __init__(self, **queries: Query):
        self.queries = {k.lower(): q for k, q in queries.items()}

    def register(self, name: str, query: Query) -> None:
        self.queries[name.lower()] = query

    def ql(self, text: str, *, ordered: bool = True, **params) -> DataFrame:
        from ..plans.ql import run

        def find(name: str) -> Query:
            if name.lower() not in self.queries:
                raise QueryError(f"There is no journal {name}")
            return self.queries[name.lower()]

        return run(text, find, params, ordered)
