"""What the operators share: shared-storage tables, batch slicing and word kernels.

Every intermediate table goes to the folder that ``spark.checkpoint.dir`` names, so that a lost
executor costs a re-read and never the result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000
#: Bytes of an Arrow batch handed to Python, where Spark bounds them.
ARROW_BYTES = 4 << 20
#: Bytes of text that a kernel looks at together.
CHUNK_BYTES = 4 << 20
#: Bytes whose words are hashed together: bounds the tables of powers.
HASH_BYTES = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/tidemark"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to shared storage and reads it back: a lineage cut that any executor can read."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return at_path(spark.read.schema(df.schema).parquet(path), path)


def at_path(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads a table of ours, so that drop_tables() finds it."""
    df._tidemark_table = path
    return df


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(*frames: DataFrame) -> None:
    """Deletes tables of materialize() that no later step reads."""
    for df in frames:
        if path := getattr(df, "_tidemark_table", None):
            drop_path(df.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows and bytes of an Arrow batch, if the session allows more. The settings stay, as results are evaluated later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name first, so that extra columns can't clash with ours."""
    out = []
    for n in names:
        hits = [i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not hits:
            raise ValueError(f"column {n} is missing; there are {df.columns}")
        out.append(hits[0])
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(out, names)])
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(out, names)])


def set_apart(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns renamed by position, then ``names`` (found as pick() does) once more under their own names, and what selects the columns it came with."""
    own = [f"_c{i}" for i in range(len(df.columns))]
    found = [[i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()] for n in names]
    for n, hits in zip(names, found):
        if not hits:
            raise ValueError(f"column {n} is missing; there are {df.columns}")
    return df.toDF(*own).select("*", *[F.col(own[h[0]]).alias(n) for n, h in zip(names, found)]), [F.col(c).alias(n) for c, n in zip(own, df.columns)]


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m. A null id has remainder null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first, last) row ranges of about ``limit`` bytes each; one longer text is a range of its own."""
    n = len(texts)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    first, total = 0, 0
    for i in range(n):
        if total and total + lengths[i] > limit:
            yield first, i
            first, total = i, 0
        total += lengths[i]
    if first < n:
        yield first, n


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins; null is empty."""
    a = texts.fill_null("").cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def golden(i: int) -> np.uint64:
    """i times GOLDEN, modulo 2**64."""
    return np.uint64(i * int(GOLDEN) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word ``[^\\x20\\x09-\\x0D]+``, and where each text's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return begins, ends, np.searchsorted(begins, off)


def hash_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z. Works through stretches of HASH_BYTES, a longer word whole."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + HASH_BYTES, "right")))
        a, b = begins[i], ends[j - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[_LOWER[data[a:b]]] * _power("up", b - a), out=sums[1:])
        s, e = begins[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _power("down", b - a)[s] + (e - s).astype(np.uint64) * GOLDEN)
        i = j
    return out


def shingles(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, and where each text's begin.

    Fewer than k words make one shingle, no words none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    last = np.repeat(starts[1:], np.diff(starts))  # end of each word's text
    at = np.arange(n)
    h = mix(hashes + GOLDEN)
    for t in range(1, min(k, n)):
        in_text = at + t < last
        nxt = np.zeros(n, np.uint64)
        nxt[: n - t] = hashes[t:]
        h = np.where(in_text, mix(h * _M1 + nxt), h)
    first = np.zeros(n, bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    ok = (at + k <= last) | first
    h = h[ok]
    counts = np.concatenate([[0], np.cumsum(ok)])
    begin = counts[starts]
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    counts = np.concatenate([[0], np.cumsum(new)])
    return h[new], counts[begin]


class Memo:
    """Numbers of strings in the order in which they first came; Arrow looks them up, so none becomes a Python object."""

    def __init__(self) -> None:
        self.forget(0)

    def __len__(self) -> int:
        return len(self.values)

    def over(self, limit: int) -> bool:
        """Whether it holds more strings, or many more bytes, than it should."""
        return len(self) > limit or self.values.nbytes > 64 * limit

    def forget(self, n: int) -> None:
        """All but the first n."""
        self.values = self.values[:n] if n else pa.array([], pa.string())

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each of these different strings, and those that are new, which get the next numbers."""
        number = pc.index_in(words, value_set=self.values).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self), len(self) + len(new))
        fresh = words.take(pa.array(new))
        if len(new):
            self.values = pa.concat_arrays([self.values, fresh])
        return number, fresh


class Coded:
    """Ids of strings, each worked out once. ``work`` gives flat ids of new strings and how many each has.

    Above ``limit`` strings all but the ``first`` ones are forgotten, and so are, after each chunk, those of more than ``longest`` bytes.
    """

    def __init__(self, work, dtype, limit: int, longest: int, first: tuple[tuple[str, tuple[int, ...]], ...] = ()):
        self.work, self.limit, self.longest, self.kept = work, limit, longest, len(first)
        self.memo = Memo()
        self.memo.values = pa.array([s for s, _ in first], pa.string())
        self.flat = np.array([i for _, ids in first for i in ids], dtype)
        self.off = np.cumsum([0, *(len(ids) for _, ids in first)]).astype(np.int32)

    def _cut(self, n: int) -> None:
        self.memo.forget(n)
        self.flat, self.off = self.flat[: self.off[n]].copy(), self.off[: n + 1].copy()

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The row of each of these different strings."""
        if self.memo.over(self.limit):
            self._cut(self.kept)
        size = pc.binary_length(words).to_numpy(zero_copy_only=False)
        order = np.argsort(size > self.longest, kind="stable")  # long strings get the last numbers
        number, fresh = self.memo.numbers(words.take(pa.array(order)))
        self.stay = len(self.memo) - int((size > self.longest).sum())
        if len(fresh):
            ids, n = self.work(fresh)
            self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(n, dtype=np.int32)])
        out = np.empty(len(number), np.int32)
        out[order] = number
        return out

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of rows one after another, and how many each has; then long strings are forgotten."""
        out = pa.ListArray.from_arrays(pa.array(self.off), pa.array(self.flat)).take(pa.array(rows)).flatten().to_numpy()
        n = (self.off[1:] - self.off[:-1])[rows]
        if self.stay < len(self.memo):
            self._cut(self.stay)
        return out, n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]
