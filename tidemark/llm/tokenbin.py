"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted, so that files in order hold them in ascending
order. A file is an Arrow IPC stream; each record batch has ROWS rows of two fixed-size lists: ``ids``
(uint16, or uint32 for larger vocabularies) and ``mask`` (true for an id, false for the padding of the last row). As every batch
takes the same number of bytes, row r of a memory-mapped file is at a computable place and is read
without copying. A second stream beside it names the documents: doc_id, start and n_tokens in the file.

Files are written under another name and then moved, so a task that runs twice after a lost executor
leaves one whole file. They go to the folder that all executors share, by Arrow's own file systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Coded, bounded_batches, drop_path, materialize, new_path, pick, sums, text_slices

SEQ_LEN, ROWS, END = 2048, 32, 1
#: Words that a worker remembers, and bytes up to which it does; plain words that are encoded together.
CACHE, LONGEST_KEPT, JOINED = 250_000, 64, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The one splitting into words, and the normalisation, of which Encoder knows that white space and ASCII punctuation part words.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]


def _splits_words(d: dict) -> bool:
    norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps, splits = norm.get("normalizers", []), pre.get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == _NORMAL and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " " and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _SPLIT} and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        and d.get("post_processor") is None and all(re.fullmatch(r"<\|[a-z]+\|>", x["content"]) and not x["normalized"] for x in d["added_tokens"])
    )


class Encoder:
    """Ids of whole texts.

    If the definition splits as _SPLIT does, no token crosses white space, or stands on both sides of a letter that
    punctuation (but ' < | >) up to white space follows: words are parted there, encoded once and remembered, in lower
    case unless they may hold a special token. New words of Latin letters go to the library many at once, without the
    normaliser and the splitting, which leave them as they are. With another definition whole texts go to the library.
    """

    def __init__(self, definition: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(definition), end
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(True), end + 1) <= 1 << 16 else np.uint32
        d = json.loads(definition)
        suffix = d["model"].get("end_of_word_suffix")
        self.words = d["model"]["type"] == "BPE" and bool(suffix) and _splits_words(d)
        if self.words:
            bare = d | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, d["pre_tokenizer"]["pretokenizers"][1]]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(True), bool)
            self.ends[[i for t, i in d["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.kept = Coded(self._new, self.dtype, CACHE, LONGEST_KEPT, (("\n", (end,)),))  # no word is a line feed

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts, each by itself, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _new(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of new words."""
        is_plain = np.asarray(pc.match_substring_regex(fresh, r"^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$")) & np.asarray(pc.less_equal(pc.binary_length(fresh), LONGEST_KEPT))
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        count, parts = np.zeros(len(fresh), np.int64), []
        lower = pc.utf8_lower(fresh.take(pa.array(plain)))
        for a in range(0, len(plain), JOINED * 64):
            group = lower.slice(a, JOINED * 64)
            off = pa.array(np.append(np.arange(0, len(group), JOINED), len(group)).astype(np.int32))
            encoded = self.bare.encode_batch_fast(pc.binary_join(pa.ListArray.from_arrays(off, group), " ").to_pylist(), add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), self.dtype)
            n = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            which = plain[a : a + JOINED * 64]
            if len(n) != len(which):
                ids, n = self._ids(group.to_pylist())
            count[which] = n
            parts.append((which, ids))
        ids, n = self._ids(fresh.take(pa.array(other)).to_pylist())
        count[other] = n
        parts.append((other, ids))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), self.dtype)
        for which, ids in parts:
            n = count[which]
            out[begin[which].repeat(n) + np.arange(len(ids)) - (np.cumsum(n) - n).repeat(n)] = ids
        return out, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id, and how many each has."""
        texts = texts.fill_null("")
        if not self.words:
            ids, n = self._ids(texts.to_pylist())
            return np.insert(ids, np.cumsum(n), self.end), n + 1
        texts = pc.replace_substring_regex(texts, r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([!-&(-/:;=?@\[-`{}~]+)(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(texts)
        n_words, flat = split.value_lengths().to_numpy(), split.flatten()
        flat = pc.if_else(pc.match_substring(flat, "<|"), flat, pc.ascii_lower(flat))
        coded = flat.dictionary_encode()
        number = self.kept.numbers(coded.dictionary)
        closes = np.cumsum(n_words) + np.arange(len(n_words))
        at = np.zeros(int(n_words.sum()) + len(n_words), np.int32)
        inside = np.ones(len(at), bool)
        inside[closes] = False
        at[inside] = number[coded.indices.to_numpy()]
        out, n = self.kept.ids(at)
        return out, sums(n, n_words + 1)


_encoders: dict[tuple[int, int], Encoder] = {}


def _encoder(definition: str, end: int) -> Encoder:
    """A worker's own, which keeps its words from task to task."""
    key = zlib.crc32(definition.encode()), end
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, end)
    return _encoders[key]


def _schema(dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), SEQ_LEN)), ("mask", pa.list_(pa.bool_(), SEQ_LEN))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Packs ids into full batches as they come."""

    def __init__(self, sink, dtype):
        self.out = pa.ipc.new_stream(sink, _schema(dtype))
        self.left = np.zeros(0, dtype)

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQ_LEN) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.out_schema))

    @property
    def out_schema(self) -> pa.Schema:
        return _schema(self.left.dtype)

    def add(self, ids: np.ndarray) -> None:
        full = SEQ_LEN * ROWS
        ids = np.concatenate([self.left, ids])
        done = len(ids) // full * full
        for a in range(0, done, full):
            self._batch(ids[a : a + full], full)
        self.left = ids[done:].copy()

    def close(self) -> None:
        n = len(self.left)
        if n:  # padded to whole sequences; this last batch may have fewer rows
            self._batch(np.concatenate([self.left, np.zeros(-n % SEQ_LEN, self.left.dtype)]), n)
        self.out.close()


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end: int = END) -> DataFrame:
    """Writes ``docs`` (doc_id, text) below ``path``; a table (part, docs, tokens) of the files, in order.

    A null text is empty and gives the end id alone; a null doc_id comes first; equal ids are ordered by
    text. No rows give no files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # one vocabulary file, under 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n_docs, n_ids = TaskContext.get().partitionId(), None, 0, 0
        fs, at = pa.fs.FileSystem.from_uri(path)
        tmp = f"{at}/_{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(at, recursive=True)
                encoder = _encoder(definition.value, end)
                sinks = [fs.open_output_stream(tmp + x) for x in (".arrow", ".docs")]
                writer, names = _Writer(sinks[0], encoder.dtype), pa.ipc.new_stream(sinks[1], _DOCS)
            for a, b in text_slices(batch.column(1)):
                ids, n = encoder.encode(batch.column(1).slice(a, b - a))
                starts = n_ids + np.cumsum(n) - n
                names.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(starts), pa.array(n)], schema=_DOCS))
                writer.add(ids)
                n_docs, n_ids = n_docs + len(n), n_ids + len(ids)
        if writer is not None:
            writer.close()
            names.close()
            for s, x in zip(sinks, (".arrow", ".docs")):
                s.close()
                fs.move(tmp + x, f"{at}/part-{part:06d}{x}")
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "tokens": [n_ids]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    cols = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = cols.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part int, docs long, tokens long"), "manifest")


class Sequences:
    """Random access to a file's sequences, without copying if the file system can map it."""

    def __init__(self, uri: str):
        fs, at = pa.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.batches = list(pa.ipc.open_stream(self.source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of a sequence."""
        batch, i = self.batches[row // ROWS], row % ROWS
        ids, mask = batch.column(0), batch.column(1)
        return ids.values.to_numpy()[i * SEQ_LEN : (i + 1) * SEQ_LEN], mask.values.slice(i * SEQ_LEN, SEQ_LEN).to_numpy(zero_copy_only=False)

    def stretch(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the file on; one copy if they cross batches."""
        full, parts = SEQ_LEN * ROWS, []
        while n > 0:
            k, i = divmod(start, full)
            parts.append(self.batches[k].column(0).values.to_numpy()[i : i + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 for each document.

    The driver gets a number for each file, and sends each file's total of the files before it back.
    """
    spark = manifest.sparkSession
    files, base = [], 0
    for r in sorted(manifest.collect()):
        files.append((r["part"], base))
        base += r["tokens"]
    todo = spark.createDataFrame(files, "part int, base long").repartition(max(1, len(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns)):
                sequences = Sequences(f"{path}/part-{part:06d}.arrow")
                with fs.open_input_stream(f"{at}/part-{part:06d}.docs") as f:
                    for docs in pa.ipc.open_stream(f):
                        starts, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                        crc = [zlib.crc32(sequences.stretch(s, k).astype("<u4").tobytes()) for s, k in zip(starts.tolist(), n.tolist())]
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(base + starts), docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what the files say: see read_digests()."""
    path = new_path(docs.sparkSession, "tokens")
    path = path if "://" in path else f"file://{path}"
    return read_digests(write(docs, path, tokenizer_path), path)
