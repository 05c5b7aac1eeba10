"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

The model file compiles to three transducers. The normaliser rewrites the longest rule that matches (the
model's character map), drops spaces that the model doesn't keep, adds the dummy prefix and escapes spaces.
The pieces are arcs from a place in the text to another, and byte fallback gives arcs for characters that no
piece covers. Composed with an input they make a lattice; its path of least weight in the tropical semiring
(min, +) is the encoding.

Weights follow the model's kind:
* unigram: an arc weighs minus its piece's score, an uncovered character 10 more than the heaviest piece;
* BPE: an arc weighs nothing if merging the joined text of the piece before and its own gives back just these
  two, else it weighs infinity. Exactly one path of a text has finite weight, the one that the merges make,
  and so has each of its beginnings: the last piece before a place is unique, and places can be states.

No path crosses between characters that stand side by side in no piece, so texts are cut there; a stretch is
encoded once and then remembered. New stretches of alike length are composed and relaxed together, in arrays.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Coded, bounded_batches, mix, pick, sums, text_slices, utf8
from .lattice import PieceTable, by_width, codes

SPACE = "▁"
#: Stretches that a worker remembers at most; longer ones (in bytes) aren't kept. Pairs of pieces that it remembers: 2**PAIRS places.
CACHE, LONGEST_KEPT, PAIRS = 250_000, 64, 20
#: Characters up to which stretches are relaxed together, and how many at a time.
TOGETHER, MOST = 40, 4096


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = buf[i]
            i += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", buf[i : i + n])[0]
            i += n


UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _rules(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled character map: a double-array trie, then strings that end in a zero byte."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, pool = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    out, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = units[at]
        below = at ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
        if unit >> 8 & 1:
            begin = units[below] & 0x7FFFFFFF
            out[key.decode()] = pool[begin : pool.index(0, begin)].decode()
        for byte in range(1, 256):
            if (below ^ byte) < len(units) and units[below ^ byte] & 0x800000FF == byte:
                todo.append((below ^ byte, key + bytes([byte])))
    return out


class Normaliser:
    """The first transducer: a text as the pieces spell it."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, one_space: bool = False):
        self.rules, self.dummy_prefix, self.one_space = _rules(charsmap), dummy_prefix, one_space
        self.longest = max(map(len, self.rules), default=0)
        firsts = "".join(map(re.escape, sorted({k[0] for k in self.rules})))
        self.first = re.compile(f"[{firsts}]") if firsts else None

    def rewritten(self, text: str) -> str:
        """The longest rule at each place, from left to right; a character without one stays."""
        if self.first is None:
            return text
        out, done = [], 0
        while m := self.first.search(text, done):
            out.append(text[done : m.start()])
            done = m.start()
            n = next((n for n in range(min(self.longest, len(text) - done), 0, -1) if text[done : done + n] in self.rules), 0)
            out.append(self.rules[text[done : done + n]] if n else text[done])
            done += n or 1
        return "".join([*out, text[done:]])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Texts as the pieces spell them, but with spaces instead of SPACE. A null or empty text is empty."""
        if self.first is not None:
            texts = pa.array([self.rewritten(x) if x else "" for x in texts.to_pylist()], pa.string())
        texts = pc.replace_substring(texts.fill_null(""), SPACE, " ")
        if self.one_space:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", texts, " "))
        return texts


@dataclass
class Transducer:
    """A compiled model. ``encode`` and ``decode`` work on whole texts."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    normaliser: Normaliser = field(default_factory=Normaliser)
    arcs: dict[str, int] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unknown: int = 0
    unknown_cost: float = 0.0

    @classmethod
    def load(cls, model: bytes) -> Transducer:
        return cls.parsed(model).compiled()

    @classmethod
    def parsed(cls, model: bytes) -> Transducer:
        """The model's parts, not compiled yet."""
        pieces, scores, kinds, trainer, norm = [], [], [], {}, {}
        for n, v in _fields(model):
            if n == 1:
                p = dict(_fields(v))
                pieces.append(p[1].decode())
                scores.append(p.get(2, 0.0))
                kinds.append(p.get(3, _NORMAL))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                norm = dict(_fields(v))
        if trainer.get(3, 1) not in (UNIGRAM, BPE) or _USER in kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are compiled")
        if trainer.get(24, 0) or not norm.get(5, 1):
            raise ValueError("spaces as suffixes, or left as they are, aren't compiled")
        return cls(pieces, scores, kinds, trainer.get(3, 1), Normaliser(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))))

    def names_of_pieces(self) -> list[str]:
        return [p for p, k in zip(self.pieces, self.kinds) if k == _NORMAL]

    def compiled(self) -> Transducer:
        self.arcs = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.fallback = len(self.byte_ids) == 256
        self.unknown = self.kinds.index(_UNKNOWN)
        self.unknown_cost = 0.0 if self.model_type == BPE else 10 - min((self.scores[i] for i in self.arcs.values()), default=0.0)
        self.numbers = np.array([*self.arcs.values()], np.int32)
        self.table = PieceTable([*self.arcs])
        self.score = np.array([*(self.scores[i] for i in self.numbers.tolist()), -np.inf])
        self.names = [*self.arcs]
        self.made = np.ones(len(self.names) + 1, bool)  # pieces that merging makes; the last is none
        self._keys, self._fit = np.full(1 << PAIRS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << PAIRS, bool)
        if self.model_type == BPE:
            at = np.flatnonzero(np.array([len(x) > 1 for x in self.names]))
            self.made[at] = self._merges([self.names[i] for i in at.tolist()], np.array([len(self.names[i]) for i in at.tolist()]), None)
        self._cuts()
        spelt = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.encode() if k == _NORMAL else b"" for p, k in zip(self.pieces, self.kinds)]
        spelt = [x.replace(SPACE.encode(), b" ") for x in spelt]
        spelt[self.unknown] = b" \xe2\x81\x87 "
        self.spelt = pa.array(spelt, pa.large_binary())
        self.kept = Coded(self._stretches, np.int32, CACHE, LONGEST_KEPT)
        return self

    def _cuts(self) -> None:
        """Bytes that stand side by side in no piece: ASCII by itself, all others as one."""
        beside = np.zeros((129, 129), bool)
        for p in self.arcs:
            b = [min(x, 128) for x in p.replace(SPACE, " ").encode()]
            beside[b[:-1], b[1:]] = True
        beside[128, 128] = True
        if not self.fallback:  # neighbours that no piece covers make one unknown piece
            odd = np.array([c == 128 or chr(c).replace(" ", SPACE) not in self.arcs for c in range(129)])
            beside |= odd[:, None] & odd[None, :]
        self.apart = ~beside

    def _merges(self, words: list[str], lengths: np.ndarray, first: np.ndarray | None) -> np.ndarray:
        """Whether merging each word, best score first and leftmost of equals, ends in one piece, or in two of which the first has ``first`` characters."""
        out = np.zeros(len(words), bool)
        for width, at in by_width(lengths, MOST):
            lat = self.table.lattice(codes([words[i] for i in at.tolist()], width))
            n, _, span = lat.shape
            bounds = np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()  # of the parts; after the last one the end again and again
            size, rows = lengths[at], np.arange(n)[:, None]
            bounds = np.minimum(bounds, size[:, None])
            place = np.arange(width + 1)
            while bounds.shape[1] > 2:
                length, end = bounds[:, 2:] - bounds[:, :-2], bounds[:, 2:]
                real = (bounds[:, 1:-1] < size[:, None]) & (length <= span)
                piece = np.where(real, lat[rows, end - 1, np.minimum(length, span) - 1], -1)
                score = self.score[piece]
                best = score.argmax(axis=1)
                go = score[rows[:, 0], best] > -np.inf
                if not go.any():
                    break
                place = np.arange(bounds.shape[1] - 1)
                drop = np.where(go, best + 1, bounds.shape[1])[:, None]
                bounds = np.where(place[None, :] < drop, bounds[:, :-1], bounds[:, 1:]) if go.all() else np.where(np.arange(bounds.shape[1]) < drop, bounds, np.concatenate([bounds[:, 1:], bounds[:, -1:]], axis=1))
            if first is None:
                out[at] = bounds[:, 1] == size
            else:
                two = bounds[:, 2] if bounds.shape[1] > 2 else np.zeros(n, int)
                out[at] = (bounds[:, 1] == first[at]) & (two == size) & (first[at] < size)
        return out

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may stand side by side; by a table of pairs, in which a new pair takes the place of an old one."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = mix(key) >> np.uint64(64 - PAIRS)
        out, miss = self._fit[place], np.flatnonzero(self._keys[place] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            a, b = (fresh >> np.uint64(32)).astype(int).tolist(), (fresh & np.uint64(0xFFFFFFFF)).astype(int).tolist()
            size = np.array([len(self.names[i]) for i in a])
            fit = self._merges([self.names[i] + self.names[j] for i, j in zip(a, b)], size + np.array([len(self.names[j]) for j in b]), size)
            out[miss] = fit[back]
            place = mix(fresh) >> np.uint64(64 - PAIRS)
            self._keys[place], self._fit[place] = fresh, fit
        return out

    def _weights(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Of arcs after the pieces ``left`` (-1: none, or an uncovered character)."""
        if self.model_type != BPE:
            return -self.score[piece]
        fit = self.made[piece]
        both = np.flatnonzero(fit & (left >= 0))
        fit[both] = self.may_follow(left[both], piece[both])
        return np.where(fit, 0.0, np.inf)

    def _paths(self, c: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of code points: piece entered at each place along the least path (-1: an uncovered character), and where it came from (-1: not on the path)."""
        lat = self.table.lattice(c)
        n, width, span = lat.shape
        last, since, cost = np.full((n, width + 1), -1), np.full((n, width + 1), -1), np.full((n, width + 1), np.inf)
        cost[:, 0] = 0
        for e in range(1, width + 1):
            most = min(span, e)
            piece, before = lat[:, e - 1, :most], slice(e - most, e)  # by length; the place before is e - length
            row, k = np.nonzero((piece >= 0) & (cost[:, before][:, ::-1] < np.inf))
            if self.model_type == BPE:  # two that make one piece together don't stand side by side
                whole = e - 1 - since[row, e - 1 - k]
                ok = (whole >= most) | (k == e - 1) | (last[row, e - 1 - k] < 0) | (piece[row, np.minimum(whole, most - 1)] < 0)
                row, k = row[ok], k[ok]
            weight = np.full((n, most), np.inf)
            weight[row, k] = cost[row, e - 1 - k] + self._weights(last[row, e - 1 - k], piece[row, k])
            best = most - 1 - weight[:, ::-1].argmin(axis=1)  # of equals the longest piece
            rows = np.arange(n)
            cost[:, e] = weight[rows, best]
            ok = cost[:, e] < np.inf
            last[ok, e], since[ok, e] = piece[rows[ok], best[ok]], e - 1 - best[ok]
            w = cost[:, e - 1] + self.unknown_cost  # a character that no piece covers
            row = np.flatnonzero((piece[:, 0] < 0) & (w < cost[:, e]))
            cost[row, e], last[row, e], since[row, e] = w[row], -1, e - 1
        on, at = np.full((n, width + 1), -1), size.copy()
        rows = np.arange(n)
        while len(rows := rows[at[rows] > 0]):
            on[rows, at[rows]] = since[rows, at[rows]]
            at[rows] = since[rows, at[rows]]
        return last, on

    def _spell(self, word: str, last: list[int], on: list[int]) -> list[int]:
        out: list[int] = []
        unknown = False
        for e in range(1, len(word) + 1):
            if on[e] < 0:
                continue
            if last[e] >= 0:
                out.append(int(self.numbers[last[e]]))
            elif self.fallback:
                out += [self.byte_ids[b] for b in word[e - 1].encode()]
            elif not unknown:
                out.append(self.unknown)
            unknown = last[e] < 0
        return out

    def _stretches(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of new stretches, and how many each has."""
        words = pc.replace_substring(fresh, " ", SPACE).to_pylist()
        lengths = np.array([len(w) for w in words])
        count, parts = np.zeros(len(words), np.int64), []
        for width, at in by_width(lengths, MOST):
            # a text without spaces may be one stretch: it is relaxed alone, so that its arrays stay in proportion to it
            for part in [at] if width <= TOGETHER else np.split(at, range(1, len(at))):
                some = [words[i] for i in part.tolist()]
                last, on = self._paths(codes(some, width), lengths[part])
                plain = ((last >= 0) | (on < 0)).all(axis=1)
                entered = (on >= 0) & plain[:, None]
                count[part] = entered.sum(axis=1)
                parts.append((part[plain], self.numbers[last[entered]]))
                for r in np.flatnonzero(~plain).tolist():
                    ids = np.array(self._spell(some[r], last[r].tolist(), on[r].tolist()), np.int32)
                    count[part[r]] = len(ids)
                    parts.append((part[r : r + 1], ids))
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for which, ids in parts:
            n = count[which]
            out[begin[which].repeat(n) + np.arange(len(ids)) - (np.cumsum(n) - n).repeat(n)] = ids
        return out, count

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Flat piece ids of texts, how many each has, and the normalised texts (with spaces). A null or empty text has none."""
        texts = self.normaliser(texts)
        data, off = utf8(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), texts
        kind = np.minimum(data, 128)
        starts = np.zeros(len(data), bool)
        starts[1:] = self.apart[kind[:-1], kind[1:]]
        starts[off[:-1][np.diff(off) > 0]] = True
        bounds = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        flat, n = self.kept.ids(self.kept.numbers(coded.dictionary)[coded.indices.to_numpy()])
        return flat, sums(n, np.diff(np.searchsorted(bounds, off))), texts

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of one text."""
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """What ids spell one after another, spaces unescaped."""
        return utf8_of(self.spelt.take(pa.array(ids)))

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; bytes that aren't UTF-8 become U+FFFD."""
        text = self.decode_bytes(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")
        return text[1:] if self.normaliser.dummy_prefix and text[:1] == " " else text


def utf8_of(a: pa.Array) -> np.ndarray:
    """Bytes of large binary values in a row."""
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if len(a) and a.buffers()[2] else np.zeros(0, np.uint8)


def _shared(df: DataFrame, model_path: str | None):
    with open(model_path or default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one model file, about 0.5 MB whatever the input


_loaded: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    key = zlib.crc32(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Transducer.load(model)
    return _loaded[key]


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs`` (doc_id, text); a null or empty text has no ids.

    Rows may repeat and ids may be null: each row gives a row. Texts are encoded whole, however long. Without
    rows the result is empty. Extra columns aren't read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    model = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model.value)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, n, _ = t.encode_all(batch.column(1).slice(a, b - a))
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["doc_id", "ids"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of ``encoded`` (doc_id, ids array<int>); null ids give a null text.

    Rows may repeat, be missing altogether, and have columns besides, which aren't read.
    """
    bounded_batches(encoded.sparkSession)
    model = _shared(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """For each row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit) and round_trip.

    round_trip says whether decoding the ids gives the text again (null counts as empty), with U+2581,
    which the format can't tell from a space, read as one. Rows, texts and columns may be as in encode().
    """
    bounded_batches(docs.sparkSession)
    model = _shared(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _transducer(model.value)
        prefix = int(t.normaliser.dummy_prefix)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                given = batch.column(1).slice(a, b - a)
                ids, n, texts = t.encode_all(given)
                end = np.cumsum(n)
                le = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(le[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                want, off = utf8(pc.replace_substring(given.fill_null(""), SPACE, " "))
                back, at = t.decode_bytes(ids), np.concatenate([[0], end])
                size = np.concatenate([[0], np.cumsum(pc.binary_length(t.spelt.take(pa.array(ids))).to_numpy())])[at].astype(np.int64)
                same = []
                for i in range(len(n)):
                    x, y = back[size[i] : size[i + 1]], want[off[i] : off[i + 1]]
                    x = x[int(prefix and len(x) > 0 and x[0] == 0x20) :]
                    # bytes that aren't UTF-8 decode to U+FFFD, which the text itself may hold
                    same.append(bool(np.array_equal(x, y)) or x.tobytes().decode("utf-8", "replace") == y.tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
