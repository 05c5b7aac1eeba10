"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. A word's probability in
a language is the sum over all ways to cut it into pieces, by a forward pass; a text's is the product
over its words. Pieces never cross words, so a word is scored once and then remembered.

The probabilities are fitted by expectation maximisation (forward-backward over the same lattices) on a
bounded sample: about SAMPLE texts of each language, chosen by hash, with all their words. One scan counts
the languages, one the words of the sample.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, crc32_mod, pick, set_apart, text_slices
from .lattice import PieceTable, by_width, codes
from .spm import SPACE, Transducer, default_model

SAMPLE, ROUNDS = 400, 3
UNKNOWN = "und"
#: Words that a worker remembers, letters from which a word is summed with logarithms, and shorter words at a time.
CACHE, LONG, MOST = 250_000, 48, 4096
_CHAR_WEIGHT = 30.0  # a piece of n characters is scaled by this to the n, so that no sum leaves a double's range
_PSEUDO, _UNSEEN = 0.05, 1e-7


def letters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and their marks, in lower case, of all texts, and how many each has; digits, punctuation and white space say nothing about the language."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}]+")
    n, flat = split.value_lengths().to_numpy(), split.flatten()
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate([[0], np.cumsum(some)])
    end = np.cumsum(n)
    return flat.filter(pa.array(some)), before[end] - before[end - n]


class Pieces:
    """The vocabulary: piece -> number; its last number is any character that isn't a piece."""

    def __init__(self, model: bytes):
        names = Transducer.parsed(model).names_of_pieces()
        self.number = {p: i for i, p in enumerate(names)}
        self.size = len(names) + 1
        self.table = PieceTable(names)
        self.longest = self.table.longest
        self.lengths = np.array([*map(len, names), 1])

    def lattice(self, words: list[str], width: int) -> np.ndarray:
        """[word, end - 1, length - 1] -> piece number, or -1; SPACE before a word counts as its first character."""
        c = codes([SPACE + w for w in words], width)
        out = self.table.lattice(c)
        single = out[:, :, 0]
        single[(single < 0) & (c > 0)] = self.size - 1
        return out


class Model:
    """languages and probabilities [piece, language]."""

    def __init__(self, pieces: Pieces, languages: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.scaled = probs * _CHAR_WEIGHT ** pieces.lengths[:, None]
        with np.errstate(divide="ignore"):
            self.logs = np.log(probs)

    def forward(self, lattice: np.ndarray) -> np.ndarray:
        """Scaled sums over all segmentations up to each place; a word's own is at its length."""
        words, n, span = lattice.shape
        alpha = np.zeros((words, n + 1, len(self.languages)))
        alpha[:, 0] = 1
        for e in range(1, n + 1):
            for length in range(1, min(span, e) + 1):
                p = lattice[:, e - 1, length - 1]
                row = np.flatnonzero(p >= 0)
                if len(row):
                    alpha[row, e] += alpha[row, e - length] * self.scaled[p[row]]
        return alpha

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        size = np.array([len(w) for w in words]) + 1
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._long(SPACE + words[i])[-1]
        short = np.flatnonzero(size <= LONG)
        for width, at in by_width(size[short], MOST):
            part = short[at]
            alpha = self.forward(self.pieces.lattice([words[i] for i in part.tolist()], width))
            out[part] = np.log(alpha[np.arange(len(part)), size[part]]) - size[part, None] * np.log(_CHAR_WEIGHT)
        return out

    def _arcs(self, s: str, e: int) -> list[tuple[int, int]]:
        """(length, piece) of the arcs into a place."""
        get, unknown = self.pieces.number.get, self.pieces.size - 1
        found = [(n, get(s[e - n : e], unknown if n == 1 else -1)) for n in range(1, min(self.pieces.longest, e) + 1)]
        return [(n, p) for n, p in found if p >= 0]

    def _long(self, s: str) -> list[np.ndarray]:
        """The same sums with logarithms."""
        out = [np.zeros(len(self.languages))]
        for e in range(1, len(s) + 1):
            out.append(np.logaddexp.reduce([out[e - n] + self.logs[p] for n, p in self._arcs(s, e)], axis=0))
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected piece counts [piece, language] of words that occur ``weights`` [word, language] times."""
        counts = np.zeros((self.pieces.size, len(self.languages)))
        size = np.array([len(w) for w in words], int) + 1
        for i in np.flatnonzero(size > LONG).tolist():
            s = SPACE + words[i]
            alpha, beta = self._long(s), [np.full(len(self.languages), -np.inf) for _ in range(len(s) + 1)]
            beta[-1] = np.zeros(len(self.languages))
            for e in range(len(s), 0, -1):
                for n, p in self._arcs(s, e):
                    flow = self.logs[p] + beta[e]
                    beta[e - n] = np.logaddexp(beta[e - n], flow)
                    counts[p] += weights[i] * np.exp(np.minimum(0, alpha[e - n] + flow - alpha[-1]))
        short = np.flatnonzero(size <= LONG)
        for width, at in by_width(size[short], MOST):
            part = short[at]
            lattice = self.pieces.lattice([words[i] for i in part.tolist()], width)
            _, n, span = lattice.shape
            alpha = self.forward(lattice)
            beta = np.zeros_like(alpha)
            rows = np.arange(len(part))
            beta[rows, size[part]] = weights[part] / alpha[rows, size[part]]
            for e in range(n, 0, -1):
                for length in range(1, min(span, e) + 1):
                    p = lattice[:, e - 1, length - 1]
                    row = np.flatnonzero(p >= 0)
                    p = p[row]
                    flow = self.scaled[p] * beta[row, e]
                    beta[row, e - length] += flow
                    flow *= alpha[row, e - length]
                    for k in range(len(self.languages)):
                        counts[:, k] += np.bincount(p, flow[:, k], self.pieces.size)
        return counts


def fit(train: DataFrame, model_path: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Learns from the rows of ``train`` (text, lang) with a text and a language. The driver gets word counts of the sample only.

    Rows may repeat; texts may be empty or very long; extra columns aren't read. Without such rows the model knows no language.
    """
    bounded_batches(train.sparkSession)
    train = pick(train, "text", "lang").where("text is not null and lang is not null")
    with open(model_path or default_model(), "rb") as f:
        pieces = Pieces(f.read())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((pieces.size, 0)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample / sizes[lang])))])
    chosen = train.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                flat, n = letters(batch.column(0).slice(a, b - a))
                table = pa.table({"lang": batch.column(1).slice(a, b - a).take(pa.array(np.arange(b - a).repeat(n))), "word": flat})
                found = table.group_by(["lang", "word"]).aggregate([([], "count_all")]).combine_chunks()
                for x in found.to_batches():
                    yield pa.RecordBatch.from_arrays([x.column("lang"), x.column("word"), x.column("count_all")], names=["lang", "word", "n"])

    counted = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    lang, word = (counted.column(i).to_pylist() for i in (0, 1))
    at = {w: i for i, w in enumerate(sorted(set(word)))}
    weights = np.zeros((len(at), len(languages)))
    number = {x: i for i, x in enumerate(languages)}
    weights[[at[w] for w in word], [number[x] for x in lang]] = counted.column(2).to_numpy()
    out = Model(pieces, languages, np.full((pieces.size, len(languages)), 1 / pieces.size))
    for _ in range(rounds):
        counts = out.expected(list(at), weights)
        counts[-1] = 0
        probs = (counts + _PSEUDO) / (counts.sum(axis=0) + _PSEUDO * pieces.size)
        probs[-1] = _UNSEEN
        out = Model(pieces, languages, probs)
    return out


#: A worker's model and the words it knows, which stay from task to task.
_loaded: dict[str, list] = {}


def predictor(spark, fitted: Model, model_path: str | None = None):
    """A function of a text column: struct of lang_pred and score."""
    bounded_batches(spark)
    with open(model_path or default_model(), "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), fitted.languages, fitted.probs))  # pieces x languages doubles

    token = uuid.uuid4().hex

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _loaded:
            _loaded.clear()
            model, names, probs = shared.value
            _loaded[token] = [Model(Pieces(model), names, probs), Memo(), np.zeros((0, len(names)))]
        m, memo, rows = kept = _loaded[token]
        names = m.languages
        for array in arrays:
            pred, score = np.full(len(array), len(names)), np.zeros(len(array))
            for a, b in text_slices(array) if names else ():
                flat, n = letters(array.slice(a, b - a))
                if not len(flat):
                    continue
                if memo.over(CACHE):
                    memo.forget(0)
                    rows = kept[2] = rows[:0]
                coded = flat.dictionary_encode()
                number, fresh = memo.numbers(coded.dictionary)
                if len(fresh):
                    rows = kept[2] = np.concatenate([rows, m.score(fresh.to_pylist())])
                some = np.flatnonzero(n)
                total = np.add.reduceat(rows[number[coded.indices.to_numpy()]], (np.cumsum(n) - n)[some], axis=0)
                total -= total.max(axis=1, keepdims=True)
                score[a + some] = 1 / np.exp(total).sum(axis=1)
                pred[a + some] = total.argmax(axis=1)
            yield pa.StructArray.from_arrays([pa.array([*names, UNKNOWN], pa.string()).take(pa.array(pred)), pa.array(score)], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER)


def held_out(doc_id):
    """Rows that no model learns from; a null id isn't learned from either."""
    return F.coalesce(crc32_mod(doc_id, 4) == 2, F.lit(True))


def predict(docs: DataFrame, fitted: Model, model_path: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    score is the language's posterior with equal priors; of equal languages the first by name wins. A
    text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    Texts are read whole, however long. Each row gives a row: rows may repeat, and ids be null. Without rows
    the result is empty. Extra columns aren't read, whatever their names.
    """
    cols = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return cols.select("doc_id", predictor(docs.sparkSession, fitted, model_path)("text").alias("p")).select("doc_id", "p.lang_pred", "p.score")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row: (doc_id, held_out, lang_pred, score)."""
    cols = pick(docs, "doc_id", "text", "lang")
    fitted = fit(cols.where(~held_out(F.col("doc_id"))))
    return predict(cols, fitted).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) whose language is known, with a posterior of ``least`` or more.

    A null, empty or letterless text has no language and goes. Rows that repeat stay or go together; rows with a
    null id are judged as others are, and not learned from. Columns stay as they came, clashing names too.
    Without rows the result is empty.
    """
    fitted = fit(pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    rows, columns = set_apart(docs, "text")
    p = predictor(docs.sparkSession, fitted)(F.col("text"))
    return rows.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least)).select(*columns)
