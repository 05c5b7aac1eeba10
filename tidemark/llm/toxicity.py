"""Toxicity by a factorisation machine over hashed terms.

A text's terms are its distinct words and their first four and five letters, hashed to 2**18 numbers.
score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the terms present: the factors catch pairs, such
as an insult with a group, that single weights miss. Presence, not frequency, counts, so that one insult in
a very long text weighs as much as in a short one.

Fitting uses a bounded sample: about SAMPLE labelled texts of each class, chosen by hash, weighted back to
the classes' true shares. The machine learns from the terms that tell the classes apart by themselves (a
chi-square above LEAST_Z) and from those that do so in a pair (above LEAST_PAIR, and more than twice what either
does alone); pairs are counted of all terms that PAIR_SHARE of the sample or more have. Both are rules about the
evidence in the sample; there is no cap on the number of terms but that of the hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_mod, pick, set_apart, text_slices

SAMPLE, FACTORS = 4000, 8
LEAST_Z, LEAST_PAIR, PAIR_SHARE = 10.8, 40.0, 0.02
BITS = 18
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def _terms(word: str) -> list[int]:
    names = [f"w:{word}", *(f"{n}:{word[:n]}" for n in (4, 5) if len(word) >= n)]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in names]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


class Machine:
    """A dense table of the kept terms' weights and factors; other terms have no row."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors
        self.row = {int(t): i for i, t in enumerate(terms)}

    def margins(self, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of rows of term numbers, given flat with their starts."""
        n = len(starts) - 1
        owner = np.repeat(np.arange(n), np.diff(starts))
        out = self.bias + np.bincount(owner, self.weights[index], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[index, k]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out


def _chi(positive: np.ndarray, total: np.ndarray, n: float, p: float) -> np.ndarray:
    """How far the positive among ``total`` texts are from chance; 0 for too few texts."""
    spread = total * (p / n) * (1 - p / n) * (1 - total / n)
    return np.where((total >= 4) & (spread > 0), (positive - total * p / n) ** 2 / np.maximum(spread, 1e-9), 0)


def _tell_in_pairs(flat: np.ndarray, owner: np.ndarray, labels: np.ndarray, with_term: np.ndarray, z: np.ndarray, share: float, least: float) -> np.ndarray:
    """Terms that tell the classes apart together with another; pairs are counted by products of blocks of 512 terms."""
    n, p = float(len(labels)), labels.sum()
    often = np.flatnonzero(with_term >= max(4, share * n))
    back = np.full(len(with_term), -1)
    back[often] = np.arange(len(often))
    there = np.zeros((len(often), len(labels)), np.uint8)
    ok = back[flat] >= 0
    there[back[flat[ok]], owner[ok]] = 1
    found = np.zeros(len(often), bool)
    single = z[often]
    for a in range(0, len(often), 512):
        left = there[a : a + 512].astype(np.float32)
        for b in range(a, len(often), 512):
            right = there[b : b + 512].astype(np.float32)
            chi = _chi((left * labels.astype(np.float32)) @ right.T, left @ right.T, n, p)
            tells = (chi > least) & (chi > 2 * np.maximum(single[a : a + 512, None], single[None, b : b + 512]))
            found[a : a + 512] |= tells.any(axis=1)
            found[b : b + 512] |= tells.any(axis=0)
    return often[found]


def train_machine(
    rows: list[np.ndarray], labels: np.ndarray, prior: float, factors: int = FACTORS, epochs: int = 120, seed: int = 7, least_z: float = LEAST_Z, least_pair: float = LEAST_PAIR, pair_share: float = PAIR_SHARE
) -> Machine:
    """Full-batch Adam on weighted logistic loss with L2; deterministic."""
    labels = np.asarray(labels, float)
    if not len(rows) or labels.min() == labels.max():
        p = np.clip(prior, 1e-3, 1 - 1e-3)
        return Machine(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, factors)))
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = 1 << BITS
    with_term = np.bincount(flat, minlength=size).astype(float)
    positive = np.bincount(flat, labels[owner], size)
    n, p = float(len(rows)), labels.sum()
    z = _chi(positive, with_term, n, p)
    kept = np.union1d(np.flatnonzero(z > least_z), _tell_in_pairs(flat, owner, labels, with_term, z, pair_share, least_pair))
    back = np.full(size, -1)
    back[kept] = np.arange(len(kept))
    ok = back[flat] >= 0
    index, owner = back[flat][ok], owner[ok]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    weight = np.where(labels == 1, prior / (p / n), (1 - prior) / (1 - p / n))
    weight /= weight.sum()
    rng = np.random.default_rng(seed)
    bias, w, v = np.array([np.log(prior / (1 - prior))]), np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), factors))
    params = [bias, w, v]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    lam = (0.0, 2e-5, 1e-4)
    for t in range(1, epochs + 1):
        margin = Machine(np.zeros(0), float(bias[0]), w, v).margins(index, starts)
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels)
        gi = g[owner]
        gv = np.empty_like(v)
        for k in range(factors):
            sums = np.bincount(owner, v[index, k], len(rows))
            gv[:, k] = np.bincount(index, gi * (sums[owner] - v[index, k]), len(kept))
        grads = [np.array([g.sum()]), np.bincount(index, gi, len(kept)), gv]
        for x, d, (m, s), l2 in zip(params, grads, moments, lam):
            d = d + l2 * x
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return Machine(kept, float(bias[0]), w, v)


def held_out(doc_id):
    """Rows whose labels no model learns from; a null id isn't learned from either."""
    return F.coalesce(crc32_mod(doc_id, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Machine:
    """Learns from ``labels`` (doc_id, toxic 0 or 1) of texts in ``docs`` (doc_id, text). The driver gets the sample's terms only."""
    bounded_batches(docs.sparkSession)
    labels = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(~held_out(F.col("doc_id")))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train_machine([], np.zeros(0), 0.5)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = lambda c: F.lit(min(1.0, sample / max(1, sizes.get(c, 0))) * (1 << 30))
    chosen = labels.where(h < F.when(F.col("toxic") == 1, share(1)).otherwise(share(0)))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(np.array([t for w in words(x) for t in _terms(w)], np.int32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "terms"])

    texts = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    picked = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))), "doc_id")  # some 2 x sample rows of 12 bytes
    got = sorted(picked.select("doc_id", "text", "toxic").mapInArrow(terms, "doc_id long, toxic int, terms binary").collect(), key=lambda r: (r["doc_id"], bytes(r["terms"])))
    prior = np.clip(sizes.get(1, 0) / sum(sizes.values()), 1e-3, 1 - 1e-3)
    return train_machine([np.frombuffer(r["terms"], np.int32).astype(np.int64) for r in got], np.array([r["toxic"] for r in got]), float(prior), **options)


def scorer(spark, machine: Machine):
    """A function of a text column: its score."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(machine)  # 2**BITS rows at most, and as many as the sample gives evidence for

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for array in arrays:
            out = np.zeros(len(array))
            for a, b in text_slices(array):
                rows = []
                for text in array.slice(a, b - a).to_pylist():
                    found: set[int] = set()
                    for w in words(text):
                        t = known.get(w)
                        if t is None:
                            if len(known) >= CACHE:
                                known.clear()
                            t = known[w] = tuple(m.row[x] for x in _terms(w) if x in m.row)
                        if t:
                            found.update(t)
                    rows.append(sorted(found))
                starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                index = np.fromiter((t for r in rows for t in r), np.int64, int(starts[-1]))
                out[a:b] = 1 / (1 + np.exp(-np.clip(m.margins(index, starts), -700, 700)))
            yield pa.array(out)

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    A null, empty or wordless text gets the score of no terms. Texts are read whole, however long. Each row gives a
    row: rows may repeat, ids be null, scores tie. Without rows the result is empty. Extra columns aren't read.
    """
    cols = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = cols.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs.sparkSession, machine)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` (text) that score below 0.5, with the columns they came with, clashing names too.

    A null, empty or wordless text has the score of no terms. Rows that repeat stay or go together. Without rows
    the result is empty.
    """
    rows, columns = set_apart(docs, "text")
    return rows.where(scorer(docs.sparkSession, machine)(F.col("text")) < 0.5).select(*columns)
