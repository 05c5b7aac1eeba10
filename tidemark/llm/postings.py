"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by k-means with a penalty on full clusters, on a bounded sample of SAMPLE vectors;
there are about the square root of the number of vectors, and at most MAX_CENTROIDS, so that lists and their number grow alike. They stay in memory with a graph of their near ones, and a best-first
walk over the graph finds the centroids nearest to a vector. Every vector is filed in the list of its
nearest centroid, and a boundary vector also in those of centroids hardly farther away. A query reads the
lists of the centroids within a distance ratio of its nearest one, and more of the nearest until they hold enough
vectors. A long list is dealt out in blocks, each its
own group, so a vector that occurs very often burdens no task.

Vectors null, empty, zero or with null or non-finite components take no part, nor do null ids. Equal rows
of one vec_id count once; rows of one vec_id with different vectors once each. Vectors are compared with those of equal length only. Extra columns
aren't read. Without queries the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, drop_tables, materialize, pick
from .vectors import matrix, one_length, unit, usable

SAMPLE, MAX_CENTROIDS = 20_000, 4096
#: Copies of a boundary vector at most, and how much farther than the nearest their centroids may be.
COPIES, COPY_RATIO = 2, 1.05
#: Lists that a query reads at most, as a share of all, and how much farther their centroids may be.
READ_SHARE, READ_RATIO = 0.45, 1.3
#: Vectors, copies counted, that the lists read for a query hold at least.
LEAST_READ = 4096
NEIGHBOURS, BLOCK = 24, 2048


def number_of_lists(n: int) -> int:
    return round(n**0.5)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows; the penalty grows with a cluster's share, so lists come out alike in length."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    load = np.ones(len(c))
    for _ in range(rounds):
        owner = np.concatenate([np.argmax(x[a : a + 4096] @ c.T - 0.05 * load, axis=1) for a in range(0, len(x), 4096)])
        count = np.bincount(owner, minlength=len(c)).astype(float)
        load = 0.5 * load + 0.5 * count * len(c) / len(x)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        empty = count == 0
        if empty.any():
            sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


class Graph:
    """Centroids, and for each the NEIGHBOURS nearest others, half of them random far ones as shortcuts."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.c = centroids
        n = len(centroids)
        m = min(NEIGHBOURS, n - 1)
        sims = centroids @ centroids.T
        np.fill_diagonal(sims, -np.inf)
        near = np.argsort(-sims, axis=1, kind="stable")[:, :m]
        if m == NEIGHBOURS and n > 2 * NEIGHBOURS:
            near[:, m - m // 4 :] = np.random.default_rng(seed).integers(0, n, (n, m // 4))
        self.near = near

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids found for each unit row and their cosines, best first; a walk that keeps ``want`` and half again."""
        n = len(self.c)
        want = min(want, n)
        beam = min(n, want + max(16, want // 2))
        rows = np.arange(len(x))[:, None]
        entry = np.arange(0, n, max(1, n // 32))
        sims = np.full((len(x), n), -np.inf)  # of the centroids seen so far
        sims[:, entry] = x @ self.c[entry].T
        done = np.zeros((len(x), n), bool)
        while self.near.shape[1]:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam] if beam < n else np.broadcast_to(np.arange(n), (len(x), n))
            score = np.where(done[rows, top], -np.inf, sims[rows, top])
            best = np.argsort(-score, axis=1)[:, :4]
            live = score[rows, best] > -np.inf
            if not live.any():
                break
            node = top[rows, best]
            r, k = np.nonzero(live)
            done[r, node[r, k]] = True
            to = self.near[node[r, k]]
            r = np.repeat(r, to.shape[1])
            to = to.ravel()
            new = sims[r, to] == -np.inf
            r, to = r[new], to[new]
            sims[r, to] = np.einsum("ij,ij->i", x[r], self.c[to])
        order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
        return order, sims[rows, order]


def _cells(graphs, most, ratio: float, sizes=None, least: int = 0):
    """(id, dim, embedding) -> the same with each cell it goes to; with ``sizes`` of lists at least so many that they hold ``least`` vectors, if all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim = graphs.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                graph: Graph = by_dim[int(d)]
                part = batch.filter(pa.array(dims == d))
                for a in range(0, part.num_rows, 256):
                    rows = part.slice(a, 256)
                    x, want = unit(matrix(rows.column(2))), most(len(graph.c))
                    found, sims = graph.search(x, want)
                    if sizes is not None and (sizes.value[int(d)][found] * (sims > -np.inf)).sum(axis=1).min() < least:
                        found = np.argsort(-(x @ graph.c.T), axis=1, kind="stable")
                        sims = np.take_along_axis(x @ graph.c.T, found, axis=1)
                    far = np.sqrt(np.maximum(0, 2 - 2 * sims))
                    near = far <= ratio * far[:, :1] + 1e-12
                    near[:, want:] = False
                    if sizes is not None:
                        held = sizes.value[int(d)][found]
                        near |= np.cumsum(held, axis=1) - held < least
                    r, k = np.nonzero(near & (sims > -np.inf))
                    rows = rows.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found[r, k].astype(np.int32))], names=["id", "dim", "embedding", "cell"])

    return run


def _once(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, equal rows once."""
    ids, x = table.column("id").to_numpy(), matrix(table.column("embedding"))
    if len(np.unique(ids)) < len(ids):
        seen: dict[tuple[int, bytes], int] = {}
        for r, i in enumerate(ids.tolist()):
            seen.setdefault((i, x[r].tobytes()), r)
        rows = np.fromiter(seen.values(), np.int64, len(seen))
        ids, x = ids[rows], x[rows]
    return ids, x


def _nearest(k: int):
    def run(key, left, right):
        """The k best candidates of this block for each query."""
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            (qid, q), (cid, c) = _once(left), _once(right)
            uq, uc = unit(q), unit(c)
            for a in range(0, len(q), 256):
                sims = uq[a : a + 256] @ uc.T
                sims[qid[a : a + 256][:, None] == cid[None, :]] = -np.inf
                kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if len(c) > k else np.full(len(sims), -2.0)
                i, j = np.nonzero((sims >= kth[:, None] - 1e-9) & (sims > -np.inf))
                x, y = q[a + i], c[j]
                exact = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                bad = ~np.isfinite(exact)  # squares out of a double's range
                exact[bad] = (uq[a + i[bad]] * uc[j[bad]]).sum(axis=1)
                order = np.lexsort((cid[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                first = np.searchsorted(i, np.arange(len(sims)))
                keep = np.arange(len(i)) - first[i] < k
                for o, v in zip(out, (qid[a + i[keep]], cid[j[keep]], exact[keep])):
                    o.append(v)
        cat = [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(cat[0]), "vec_id": pa.array(cat[1]), "score": pa.array(cat[2])})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, lists_of: Callable[[int], int] = number_of_lists, least_read: int = LEAST_READ) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``vectors`` (vec_id, embedding) that is a query.

    Candidates are all rows but those of the query's own id; nearness is the cosine in double precision,
    of equal ones the smaller vec_id comes first. ``lists_of`` says how many lists so many vectors get;
    a query reads lists until they hold ``least_read`` vectors, or all.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    cols = pick(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    fine = one_length(cols.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())).select(F.col("vec_id").alias("id"), "dim", "embedding")
    sizes = {r["dim"]: r["n"] for r in fine.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / sum(sizes.values()))
    drawn: dict[int, list] = {}
    for r in sorted(fine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).collect(), key=lambda r: r["id"]):
        drawn.setdefault(r["dim"], []).append(r["embedding"])
    fitted = {}
    for d, n in sizes.items():
        x = unit(np.array(drawn[d], float)) if d in drawn else np.eye(1, d)
        fitted[d] = Graph(fit_centroids(x, int(np.clip(lists_of(n), 1, min(MAX_CENTROIDS, len(x))))))
    graphs = spark.sparkContext.broadcast(fitted)  # MAX_CENTROIDS vectors of each length at most
    schema = "id long, dim int, embedding array<float>, cell int" if dict(fine.dtypes)["embedding"] == "array<float>" else "id long, dim int, embedding array<double>, cell int"
    if "array<float>" not in schema:
        fine = fine.withColumn("embedding", F.col("embedding").cast("array<double>"))
    lists = materialize(fine.mapInArrow(_cells(graphs, lambda n: COPIES, COPY_RATIO), schema), "lists")
    held = {d: np.zeros(len(g.c), np.int64) for d, g in fitted.items()}
    for r in lists.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect():  # a row for each centroid at most
        held[r["dim"]][r["cell"]] = r["n"]
    sizes = spark.sparkContext.broadcast(held)
    asked = fine.where(is_query if is_query is not None else F.lit(True))
    asked = materialize(asked.mapInArrow(_cells(graphs, lambda n: max(8, int(n * READ_SHARE)), READ_RATIO, sizes, max(least_read, COPIES * (k + 1))), schema), "queries")
    cell = ["dim", "cell"]
    blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shape = materialize(blocks(lists, "gl").join(blocks(asked, "gq"), cell), "shape")  # a row for each centroid at most
    spread = lambda own, g: F.pmod(F.xxhash64("id", F.lit(own)), F.col(g)).cast("int").alias(own)
    left = asked.join(shape, cell).select(*cell, "id", "embedding", spread("bq", "gq"), F.explode(F.sequence(F.lit(0), F.col("gl") - 1)).alias("bl"))
    right = lists.join(shape, cell).select(*cell, "id", "embedding", spread("bl", "gl"), F.explode(F.sequence(F.lit(0), F.col("gq") - 1)).alias("bq"))
    group = [*cell, "bq", "bl"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    # each task keeps k for a query before the one shuffle; a copy of a boundary vector has the rank of the other
    rank = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    out = materialize(found.select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_tables(lists, asked, shape)
    return out
