"""Near-duplicate vectors by cross-polytope hashing.

A hash is the signed axis nearest to the vector after three rounds of random signs and a fast Hadamard
transform. TABLES tables use HASHES hashes each; a vector is filed under its own bucket of each table and
also under the next PROBES best ones (multiprobe), and meets the vectors whose own bucket one of them is.

Equal vectors of one label (by 128 bits of hash) form a class first, with its size and smallest id, so a
vector that occurs a million times is one row. Only numbers of buckets are shuffled until those are known in
which vectors meet. These buckets are split into blocks, and a group is a pair of one bucket's blocks, or a
whole bucket of one block. A task takes some thousand rows of groups at once, most of which are small. It
computes cosines of their pairs in double precision, counts each pair once (in the first table and bucket
where it meets), and emits for each vector its number of links, and links only as far as they join
components. No pair is dropped or written twice.

Vectors that are null, empty, zero or hold null or non-finite components, or whose label is null, link
with nothing, and so do vectors of different lengths. A null vec_id takes no part. Extra columns aren't
read; without vectors the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_tables, materialize, pick
from .components import components
from .vectors import matrix, one_length, unit, usable

TABLES, HASHES, PROBES, BLOCK = 12, 3, 7, 1024
#: Rows of buckets that a task looks at together, as they come on average; rows up to which a bucket's pairs are listed one by one; pairs at a time.
TOGETHER, SMALL, PAIRS = 4096, 48, 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], n))
    return x


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Numbers of 31 bits [row, table, 1 + probes]: the own bucket first, then the next best tuples of axes; -1 in place of one that was there before, or if a short vector has fewer."""
    out = np.full((len(x), tables, 1 + probes), -1, np.int64)
    rows = np.arange(len(x))[:, None]
    axes = 2 << max(0, x.shape[1] - 1).bit_length()
    for t in range(tables):
        number, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k in range(hashes):
            y = rotated(x, hashes * t + k + 1)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : 1 + probes]
            far = size[rows, top[:, :1]] - size[rows, top]
            # the best tuples extend the best shorter ones
            loss = (loss[:, :, None] + (far**2)[:, None, :]).reshape(len(x), -1)
            number = ((number[:, :, None] * axes + (2 * top + (y[rows, top] < 0))[:, None, :]) % 2_147_483_647).reshape(len(x), -1)
            order = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
            number, loss = number[rows, order], loss[rows, order]
        out[:, t, : number.shape[1]] = number
    for j in range(1, 1 + probes):
        out[:, :, j][(out[:, :, j : j + 1] == out[:, :, :j]).any(axis=2)] = -1
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a vector's buckets, flat, to (rep, label, dim, n, embedding)."""
    for batch in batches:
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            keys = buckets(unit(matrix(part.column(4))))
            flat = keys.reshape(len(keys), -1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "keys"])


def _small_pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows p < q within each stretch of rows, PAIRS or a little more at a time."""
    sizes = ends - starts
    row = np.arange(len(starts)).repeat(sizes)
    at = np.arange(len(row)) - (np.cumsum(sizes) - sizes).repeat(sizes) + starts[row]
    rest = ends[row] - at - 1
    total = np.cumsum(rest)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        n = rest[a:b]
        u = at[a:b].repeat(n)
        yield u, u + 1 + np.arange(len(u)) - (np.cumsum(n) - n).repeat(n)
        a = b


def _large_pairs(x: np.ndarray, rows: np.ndarray, side: np.ndarray, apart: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket's rows, or of its two blocks if ``apart``, that a matrix product finds near."""
    left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if apart else (rows, rows)
    for a in range(0, len(left), 128):
        near = x[left[a : a + 128]] @ x[right].T >= least - 1e-9
        if not apart:
            near &= left[a : a + 128, None] < right[None, :]
        p, q = np.nonzero(near)
        for c in range(0, len(p), PAIRS):
            yield left[a + p[c : c + PAIRS]], right[q[c : c + PAIRS]]


def _linking(least: float):
    def run(key, table):
        """Each vector's number of links counted here, and links that join components of what this task sees.

        The table holds many buckets, each whole or as a pair of its blocks.
        """
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, TABLES, -1)
        t, probe = np.divmod(table.column("at").to_numpy(), keys.shape[2])
        place = [label, t, keys[np.arange(len(t)), t, probe], *(table.column(c).to_numpy() for c in ("i", "j"))]
        order = np.lexsort(place[::-1])
        table, keys, own, place = table.take(pa.array(order)), keys[order], probe[order] == 0, [c[order] for c in place]
        _, t, bucket, i, j = place
        new = np.ones(len(t) + 1, bool)
        new[1:-1] = np.any([c[1:] != c[:-1] for c in place], axis=0)
        bounds = np.flatnonzero(new)
        starts, ends = bounds[:-1], bounds[1:]
        x, n, side = unit(matrix(table.column("embedding"))), table.column("n").to_numpy(), table.column("side").to_numpy()
        reps, who = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        links = np.zeros(len(reps), np.int64)
        parent = list(range(len(reps)))
        joined = []

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def settle(u: np.ndarray, v: np.ndarray) -> None:
            ok = own[u] | own[v]
            u, v = u[ok], v[ok]
            ok = np.einsum("ij,ij->i", x[u], x[v]) >= least
            u, v = u[ok], v[ok]
            if not len(u):
                return
            meets_u = (keys[u][:, :, :1] == keys[v]).any(axis=2)  # u's own bucket is one of v's
            meets_v = (keys[v][:, :, :1] == keys[u]).any(axis=2)
            first = (meets_u | meets_v).argmax(axis=1)
            r, far = np.arange(len(u)), np.int64(1 << 62)
            where = np.minimum(np.where(meets_u[r, first], keys[u, first, 0], far), np.where(meets_v[r, first], keys[v, first, 0], far))
            ok = (first == t[u]) & (where == bucket[u])
            u, v = u[ok], v[ok]
            np.add.at(links, who[u], n[v])
            np.add.at(links, who[v], n[u])
            for e, f in zip(who[u].tolist(), who[v].tolist()):
                e_, f_ = find(e), find(f)
                if e_ != f_:
                    parent[max(e_, f_)] = min(e_, f_)
                    joined.append((e, f))

        small = (ends - starts <= SMALL) & (i[starts] == j[starts])
        for u, v in _small_pairs(starts[small], ends[small]):
            settle(u, v)
        for a, b in zip(starts[~small].tolist(), ends[~small].tolist()):
            for u, v in _large_pairs(x, np.arange(a, b), side, i[a] != j[a], least):
                settle(u, v)
        some = np.flatnonzero(links)
        a, b = (np.array([p[k] for p in joined], np.int64) for k in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([reps[some], reps[a]])),
            "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), reps[b]]), mask=np.arange(len(some) + len(b)) < len(some)),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(b), np.int64)])),
        })

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label are linked if their cosine is ``least`` or more. n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, kept is vec_id = component_id.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    cols = pick(vectors, "vec_id", "embedding", "label").withColumn("vec_id", F.col("vec_id").cast("long"))
    fine = one_length(cols.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    fine = fine.withColumn("d0", F.xxhash64("dim", "embedding")).withColumn("d1", F.xxhash64(F.lit(1), F.reverse("embedding")))
    same = ["label", "d0", "d1"]
    classes = materialize(fine.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding")), "classes")
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("rep", "label", "dim", "n", "embedding")) + ", keys array<int>"
    hashed = materialize(classes.select("rep", "label", "dim", "n", "embedding").mapInArrow(_hashed, schema), "hashed")
    filed = hashed.select("rep", "label", "dim", F.posexplode("keys").alias("at", "bucket")).where("bucket >= 0")
    table = F.floor(F.col("at") / (1 + PROBES)).cast("int")
    filed = filed.select("rep", "at", F.xxhash64("label", "dim", table, "bucket").alias("place"))  # places of one number are told apart later
    own = (F.col("at") % (1 + PROBES) == 0).alias("own")
    busy = filed.groupBy("place").agg(F.count("*").alias("members"), F.max(own).alias("any_own")).where("members > 1 and any_own")
    busy = busy.select("place", F.ceil(F.col("members") / block).cast("int").alias("g"))
    member = filed.join(busy, "place").withColumn("mine", F.pmod(F.xxhash64("rep"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    member = member.select("place", "at", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "rep")
    member_table = materialize(member, "members")
    parts = max(1, member_table.count() // TOGETHER)
    member = member_table.withColumn("part", F.pmod(F.xxhash64("place", "i", "j"), F.lit(parts)).cast("int")).drop("place")
    member = member.join(hashed, "rep")
    found = materialize(member.groupBy("dim", "part").applyInArrow(_linking(least), "a long, b long, links long"), "found")

    comp = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = classes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = fine.select("vec_id", *same).join(of_class, same).select("vec_id", "n_links", "component_id")
    alone = cols.where(~(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    out = materialize(out, "duplicates")
    drop_tables(classes, hashed, member_table, found)
    return out


#: DuckDB: all pairs of one label.
ORACLE_SQL = r"""
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings where label is not null and embedding is not null and vec_id is not null),
u as (select vec_id, label, x, len(x) as dim from v where len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.dim = b.dim and a.vec_id < b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.93),
e as (select a, b from l union all select b, a from l),
n as (select a as vec_id, count(*) as n from e group by a),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
m as (select a as vec_id, min(b) as component_id from r group by a)
select d.vec_id, coalesce(n.n, 0)::bigint as n_links, m.component_id, d.vec_id = m.component_id as kept from embeddings d join m using (vec_id) left join n using (vec_id)
"""
