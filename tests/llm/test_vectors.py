import numpy as np
import pytest
from brute import components, cosine
from pyspark.sql import functions as F

from tidemark.llm import crosspolytope, postings

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(n: int, seed: int, spread: float, dim: int = 24, centres: int = 12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(int(i), [float(x) for x in (c[i % centres] + spread * rng.normal(size=dim)).astype(np.float32)], int(i % centres % 3)) for i in rng.permutation(n)]


def linked(rows, least):
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    return [(a[0], b[0]) for i, a in enumerate(ok) for b in ok[i + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= least]


def want(rows, least=0.93):
    links = linked(rows, least)
    comp = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_hadamard_is_orthogonal():
    h = crosspolytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)
    x = np.random.default_rng(0).normal(size=(5, 24))
    assert np.allclose((crosspolytope.rotated(x, 3) ** 2).sum(axis=1), (x**2).sum(axis=1))


def test_buckets_are_the_best_pairs_of_axes():
    x = np.random.default_rng(1).normal(size=(7, 24))
    b = crosspolytope.buckets(x, tables=2, hashes=2, probes=3)
    for t in range(2):
        ys = [crosspolytope.rotated(x, 2 * t + k + 1) for k in (0, 1)]
        for i in range(7):
            top = [int(np.abs(y[i]).argmax()) for y in ys]
            own = [2 * a + (y[i, a] < 0) for a, y in zip(top, ys)]
            assert b[i, t, 0] == own[0] * 64 + own[1] and len(set(b[i, t].tolist())) == 4


def test_tables_of_vectors(spark, larger):
    df = larger("embeddings")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert got(crosspolytope.near_duplicates(df)) == want(rows)


@pytest.mark.parametrize("block", [16, 1024])
def test_clusters_against_all_pairs(spark, block):
    rows = clusters(600, 2, 0.22)
    links = linked(rows, 0.93)
    out = crosspolytope.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block)
    found = sum(r.n_links for r in out.collect()) / 2
    assert 500 < len(links) and 0.98 * len(links) <= found <= len(links)
    comp = want(rows)
    assert np.mean([r.component_id == comp[r.vec_id][1] for r in out.collect()]) > 0.98


def test_many_copies_count_as_links(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50)] + [(100 + i, [1.0, 2.0, 3.001], 1) for i in range(3)] + [(200, [1.0, 2.0, 3.0], 2)]
    out = got(crosspolytope.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert out == want(rows) and out[0] == (52, 0, True) and out[200] == (0, 200, True)


ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 1.0], None), (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1),
    (10, [1.0, 1.0, 0.0], 1), (11, [3.0], 1), (12, [4.0], 1), (13, [-1.0, -1.0], 1), (14, [1e-30, 1e-30], 1), (15, [1e30, 1e30], 1), (20, [1.0, 1.0], 1), (-5, [0.0, -0.0], 1),
]


def test_odd_vectors(spark):
    out = crosspolytope.near_duplicates(spark.createDataFrame([*ODD, (None, [1.0, 1.0], 1)], SCHEMA))
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert rows.pop(None) == (0, None, False)
    assert {i: rows[i] for i in (1, 2, 3, 4, 5, 6, 7, 10, 13, -5)} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 13, -5)}
    assert {i: rows[i][:2] for i in (8, 9, 14, 15, 20)} == dict.fromkeys((8, 9, 14, 15, 20), (4, 8)) and {i: rows[i][:2] for i in (11, 12)} == dict.fromkeys((11, 12), (1, 11))
    assert crosspolytope.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def nearest(rows, asked, k=5):
    ok = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    out = {}
    for q in ok:
        if asked(q[0]):
            out[q[0]] = sorted(((-cosine(q[1], c[1]), c[0]) for c in ok if c[0] != q[0] and len(c[1]) == len(q[1])))[:k]
    return out


@pytest.mark.parametrize("table", ["sf0.01", "clusters", "spread"])
def test_recall(spark, larger, table):
    if table == "sf0.01":
        rows = [(r.vec_id, list(r.embedding), r.label) for r in larger("embeddings").collect()]
    else:
        rows = clusters(4000, 3, 0.25 if table == "clusters" else 1.0)
    df = spark.createDataFrame(rows, SCHEMA)
    true = nearest(rows, lambda i: i % 50 == 0)
    out: dict[int, list] = {}
    least = 0 if table == "clusters" else postings.LEAST_READ  # clusters are found by the nearest lists alone
    for r in postings.search(df, F.col("id") % 50 == 0, least_read=least).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(out) == set(true)
    hits = 0
    vec = {r[0]: r[1] for r in rows}
    for q, found in out.items():
        assert [x[0] for x in found] == list(range(1, len(found) + 1)) and len(found) == 5
        assert [x[1:] for x in found] == sorted(x[1:] for x in found)
        assert all(-s == pytest.approx(cosine(vec[q], vec[i]), abs=1e-12) for _, s, i in found)
        hits += len({i for _, i in true[q]} & {i for *_, i in found})
    assert hits >= 0.9 * 5 * len(true)


def test_odd_candidates(spark):
    rows = [r for r in ODD if r[0] != 12]
    found = postings.search(spark.createDataFrame([*rows, (None, [1.0, 1.0], 1)], SCHEMA), F.col("id") % 10 == 0).orderBy("query_id", "rank").collect()
    true = nearest(rows, lambda i: i == 20)[20]
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(20, n, i, -s) for n, (s, i) in enumerate(true, 1)]
    assert postings.search(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0).count() == 0


def test_tiny_lists_are_read_until_there_are_enough(spark):
    """Each query sits on a centroid of its own, whose list has no other vector."""
    rows = [(i, [float(j == i // 50) for j in range(8)], 1) for i in range(0, 400, 50)] + [(1 + i, [1.0, 1.0 + 1e-3 * i, 1.0, 1.0, -1.0, 1.0, 1.0, 2.0], 1) for i in range(4)]
    found = postings.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0, lists_of=lambda n: n, least_read=0).groupBy("query_id").count().collect()
    assert len(found) == 8 and all(r["count"] == 5 for r in found)


def test_copies_tie_by_id(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(3000)]
    found = postings.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 1000 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found if r.query_id == 0] == [1, 2, 3, 4, 5] and [r.vec_id for r in found if r.query_id == 1000] == [0, 1, 2, 3, 4]


def test_equal_rows_of_one_id_count_once(spark):
    """A vec_id that is repeated more often than k doesn't push others out."""
    rows = [(7, [1.0, 0.1], 1)] * 12 + [(i, [1.0, 0.1 * i], 1) for i in (3, 4, 5, 6)] + [(50, [1.0, 0.0], 1)] * 3
    found = postings.search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") == 50).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == [(1, 7), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_no_bucket_twice():
    b = crosspolytope.buckets(np.random.default_rng(2).normal(size=(50, 2)), tables=4, hashes=3, probes=20)
    for row in b.reshape(200, 21).tolist():
        real = [n for n in row if n >= 0]
        assert row[0] >= 0 and len(real) == len(set(real)) > 1


def test_pairs_at_the_threshold_meet():
    """Pairs of cosine 0.93 and no more: hardly one in 10,000 meets in no table."""
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(4000, 64)), rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = crosspolytope.buckets(x), crosspolytope.buckets(y)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert met.any(axis=1).sum() >= 3999 and met.mean() > 0.6
