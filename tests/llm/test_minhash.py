import random

import numpy as np
import pytest
from brute import document_components, frame, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import minhash
from tidemark.llm.common import hash_words, shingles, words
from tidemark.llm.components import components
from tidemark.llm.superminhash import SLOTS, signatures


def result(df) -> dict[int, tuple[int, int]]:
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def variants(n: int, seed: int, changes: int) -> list[str]:
    """Texts of some 100 words, each the one before with a few words changed: similar in chains."""
    rng = random.Random(seed)
    ws = [f"w{rng.randrange(4000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        out.append(" ".join(ws))
        for _ in range(changes):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(4000)}"
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB é\t\n "), max_size=40), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, k):
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    begins, ends, starts = words(data, off)
    s, at = shingles(hash_words(data, begins, ends), starts, k)
    by: dict[int, tuple] = {}
    for i, t in enumerate(texts):
        got, want = s[at[i] : at[i + 1]].tolist(), shingle_set(t, k)
        assert len(got) == len(want) and got == sorted(got)
    sets = [frozenset(s[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingle_set(a, k) & shingle_set(b, k))
    assert by == {}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(200 * share), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (200 - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append((sig[0] == sig[1]).mean() - len(both) / 200)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05  # MinHash of 128 slots would have up to 0.044


def test_a_set_s_signature_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 500, 0, 3, 40)]
    together = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert together.shape == (5, SLOTS)
    for i, s in enumerate(sets):
        assert np.array_equal(together[i], signatures(s, np.array([0, len(s)]))[0])


@pytest.mark.parametrize("k, percent", [(4, 80), (5, 80)])
def test_documents_against_all_pairs(spark, larger, k, percent):
    rows = [(r.doc_id, r.text) for r in larger("documents").select("doc_id", "text").collect()]
    assert result(minhash.near_duplicates(frame(spark, rows).repartition(5), k, percent)) == document_components(rows, k, percent)


@pytest.mark.parametrize("block", [8, 1024])
def test_chains_and_groups_against_all_pairs(spark, block):
    """Chains, in which the smallest document resembles few others, and blocks so small that buckets are split."""
    texts = [t for seed, changes in ((1, 1), (2, 2), (3, 3), (4, 4)) for t in variants(60, seed, changes)]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    rows = [(i, texts[j]) for i, j in enumerate(order)]
    assert result(minhash.near_duplicates(frame(spark, rows).repartition(4), 4, 80, block=block)) == document_components(rows, 4, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one  two"), (6, "one two three"), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "A B C D"), (-3, "x " * 50_000), (-2, "X " * 50_000)]
    got = [tuple(r) for r in minhash.near_duplicates(frame(spark, rows), 4, 80).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (None, 1, None, False), (9, 1, 7, False), (-3, 1, -3, True), (-2, 1, -3, False)], key=str)
    assert minhash.near_duplicates(frame(spark, []), 4, 80).collect() == []


def test_extra_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b c", "z", 1), (2, "a b c", "y", 2)], "doc_id long, text string, component_id string, KEPT int")
    assert result(minhash.near_duplicates(df)) == {1: (1, 1), 2: (1, 1)}


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(1, "a b c", "z", 1), (2, "a b c", "y", 2), (3, None, "x", 3), (3, None, "x", 3), (None, "a b c", "n", 4)], "doc_id long, text string, sig string, TEXT int")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted([r[0] for r in kept.collect()], key=str) == [1, 3, None]
    assert minhash.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (9, 9), (None, 1), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15), (20, 15)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, **dict.fromkeys([10, 11, 12, 13, 14, 15, 20], 10)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    line = list(range(300))
    random.Random(1).shuffle(line)
    got = {r.node: r.component for r in components(spark.createDataFrame(list(zip(line, line[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(range(300), 0)


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rows = [(1, "a b c d e"), (3, "unrelated words in this text"), (1, "quite other words stand here"), (3, "A b c d e"), (5, ""), (5, None), (1, "a b c d e")]
    got = sorted(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, 1, True)] * 3 + [(3, 1, 1, False), (3, 1, 3, True), (5, 0, 5, True), (5, 0, 5, True)]
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one(frame(spark, rows)).collect())
    assert [i for i, _ in kept] == [1, 1, 3, 5] and kept[:3] == [(1, "a b c d e"), (1, "quite other words stand here"), (3, "unrelated words in this text")]


def test_sets_drawn_for_in_stretches_have_the_same_signatures():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (5, 700, 0, 90)]
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    assert np.array_equal(signatures(flat, starts, stretch=64), signatures(flat, starts))
