import numpy as np
from brute import SCHEMA, frame

from tidemark.llm import toxicity


def auc(score, label) -> float:
    pos, neg = score[label == 1], score[label == 0]
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_margins_are_those_of_the_formula():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    want = [m.bias + sum(m.weights[i] for i in r) + sum(m.factors[i] @ m.factors[j] for n, i in enumerate(r) for j in r[n + 1 :]) for r in rows]
    flat = np.array([i for r in rows for i in r])
    assert np.allclose(m.margins(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])])), want)


def test_pairs_are_learnt_that_no_single_term_tells():
    """An insult alone and a group alone are fine; together they aren't."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(800):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique([*rng.integers(10, 60, 5), *([1] if insult else [2]), *([3] if group else [4])]))
        labels.append(int(insult == group))  # so that neither tells anything by itself
    labels = np.array(labels)
    m = toxicity.train_machine(rows, labels, 0.5)
    index = [np.array([m.row[t] for t in r.tolist() if t in m.row]) for r in rows]
    score = m.margins(np.concatenate(index), np.concatenate([[0], np.cumsum([len(r) for r in index])]))
    assert auc(score, labels) > 0.95


def test_held_out_texts_are_told_apart(large):
    docs, labels = large("documents"), large("labels")
    m = toxicity.fit(docs, labels)
    got = toxicity.score(docs, m).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark, larger):
    docs, labels = larger("documents"), larger("labels")
    other = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (toxicity.fit(docs, x) for x in (labels, other))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors)


def test_every_row_has_a_score(spark, larger):
    m = toxicity.fit(larger("documents"), larger("labels"))
    rows = [(1, None), (2, ""), (3, "12 34"), (None, "abc"), (4, "abc"), (4, "abc"), (5, "word " * 100_000)]
    got = toxicity.score(frame(spark, rows), m).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(frame(spark, []), m).count() == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b"), (2, "c d")])
    for labels in ([], [(None, 1)], [(1, None)], [(1, 0), (2, 0)]):
        m = toxicity.fit(docs, frame(spark, labels, "doc_id long, toxic int"))
        assert {r.predicted for r in toxicity.score(docs, m).collect()} <= {0, 1}


def test_the_stage_keeps_clean_rows_whole(spark, larger):
    docs, labels = larger("documents"), larger("labels")
    m = toxicity.fit(docs, labels)
    kept = toxicity.keep_clean(docs, m)
    assert kept.columns == docs.columns
    assert kept.join(labels.where("toxic = 0"), "doc_id").count() >= 0.98 * labels.where("toxic = 0").count()
    assert kept.join(labels.where("toxic = 1"), "doc_id").count() <= 0.2 * labels.where("toxic = 1").count()
    assert toxicity.keep_clean(frame(spark, [], SCHEMA), m).count() == 0
    odd = frame(spark, [(1, "a", 3)], "doc_id long, text string, TEXT long")
    assert toxicity.keep_clean(odd, m).columns == odd.columns and toxicity.keep_clean(odd, m).count() <= 1
