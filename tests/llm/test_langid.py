import math
import re

import numpy as np
import pytest
from brute import SCHEMA, frame

from tidemark.llm import langid
from tidemark.llm.spm import SPACE, default_model


@pytest.fixture(scope="module")
def fitted(larger):
    docs = larger("documents")
    return langid.fit(docs.where(~langid.held_out(docs["doc_id"])))


def paths(s: str, pieces: dict[str, int], unknown: int):
    """Every segmentation of s."""
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        p = pieces.get(s[:n], unknown if n == 1 else None)
        if p is not None:
            for rest in paths(s[n:], pieces, unknown):
                yield [p, *rest]


def test_the_forward_sum_is_over_all_segmentations(fitted):
    for word in ("the", "menteux", "ça", "wörter", "日本"):
        got = fitted.score([word])[0]
        for k in range(len(fitted.languages)):
            total = sum(math.prod(fitted.probs[p, k] for p in path) for path in paths(SPACE + word, fitted.pieces.number, fitted.pieces.size - 1))
            assert got[k] == pytest.approx(math.log(total), rel=1e-9)
        assert fitted._long(SPACE + word)[-1] == pytest.approx(got, rel=1e-9)


def test_a_probability_sums_to_one(fitted):
    assert np.allclose(fitted.probs[:-1].sum(axis=0), 1)


def test_held_out_texts_are_identified(larger):
    docs = larger("documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").toPandas()
    lettered = got[got.text.map(lambda t: len(re.findall(r"[^\W\d_]+", t)) >= 5)]
    assert len(lettered) > 100 and (lettered.lang_pred == lettered.lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_every_row_has_a_prediction(spark, larger, fitted):
    text = larger("documents").where("lang = 'fr'").first()["text"]
    rows = [(1, None), (2, ""), (3, "123 -- 456"), (4, text), (4, text), (None, text), (5, "x" * 200_000), (6, (text + " ") * 300)]
    got = langid.predict(frame(spark, rows), fitted).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[4].lang_pred == by[6].lang_pred == "fr" and by[5].lang_pred in fitted.languages
    assert langid.predict(frame(spark, []), fitted).count() == 0


def test_nothing_to_learn_from(spark):
    m = langid.fit(frame(spark, [("abc", None), (None, "en")], "text string, lang string"))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "abc")]), m).collect()] == ["und"]


def test_language_and_source_are_no_input(spark, larger, fitted):
    docs = larger("documents").limit(50)
    a = langid.predict(docs, fitted)
    b = langid.predict(docs.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source"), fitted)
    assert sorted(a.collect()) == sorted(b.collect())


def test_the_stage_keeps_rows_whole(spark, larger):
    docs = larger("documents")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 0.9 * docs.where("text rlike '[a-zA-Z]{3}'").count()
    assert langid.keep_identified(frame(spark, [], SCHEMA)).count() == 0
    odd = frame(spark, [(1, "the and of", "en", "lang_pred", 1), (3, None, None, None, 2)], "doc_id long, text string, lang string, score string, TEXT long")
    assert langid.keep_identified(odd).columns == odd.columns and langid.keep_identified(odd).collect() is not None


def test_the_vocabulary_is_a_parameter(fitted):
    assert langid.Pieces(open(default_model(), "rb").read()).size == fitted.pieces.size
