from brute import document_components

import corpus_pipeline
from tidemark.llm import langid, spm, toxicity

DIR = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_came_before(spark, small):
    docs = small("documents")
    labels = small("labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "clean", "deduplicate", "mix", "tokenize"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        after = stage(spark, before, DIR).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name != "tokenize":
            assert after.columns == before.columns
        if name == "language":
            m = langid.fit(before.where(~langid.held_out(before["doc_id"])))
            assert ids == {r.doc_id for r in langid.predict(before, m).collect() if r.lang_pred != "und" and r.score >= 0.5}
        elif name == "clean":
            assert ids == {r.doc_id for r in toxicity.score(before, toxicity.fit(before, labels)).collect() if not r.predicted}
        elif name == "deduplicate":
            comp = document_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert ids == {c for _, c in comp.values()} and after.count() == len(ids)
        elif name == "mix":
            assert ids <= {r.doc_id for r in before.collect()} and after.count() > 0
        else:
            t = spm._transducer(open(spm.default_model(), "rb").read())
            text = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == t.encode(text[r.doc_id]) for r in after.collect()) and after.count() == before.count()
        docs = after


def test_the_run_is_its_stages(spark, small):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "ids"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
