import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from brute import frame
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import spm

MODEL = open(spm.default_model(), "rb").read()


@pytest.fixture(scope="module")
def t():
    return spm.Transducer.load(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.default_model())


def test_whole_documents_are_encoded_as_the_library_does(t, library, larger):
    texts = [r.text for r in larger("documents").select("text").collect()]
    flat, n, _ = t.encode_all(pa.array(texts, pa.string()))
    end = np.cumsum(n)
    for text, e, k in zip(texts, end.tolist(), n.tolist()):
        ids = flat[e - k : e].tolist()
        assert ids == library.encode(text)
        assert t.decode(ids) == library.decode(ids) == text


@pytest.mark.parametrize("rule, one_space", [("identity", True), ("identity", False), ("nmt_nfkc", True)])
def test_the_normaliser_rewrites_as_the_library_does(rule, one_space):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=one_space)
    spec = dict(spm._fields(library.serialized_normalizer_spec()))
    ours = spm.Normaliser(spec.get(2, b""), True, one_space)
    for text in ["ﬁ  Ａ１ é", " a\tb ", "", "ÀÉ ß ǅ \u3000x", "e\u0301 ½ ™ ㍿", "plain", "  ", "\u0007ab\u00ad"]:
        assert ours(pa.array([text])).to_pylist()[0].replace(" ", spm.SPACE) == library.normalize(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the and  of \t\nqué日本🙂 <0x41></s>▁"), st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), max_size=40))
def test_any_text(text):
    t, library = spm._transducer(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    ids = t.encode(text)
    assert ids == library.encode(text)
    assert t.decode(ids) == text.replace("▁", " ")


def test_random_letters_make_long_paths(t, library):
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("etaoinshrdluETAOIN019.,-") for _ in range(200))
        assert t.encode(text) == library.encode(text)


def test_a_unigram_lattice_has_the_least_weight():
    """Against all segmentations."""
    rng = random.Random(5)
    pieces = ["<unk>", *"abc", "▁", "▁a", "ab", "bc", "abc", "ca", "cab", "▁ab"]
    t = spm.Transducer(pieces, [0.0, *[-rng.uniform(1, 6) for _ in pieces[1:]]], [2] + [1] * (len(pieces) - 1)).compiled()

    def best(s):
        if not s:
            return 0.0, []
        out = []
        for n in range(1, min(4, len(s)) + 1):
            p = t.arcs.get(s[:n])
            if p is not None or n == 1:
                w, ids = best(s[n:])
                out.append((w + (t.unknown_cost if p is None else -t.scores[p]), [0 if p is None else p, *ids]))
        return min(out)

    for _ in range(200):
        text = "".join(rng.choice("abc x") for _ in range(rng.randrange(1, 9)))
        want = best("▁" + text.replace(" ", "▁"))[1]
        merged = [p for i, p in enumerate(want) if p or not i or want[i - 1]]
        assert t.encode(text) == merged


def test_tables(spark):
    rows = [(1, None), (2, ""), (3, "the end"), (3, "the end"), (None, " two  spaces "), (4, "naïve 日本 🙂" * 3000)]
    encoded = spm.encode(frame(spark, rows))
    assert sorted((len(r.ids) for r in encoded.collect()))[:2] == [0, 0]
    back = sorted(((r.doc_id, r.text) for r in spm.decode(encoded).collect()), key=str)
    assert back == sorted([(i, x or "") for i, x in rows], key=str)
    assert spm.decode(frame(spark, [(1, None)], "doc_id long, ids array<int>")).first().text is None
    assert spm.encode(frame(spark, [])).count() == 0


def test_digests(spark, small, library):
    docs = small("documents")
    got = {r.doc_id: r for r in spm.digests(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text)
        assert (got[r.doc_id].n_pieces, got[r.doc_id].ids_crc32, got[r.doc_id].round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
