import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokenbin
from tidemark.llm.common import new_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenbin.default_tokenizer())


def expected(rows, library):
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark, larger, library):
    docs = larger("documents")
    got = [tuple(r) for r in tokenbin.round_trip(docs).collect()]
    assert sorted(got) == expected([(r.doc_id, r.text) for r in docs.collect()], library)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("don't I'LL  \t\n\x0b\x1c\u0085 　éÉΣς<|endoftext|>12"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=3))
def test_words_alone_encode_as_in_their_text(texts):
    library = Tokenizer.from_file(tokenbin.default_tokenizer())
    encoder = tokenbin.Encoder(open(tokenbin.default_tokenizer(), encoding="utf-8").read())
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts))
        want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_odd_rows(spark, library):
    rows = [(5, None), (3, ""), (9, "a " * 50_000), (-2, "x" * 5000), (7, "same"), (7, "same"), (None, "no id")]
    assert sorted([tuple(r) for r in tokenbin.round_trip(frame(spark, rows).repartition(3)).collect()], key=str) == sorted(expected(rows, library), key=str)
    assert tokenbin.round_trip(frame(spark, [])).count() == 0


def test_files_give_any_sequence_without_copying(spark, library):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x1"]) for _ in range(rng.randrange(3000)))) for i in range(120)]
    path = new_path(spark, "test-tokens")
    manifest = sorted(tokenbin.write(frame(spark, rows).repartition(2), path).collect())
    every = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    at = 0
    for r in manifest:
        f = tokenbin.Sequences(f"{path}/part-{r.part:06d}.arrow")
        assert isinstance(f.source, pa.MemoryMappedFile)
        assert len(f) == -(-r.tokens // tokenbin.SEQ_LEN)
        for row in rng.sample(range(len(f)), min(5, len(f))):
            ids, mask = f[row]
            here = every[at : at + r.tokens][row * tokenbin.SEQ_LEN : (row + 1) * tokenbin.SEQ_LEN]
            assert ids[mask].tolist() == here and mask.sum() == len(here) and len(ids) == tokenbin.SEQ_LEN and not ids.flags.owndata
        assert f.stretch(0, r.tokens).tolist() == every[at : at + r.tokens]
        sizes = {b.nbytes for b in f.batches[:-1]}
        assert len(sizes) <= 1
        at += r.tokens
    assert at == len(every)
