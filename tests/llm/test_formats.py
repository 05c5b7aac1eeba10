import re

import duckdb
import pyarrow as pa
import pytest
from brute import frame
from pyspark.sql import functions as F

from tidemark.llm import licenses, preference
from tidemark.llm.license_texts import TEXTS

TURNS = "pair_id long, side string, turn int, role string, text string"


def plain(turns):
    """Prompt, completions and spans of one pair, turn by turn."""
    sides = {s: sorted([t[2:] for t in turns if t[1] == s], key=lambda t: [(x is not None, x or 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(t)]) for s in ("chosen", "rejected")}
    n = 0
    while n < min(map(len, sides.values())) and sides["chosen"][n][1:] == sides["rejected"][n][1:]:
        n += 1

    def render(ts):
        out, spans = "", []
        for _, role, text in ts:
            out += f"<|{role or 'none'}|>\n"
            begin = len(out)
            out += f"{text or ''}<|end|>\n"
            if role == "assistant":
                spans.append((begin, len(out)))
        return out, spans

    return n, render(sides["chosen"][:n])[0], *[x for s in ("chosen", "rejected") for x in (render(sides[s][n:]) if sides[s] else (None, None))]


def formatted(spark, rows):
    return {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_spans and [tuple(s) for s in r.chosen_spans] if r.chosen_spans is not None else None, r.rejected, [tuple(s) for s in r.rejected_spans] if r.rejected_spans is not None else None) for r in preference.format_pairs(spark.createDataFrame(rows, TURNS)).collect()}


def test_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "why"),
        (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"), (2, "rejected", 1, "assistant", "b"),
        (3, "chosen", 5, None, None), (3, "chosen", 6, "assistant", "é🙂"), (3, "rejected", 5, None, None), (3, "rejected", 6, "assistant", None),
        (4, "chosen", 0, "user", "alone"), (5, "rejected", 1, "assistant", ""), (6, "chosen", 0, "user", "x"), (6, "chosen", 0, "user", "x"), (6, "rejected", 0, "user", "x"),
        (7, "chosen", None, "assistant", "first"), (7, "chosen", 0, "user", "x"), (7, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (8, None, 0, "user", "x"), (9, "chosen", 0, "assistant", "z" * 200_000), (9, "rejected", 0, "assistant", "z"),
    ]
    got = formatted(spark, rows)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    for pair, value in got.items():
        assert value == plain([r for r in rows if r[0] == pair]), pair
    assert preference.format_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_masks_cover_answers_only(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no")]
    _, prompt, chosen, spans, *_ = formatted(spark, rows)[1]
    assert prompt == "<|user|>\nhi<|end|>\n" and [chosen[a:b] for a, b in spans] == ["yes<|end|>\n"]


def test_pairs_against_sql(spark, larger):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(preference.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = preference.digests(preference.format_sides(preference.swapped_ends(larger("conversations")))).select(*names)
    assert got.where("prompt_turns > 0 and chosen_md5 <> rejected_md5").count() > 90
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, 0, "user", "a", "x", 1), (1, 0, "user", "a", "x", 1)], "conv_id long, turn long, role string, text string, side string, PAIR_ID long")
    assert [r.prompt_turns for r in preference.format_sides(preference.swapped_ends(df)).collect()] == [1, 1]


def test_swapped_ends(spark):
    rows = [
        (4, 0, "user", "a"), (4, 1, "assistant", "b"), (5, 7, "user", None), (5, 7, "user", None), (5, 8, None, "c"), (6, 0, "user", "alone"), (None, 0, "user", "lost"),
        (-2, None, "user", "x" * 300_000), (-1, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.pair_id: (r.prompt_turns, r.chosen, r.rejected) for r in preference.format_sides(preference.swapped_ends(df)).collect()}
    assert set(out) == {4, 5, 6, -2, -1}
    assert out[4] == (1, "<|assistant|>\nb<|end|>\n", "<|none|>\nc<|end|>\n") and out[5] == (2, "<|none|>\nc<|end|>\n", "<|assistant|>\nb<|end|>\n")
    assert out[6] == (0, "<|user|>\nalone<|end|>\n", None) and out[-2][0] == 0 and len(out[-1][2]) > 300_000
    con = duckdb.connect()
    con.register("conversations", pa.table({c: [r[i] for r in rows] for i, c in enumerate(df.columns)}))
    want = con.execute(preference.ORACLE_SQL)
    got = preference.digests(preference.format_sides(preference.swapped_ends(df))).select(*[d[0] for d in want.description])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert preference.swapped_ends(df.limit(0)).count() == 0


@pytest.mark.parametrize("change", [
    str.upper, lambda t: t.replace("\n", "\r\n   "), lambda t: "# Copyright (c) 2020 Someone, and others.\n" + t, lambda t: "Copyright 1999-2024 The Authors. All rights reserved.\n\n" + t, lambda t: t.replace("license", "licence").replace("License", "Licence"),
    lambda t: t.replace(",", " ,").replace("'", "’").replace('"', "“"), lambda t: " * " + t.replace("\n", "\n * "), lambda t: t.replace("noninfringement", "non-infringement").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"),
])
def test_copies_of_a_licence_have_its_digest(spark, change):
    rows = [(i, change(t)) for i, t in enumerate(TEXTS.values())]
    digests = {licenses.digest_text(t) for t in TEXTS.values()}
    for r in licenses.scan(frame(spark, rows)).collect():
        assert r.license_id is not None and r.digest in digests


def test_other_texts_are_no_licence(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, TEXTS["MIT"] + " and more"), (5, TEXTS["MIT"]), (5, TEXTS["MIT"]), (None, TEXTS["ISC"]), (6, "word " * 100_000)]
    got = [(r.doc_id, r.license_id) for r in licenses.scan(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, None), (3, None), (4, None), (5, "MIT"), (5, "MIT"), (None, "ISC"), (6, None)], key=str)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_driver_and_executors_normalise_alike(spark):
    rows = list(enumerate(TEXTS.values()))
    for (_, t), r in zip(rows, frame(spark, rows).select(licenses.canonical(F.col("text")).alias("c")).collect()):
        assert r.c == licenses.canonical_text(t)


def test_digests_against_sql(spark, larger):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = licenses.scan(larger("documents")).select("doc_id", "digest", "license_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(licenses.oracle_sql()).fetchall(), key=str)


def test_known_digests_may_be_any_table(spark):
    known = spark.createDataFrame([(licenses.digest_text("Be kind."), "kind"), (licenses.digest_text("be KIND"), "a-kind"), (None, "x")], "digest string, license_id string")
    assert [r.license_id for r in licenses.scan(frame(spark, [(1, "be, kind")]), known).collect()] == ["a-kind"]
