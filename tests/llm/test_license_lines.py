import re
import textwrap

import pytest
from brute import frame

from tidemark.llm import licenses
from tidemark.llm.license_texts import TEXTS

ISC = """ISC License

Copyright (c) 2020, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + TEXTS["ISC"].split("\n\n")[-1]


def wrapped(text: str, width: int) -> str:
    """Paragraphs filled anew; notices keep a line of their own."""
    fill = lambda p: p if re.match(r"copyright \(c\)", p.lower()) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False)
    return "\n\n".join(fill(p) for p in text.split("\n\n"))


def test_usual_line_breaks_of_isc(spark):
    assert [r.license_id for r in licenses.scan(frame(spark, [(1, ISC)])).collect()] == ["ISC"]


@pytest.mark.parametrize("change", [str, str.upper, lambda t: " * " + t.replace("\n", "\n * ")])
def test_known_texts_wrapped_at_any_width(spark, change):
    rows = [(i, change(wrapped(t, w))) for w in (40, 60, 66, 70, 72, 76, 80, 100) for i, t in enumerate(TEXTS.values())]
    names = list(TEXTS)
    for r in licenses.scan(frame(spark, rows)).collect():
        assert r.license_id == names[r.doc_id]


@pytest.mark.parametrize("line", ["Copyright Joyent, Inc. and other Node contributors.", "Copyright: Someone", "copyright(c) 2020 X", "(c) 2020 X", "(c) John Doe", "Copyright The Authors", "© X", "# Copyright by A. B.", "Copyright <year> <holder>", "Copyright [yyyy] [name of copyright owner]"])
def test_notices_go(spark, line):
    assert [r.license_id for r in licenses.scan(frame(spark, [(1, f"MIT License\n{line}\n\n" + TEXTS["MIT-no-title"])])).collect()] == ["MIT"]
