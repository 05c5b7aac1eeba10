from pathlib import Path

import pytest
from brute import frame

from tidemark.llm import licenses
from tidemark.llm.license_texts import TEXTS

COMMON = Path("/usr/share/common-licenses")
FULL = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def ids(spark, texts):
    got = {r.doc_id: r.license_id for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.skipif(not COMMON.is_dir(), reason="no common licences on this machine")
def test_full_licences(spark):
    names = [n for n in FULL if (COMMON / n).is_file()]
    texts = [(COMMON / n).read_text("utf-8") for n in names]
    assert ids(spark, texts) == [FULL[n] for n in names]
    assert ids(spark, [t + "\nand more" for t in texts]) == [None] * len(texts)


def test_notices_and_titles(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + TEXTS["MIT-no-title"], "Copyright (c) 2020 X\n\n" + TEXTS["ISC"].removeprefix("ISC License\n\n"), TEXTS["MIT"]]
    assert ids(spark, texts) == ["notice-Apache-2.0", "MIT", "ISC", "MIT"]
