"""Licence scans by canonical digest: whole texts are normalised, hashed and joined to known digests.

Normalising drops what differs between copies of one licence: letter case, notices of copyright (of one
line each; a sentence that a line break left with "copyright" at the front stays), the phrase "all rights
reserved", punctuation, white space and spellings that mean the same.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .license_digests import DIGESTS
from .license_texts import MORE_TEXTS, TEXTS

_MARKS = "“”„‘’‚«»–—‐‑−…©®™•· "
#: What the SQL of the round takes for a notice: any line that begins, after comment marks, with the word.
_SQL_NOTICE = r"(?:^|\n)[ \t\r#/*;!%>\-]*(?:copyright[ \t]|copyright:|\(c\)|©)[^\n]*"
#: Words that follow "copyright" or "(c)" where a line of prose happens to begin with it.
_PROSE = r"""(?!["'`“”‘’(]*(?:notices?|holders?|owners?|ownership|laws?|licen[cs]\w*|statements?|permissions?|interests?|disclaimers?|doctrines?|treat(?:y|ies)|acts?|protections?|infringements?|claims?|rights?|status|conditions?|terms|resulting|the(?:[ \t]+(?:software|library|program|work|licenses)|[ \t\r]*(?=\n))|and (?:related|similar|licen[cs]\w*|other|this|the|any)|or|of|in|on|to|for|if|is|are|as|that|which|who|under|with|may|does|shall|will|can|has|you|your|representations)\b)"""
#: A line that begins, after comment marks, with a notice of copyright: with a sign, a year or a placeholder, or a name and no prose.
_NOTICE = rf"(?:^|\n)[ \t\r#/*;!%>\-]*(?:copyright[ \t]*(?:[:©<\[{{\d]|\(c\))|copyright[ \t]+{_PROSE}(?=[^ \t\r\n])|\(c\)[ \t]*{_PROSE}(?=[^ \t\r\n])|©)[^\n]*"
_RESERVED = r"all rights reserved\.?"
_OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Both sides are whole words between spaces.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("copyright owner", "copyright holder"), ("https", "http"),
]


def canonical(text: Column) -> Column:
    t = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    t = F.regexp_replace(t, _NOTICE, "\n")
    t = F.regexp_replace(t, _RESERVED, " ")
    t = F.translate(t, _MARKS, " " * len(_MARKS))
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, _OTHER, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical_text(text: str) -> str:
    """The same for one text on the driver."""
    t = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    t = re.sub(_RESERVED, " ", re.sub(_NOTICE, "\n", t)).translate(str.maketrans(_MARKS, " " * len(_MARKS)))
    t = f" {re.sub(_OTHER, ' ', t).strip(' ')} "
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return t.strip(" ")


def digest_text(text: str) -> str:
    return hashlib.md5(canonical_text(text).encode()).hexdigest()


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id) of known licence texts; of texts of one digest the first id by name. Without ``texts`` those of TEXTS, MORE_TEXTS and DIGESTS."""
    by: dict[str, str] = {}
    for name, text in sorted((TEXTS if texts is None else texts).items()):
        if canonical_text(text):
            by.setdefault(digest_text(text), name)
    if texts is None:
        for (name, _), text in MORE_TEXTS.items():
            by.setdefault(digest_text(text), name)
        by = DIGESTS | by
    return spark.createDataFrame(sorted(by.items()), "digest string, license_id string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id) for each row of ``docs`` (doc_id, text); license_id is null if the whole text is no known licence.

    A null text has a null digest; a text of which nothing remains has the digest of nothing and is no licence.
    Rows may repeat. ``known`` (digest, license_id) may be of any size: Spark broadcasts it only below its threshold.
    """
    known = known_licenses(docs.sparkSession) if known is None else pick(known, "digest", "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    cols = pick(docs, "doc_id", "text")
    return cols.select("doc_id", F.md5(canonical(F.col("text")).cast("binary")).alias("digest")).join(known, "digest", "left").select("doc_id", "digest", "license_id")


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    t = f"translate(text, {_sql(string.ascii_uppercase)}, {_sql(string.ascii_lowercase)})"
    t = f"regexp_replace({t}, {_sql(_SQL_NOTICE)}, chr(10), 'g')"
    t = f"regexp_replace({t}, {_sql(_RESERVED)}, ' ', 'g')"
    t = f"translate({t}, {_sql(_MARKS)}, {_sql(' ' * len(_MARKS))})"
    t = f"' ' || trim(regexp_replace({t}, {_sql(_OTHER)}, ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, {_sql(f' {a} ')}, {_sql(f' {b} ')})"
    by: dict[str, str] = {}
    for name, text in sorted(TEXTS.items()):
        by.setdefault(digest_text(text), name)
    rows = ", ".join(f"({_sql(d)}, {_sql(n)})" for d, n in sorted(by.items()))
    return f"with d as (select doc_id, md5(trim({t}, ' ')) as digest from documents), k(digest, license_id) as (values {rows}) select d.doc_id, d.digest, k.license_id from d left join k on d.digest = k.digest"
