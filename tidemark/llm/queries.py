"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspolytope, langid, licenses, minhash, mixing, postings, preference, spm, tokenbin, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return spm.digests(_table(spark, sf_dir, "documents"))


def op4_source_mix(spark, sf_dir):
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("repeats")


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_vector_duplicates(spark, sf_dir):
    return crosspolytope.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op8_preference_format(spark, sf_dir):
    return preference.digests(preference.format_sides(preference.swapped_ends(_table(spark, sf_dir, "conversations"))))


def op9_nearest_neighbours(spark, sf_dir):
    return postings.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_token_files(spark, sf_dir):
    return tokenbin.round_trip(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_sentencepiece, op4_source_mix, op5_toxicity, op6_near_duplicates, op7_vector_duplicates, op8_preference_format, op9_nearest_neighbours, op10_token_files)}

#: Learned models, tokenizers and approximate search can't be stated in SQL; tests hold them against brute force, exact round trips or held-out accuracy.
ORACLES = {
    "op2_license_scan": licenses.oracle_sql(), "op4_source_mix": mixing.ORACLE_SQL, "op6_near_duplicates": minhash.ORACLE_SQL, "op7_vector_duplicates": crosspolytope.ORACLE_SQL,
    "op8_preference_format": preference.ORACLE_SQL,
}
