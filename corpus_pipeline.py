"""A training corpus from raw documents: five stages, each a Parquet table for the next.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of documents.  A stage judges all that the one before kept.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontam, langid, mixing, near_copies, pii
from scriptorium.llm.common import table_written
from scriptorium.llm.queries import PII_KEY

#: Near copies: shingles of five words, and a Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, Fraction(4, 5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without a letter go."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, once. Rows without doc_id take part."""
    return near_copies.one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in one word of 20 or more."""
    return decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the text."""
    out = pii.with_surrogates(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("mixing", mixture),
]

#: SQL has neither the classifier nor the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table_written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
