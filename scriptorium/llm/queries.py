"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, html_text, langid, licenses, media, mixing, pieces, pii, repair, simhash, substrings

Query = Callable[[SparkSession, str], DataFrame]
#: Key of the surrogates in the queries over test tables. A production run passes a secret of its own.
PII_KEY = b"surrogates of the synthetic tables"


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents", "doc_id", "text"), PII_KEY)


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_format(chat.conversation_pairs(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents", "doc_id", "text"), texts=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.conversation_repair(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_read(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_read(spark, sf_dir, "documents", "doc_id", "text"), pieces.public_model())


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_simhash, op2_pii, op3_preference, op4_decontamination, op5_substrings, op6_mixing, op7_media, op8_language, op9_html, op10_licenses, op11_repair, op12_divergence, op13_sentencepiece]
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


_OP4 = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS run FROM (
    SELECT item, w[i:i + least(13, len(w)) - 1] AS x FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
  )
), g AS (
  SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM (
    SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n
  )
), h AS (
  SELECT id, i, n, item FROM g JOIN p USING (n, run)
), c AS (
  SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT id, i, n FROM h)) GROUP BY id
), t AS (
  SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN t USING (id)
"""

_OP5 = """
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT id, i, array_to_string(w[i:i + 34], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), r AS (
  SELECT id, i FROM g SEMI JOIN (SELECT run FROM g GROUP BY run HAVING count(*) > 1) USING (run)
), gone AS (
  SELECT id, list(DISTINCT pos) AS places FROM (SELECT id, unnest(range(i, i + 35)) AS pos FROM r) GROUP BY id
), k AS (
  SELECT d.id, list(w[pos] ORDER BY pos) AS kept FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS pos FROM d) d
  ANTI JOIN (SELECT id, unnest(places) AS pos FROM gone) x ON d.id = x.id AND d.pos = x.pos GROUP BY d.id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (id) LEFT JOIN k USING (id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute force in tests/llm."""
    sql = {"op3_preference": chat.oracle(), "op4_decontamination": _OP4, "op5_substrings": _OP5, "op6_mixing": mixing.SQL, "op11_repair": repair.SQL, "op12_divergence": divergence.SQL}
    import corpus_pipeline

    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
