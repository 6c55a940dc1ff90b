"""The ten queries and their SQL; each query is a thin use of its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, lang_id, near_dup, packing, quality, substring_dedup, token_count, topk
from ._common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.digest(lang_id.fit_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op3_topk_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, is_query=F.col("vec_id") % 50 == 0)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat_format.digest(chat_format.format_chats(turns.unionByName(planted)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; the path level within a host is its language section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))
    return found.select("doc_id", "p_quality", "p_toxic", "keep", "quality_rate", "toxic_rate")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_extract": op2_html_extract,
    "op3_topk_ball_tree": op3_topk_ball_tree,
    "op4_chat_format": op4_chat_format,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash_near_dup": op6_minhash_near_dup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_bayes": op8_quality_bayes,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_count": op10_token_count,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk_ball_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), least AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT p.doc_id, i FROM p JOIN least USING (win) WHERE p.doc_id > first
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit
), gone_by AS (SELECT doc_id, count(*) AS n, list(i) AS at FROM gone GROUP BY doc_id
), one AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS kept
  FROM one ANTI JOIN gone ON gone.doc_id = one.doc_id AND gone.i = one.i GROUP BY one.doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone_by ON gone_by.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
""",
    "op7_decontaminate": r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), sized AS (SELECT item_id, words, least(13, len(words)) AS n FROM items WHERE len(words) > 0
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sized)
), sizes AS (SELECT DISTINCT n FROM wins
), spots AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM lowered JOIN sizes ON len(words) >= n)
), hits AS (SELECT doc_id, spots.n, i, item_id FROM spots JOIN wins ON wins.n = spots.n AND wins.win = spots.win
), hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT lowered.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM lowered LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(replace(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D')) + 1
      + length(regexp_replace(text, '<(\\*)(/?(?:turn|part)\b)', '<\\\1\2', 'g')) + 8)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens,
  sum(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]')))::BIGINT AS text_tokens
FROM t GROUP BY conv_id
""",
}
