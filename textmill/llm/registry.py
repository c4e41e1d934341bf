"""Queries of the training-data operators, each over its whole tables, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import bpe, chat_format, decontaminate, exact_dedup, html_style_tree, license_scan, line_dedup, simhash, suffix_dedup, toxicity
from textmill.llm.common import WORD_CLASS, ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_html_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_style_tree.extract(_table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


_ALL = (
    op1_toxicity,
    op2_html_style_tree,
    op3_byte_bpe,
    op4_license_scan,
    op5_suffix_dedup,
    op6_simhash,
    op7_line_dedup,
    op8_exact_dedup,
    op9_decontamination,
    op10_chat_format,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

EXACT_SQL = """
SELECT doc_id, kept_doc_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place
  FROM documents WHERE text IS NOT NULL)
WHERE place > 1"""

LEAKS_SQL = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '{WORD_CLASS}+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(lower(text), '{WORD_CLASS}+') FROM benchmark),
items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS n,
         array_to_string(w[i:i + 12], ' ') AS passage
  FROM words, unnest(range(1, greatest(2, len(w) - 11))) AS t(i)
  WHERE side = 'b' AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (
  SELECT DISTINCT id AS doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM words, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS t(i)
  WHERE side = 'd' AND len(w) >= n)
SELECT doc_id, item_id, count(DISTINCT passage) AS n_passages
FROM grams JOIN items USING (n, passage) GROUP BY doc_id, item_id"""

SPANS_SQL = r"""
WITH lists AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\t\n\x0B\f\r\x1C-\x1F ]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 49], ' ') AS passage
  FROM lists, unnest(range(1, greatest(1, len(w) - 48))) AS t(i) WHERE len(w) >= 50),
shared AS (SELECT passage FROM grams GROUP BY passage HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT DISTINCT doc_id, pos FROM grams JOIN shared USING (passage)),
begun AS (SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, true) AS new FROM marked),
islands AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM begun)
SELECT doc_id, min(pos)::INTEGER AS start_word, (max(pos) + 50)::INTEGER AS end_word, (max(pos) + 50 - min(pos))::INTEGER AS n_words
FROM islands GROUP BY doc_id, island"""

CHATS_SQL = """
SELECT conv_id, string_agg(turn_text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text,
       count(*) AS n_turns, sum(strlen(turn_text))::BIGINT AS n_bytes
FROM (SELECT *, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS turn_text
      FROM conversations WHERE conv_id IS NOT NULL)
GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": license_scan.oracle_sql(),
    "op5_suffix_dedup": SPANS_SQL,
    "op10_chat_format": CHATS_SQL,
    "op8_exact_dedup": EXACT_SQL,
    "op9_decontamination": LEAKS_SQL,
}
