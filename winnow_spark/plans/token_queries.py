"""Queries on token accounting over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow_spark.functions.tokens import chunk_to_tokens, estimate_tokens, truncate_to_tokens, was_truncated
from winnow_spark.session import read_table


def sql_estimate(column: str = "text") -> str:
    """The estimate of a column in DuckDB's SQL."""
    return rf"""CASE WHEN coalesce(length({column}), 0) = 0 THEN 0 ELSE greatest(1, ceil(length({column}) / 4.0::DOUBLE
  + len(regexp_extract_all({column}, '[^A-Za-z0-9_\s]')) * 0.25::DOUBLE
  - len(regexp_extract_all({column}, '[ \t]{{2,}}')) * 0.1::DOUBLE)) END::BIGINT"""


SQL_ESTIMATE = sql_estimate()


def token_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum(estimate_tokens(F.col("text"))).alias("tokens")).orderBy("lang")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", estimate_tokens(F.col("text")).alias("tokens"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


def truncated_documents(spark: SparkSession, sf_dir: str, limit: int = 200) -> DataFrame:
    text = F.col("text")
    cut = read_table(spark, sf_dir, "documents").select("doc_id", was_truncated(text, limit).alias("truncated"), truncate_to_tokens(text, limit).alias("cut_text"))
    return cut.withColumn("cut_tokens", estimate_tokens(F.col("cut_text")))


def chunked_documents(spark: SparkSession, sf_dir: str, limit: int = 300) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(chunk_to_tokens(F.col("text"), limit)).alias("chunk_no", "chunk"))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chunk_chars"), estimate_tokens(F.col("chunk")).alias("chunk_tokens"))


QUERIES = {f.__name__: f for f in (token_totals_by_lang, token_estimate, truncated_documents, chunked_documents)}
ORACLES = {
    "token_totals_by_lang": f"SELECT lang, count(*) AS n_documents, sum({SQL_ESTIMATE})::BIGINT AS tokens FROM documents GROUP BY lang ORDER BY lang",
    "token_estimate": f"SELECT doc_id, {SQL_ESTIMATE} AS tokens, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents",
    "truncated_documents": f"""
WITH sized AS (SELECT doc_id, text, {SQL_ESTIMATE} > 200 AS truncated, substr(text, 1, 780) AS cut FROM documents),
marked AS (
  SELECT *, length(cut) - instr(reverse(cut), chr(10)) + 1 AS keep, instr(reverse(cut), chr(10)) AS from_end FROM sized),
shortened AS (
  SELECT doc_id, truncated, CASE WHEN NOT truncated THEN text
         ELSE (CASE WHEN from_end > 0 AND keep - 1 >= 624 THEN substr(cut, 1, keep) ELSE cut END) || chr(10) || '… [truncated]' END AS text
  FROM marked)
SELECT doc_id, truncated, text AS cut_text, {SQL_ESTIMATE} AS cut_tokens FROM shortened""",
    "chunked_documents": f"""
WITH RECURSIVE docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE coalesce(length(text), 0) > 0),
steps AS (
  SELECT doc_id, lines, 1 AS i, lines[1] AS held, 0 AS chunk_no, NULL::VARCHAR AS done FROM docs
  UNION ALL
  SELECT doc_id, lines, i + 1, CASE WHEN closes THEN lines[i + 1] ELSE joined END, chunk_no + closes::INT, CASE WHEN closes THEN held END
  FROM (SELECT *, {sql_estimate("joined")} > 300 AS closes FROM (SELECT *, held || chr(10) || lines[i + 1] AS joined FROM steps WHERE i < len(lines)))),
chunks AS (
  SELECT doc_id, chunk_no - 1 AS chunk_no, done AS chunk FROM steps WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, chunk_no, held FROM steps WHERE i = len(lines))
SELECT doc_id, chunk_no::BIGINT AS chunk_no, length(chunk)::BIGINT AS chunk_chars, {sql_estimate("chunk")} AS chunk_tokens FROM chunks""",
}
