"""Registry of the engine's named queries and their DuckDB equivalents.

The driver's documents table stands for recovered files: source is the artifact, a document a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryscan.operators import files as O

from . import finding_queries, fixture_queries, scan_queries, search_queries, text_queries


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("artifact_id"), F.col("doc_id").alias("file_ord"), F.coalesce("text", F.lit("")).alias("content"))


def file_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line count and minification of every file."""
    return O.shape(_files(spark, sf_dir)).select("file_ord", "line_count", "is_minified")


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of equal raw content within an artifact."""
    return O.duplicates(_files(spark, sf_dir))


def coverage_by_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coverage(O.shape(_files(spark, sf_dir)))


def identical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an artifact that are equal in their significant lines (DUP-001)."""
    return O.identical(_files(spark, sf_dir))


def artifact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minified share and coverage of every artifact in percent; a null text is a file that could not be read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.col("source").alias("artifact_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("text").isNotNull().alias("readable"))
    return O.shares(O.shape(files))


QUERIES: dict = {
    "file_shape": file_shape,
    "duplicate_files": duplicate_files,
    "coverage_by_artifact": coverage_by_artifact,
    "identical_files": identical_files,
    "artifact_shares": artifact_shares,
}
_SHAPE = """SELECT coalesce(source, NULL) AS artifact_id, doc_id AS file_ord, coalesce(text, '') AS content,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS line_count FROM documents"""
_SHAPE = f"SELECT *, length(content) // line_count > {O.MINIFIED_LINE} AS is_minified FROM ({_SHAPE})"
ORACLE_SQL: dict[str, str] = {
    "file_shape": f"SELECT file_ord, line_count, is_minified FROM ({_SHAPE})",
    "duplicate_files": """SELECT source AS artifact_id, sha256(text) AS content_sha256, count(*)::BIGINT AS n_files, min(doc_id) AS first_file
  FROM documents WHERE text <> '' GROUP BY 1, 2 HAVING count(*) > 1""",
    "coverage_by_artifact": f"""SELECT artifact_id, count(*)::BIGINT AS n_files, sum(length(content))::BIGINT AS n_chars, sum(line_count)::BIGINT AS n_lines,
  sum(CASE WHEN is_minified THEN length(content) ELSE 0 END)::BIGINT AS minified_chars FROM ({_SHAPE}) GROUP BY 1""",
    "identical_files": f"""WITH f AS (SELECT source AS artifact_id, doc_id AS file_ord, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_replace(x, '\\A{O.WHITE}+|{O.WHITE}+\\z', '', 'g')), lambda x: NOT regexp_matches(x, '{O.IDLE}')) AS lines FROM documents),
  g AS (SELECT artifact_id, sha256(array_to_string(lines, chr(10))) AS significant_sha256, count(*)::BIGINT AS n_files, min(file_ord) AS first_file
    FROM f WHERE len(lines) >= {O.LEAST_LINES} GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY n_files DESC, first_file ASC NULLS LAST, significant_sha256)::BIGINT AS place,
    count(*) OVER (PARTITION BY artifact_id)::BIGINT AS n_groups FROM g QUALIFY place <= {O.MOST_GROUPS}""",
    "artifact_shares": f"""SELECT artifact_id, CASE WHEN n = 0 THEN 0 ELSE round_even(minified / n * 100, 0) END::BIGINT AS minified_share,
  CASE WHEN considered = 0 THEN 0 ELSE least(100, greatest(0, round_even(readable / considered * 100, 0))) END::BIGINT AS coverage_percent
  FROM (SELECT source AS artifact_id, sum(len)::BIGINT AS n, sum(CASE WHEN len // (len - length(replace(t, chr(10), '')) + 1) > {O.MINIFIED_LINE} THEN len ELSE 0 END)::BIGINT AS minified,
    count(*) AS considered, count(text) AS readable FROM (SELECT *, coalesce(text, '') AS t, length(coalesce(text, '')) AS len FROM documents) GROUP BY 1)""",
}
for _part in (text_queries, finding_queries, fixture_queries, scan_queries, search_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
FLAGSHIP = "scan_scores"
