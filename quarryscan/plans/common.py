"""The driver's tables as the engine's inputs, on both sides of a comparison.

documents stands for recovered files: source is the artifact, doc_id the file. `findings` derives a finding from each document by
arithmetic on its id, so that scores, verdicts and splits have every combination to work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryscan.operators.rulebook import CAPABILITIES, CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, language: Column | None = None) -> DataFrame:
    """artifact_id, file_ord, path, content, language (CSharp unless a column of documents is given), is_decompiled."""
    docs = table(spark, sf_dir, "documents")
    stem = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{4,}", 0)
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "src/test/").otherwise("src/"), F.col("doc_id").cast("string"), F.lit("/"), stem, F.lit("."), F.coalesce("lang", F.lit("txt")))
    return docs.select(F.col("source").alias("artifact_id"), F.col("doc_id").alias("file_ord"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), (F.lit("CSharp") if language is None else language).alias("language"), F.lit(False).alias("is_decompiled"))


FILES = """(SELECT source AS artifact_id, doc_id AS file_ord, coalesce(source, 'none') || '/' || CASE WHEN doc_id % 3 = 0 THEN 'src/test/' ELSE 'src/' END || doc_id || '/' ||
  regexp_extract(coalesce(text, ''), '[A-Za-z]{4,}') || '.' || coalesce(lang, 'txt') AS path, coalesce(text, '') AS content FROM documents)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each document, with every mix of severities, categories, sources and flags."""
    i = F.col("file_ord")
    j = F.floor(i / 20)
    pick = lambda values, k, by=i: F.element_at(F.array(*[F.lit(v) for v in values]), (by % k + 1).cast("int"))
    return files(spark, sf_dir).select(
        "artifact_id", "file_ord", "path", F.concat(F.lit("VC-"), pick(("SEC", "CFG", "CODE", "MAL"), 4), F.lit("-00"), (i % 9 + 1).cast("string")).alias("rule_id"),
        F.concat(F.lit("Finding "), (i % 6).cast("string")).alias("title"), pick(CATEGORIES, 7).alias("category"), (i % 7).cast("int").alias("category_ord"),
        (F.floor(i / 3) % 5).cast("int").alias("severity"), (F.floor(i / 7) % 5).cast("int").alias("user_severity"), (j % 3 == 0).alias("is_blocking"), (j % 17 == 0).alias("is_capability"),
        F.when(j % 8 < 7, pick((*CAPABILITIES, "none"), 8, j)).alias("capability"), F.when(j % 11 == 0, "Assisted").otherwise("Rule").alias("source"), F.lit(None).cast("string").alias("explained_by"),
        (i % 9 + 1).cast("int").alias("line"), (i * 37 % 1000 + 1).cast("int").alias("col"), F.concat(F.lit("text "), i.cast("string")).alias("evidence"),
    )


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FINDINGS = f"""(SELECT artifact_id, file_ord, path, 'VC-' || (['SEC', 'CFG', 'CODE', 'MAL'])[file_ord % 4 + 1] || '-00' || (file_ord % 9 + 1) AS rule_id, 'Finding ' || (file_ord % 6) AS title,
  ({_list(CATEGORIES)})[file_ord % 7 + 1] AS category, (file_ord % 7)::INT AS category_ord, (file_ord // 3 % 5)::INT AS severity, (file_ord // 7 % 5)::INT AS user_severity,
  file_ord // 20 % 3 = 0 AS is_blocking, file_ord // 20 % 17 = 0 AS is_capability, CASE WHEN file_ord // 20 % 8 < 7 THEN ({_list(CAPABILITIES)})[file_ord // 20 % 8 + 1] END AS capability,
  CASE WHEN file_ord // 20 % 11 = 0 THEN 'Assisted' ELSE 'Rule' END AS source, (file_ord % 9 + 1)::INT AS line, (file_ord * 37 % 1000 + 1)::INT AS col, 'text ' || file_ord AS evidence FROM {FILES})"""


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact with a coverage between 0 and 99 from the number of its files and its name."""
    docs = files(spark, sf_dir)
    return docs.groupBy("artifact_id").agg(((F.sum("file_ord") + F.length(F.first("artifact_id"))) % 100).cast("int").alias("coverage_percent"))


ARTIFACTS = f"(SELECT artifact_id, ((sum(file_ord) + length(artifact_id)) % 100)::INT AS coverage_percent FROM {FILES} GROUP BY artifact_id)"


def purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated purpose for every artifact: the first capabilities, by Reader or Manifest."""
    n = F.length("artifact_id")
    return artifacts(spark, sf_dir).select("artifact_id", F.when(F.col("coverage_percent") % 2 == 0, "Reader").otherwise("Manifest").alias("stated_by"), F.slice(F.array(*[F.lit(c) for c in CAPABILITIES]), F.lit(1), (n % 5 + 1).cast("int")).alias("accounted"))


PURPOSE = f"(SELECT artifact_id, CASE WHEN coverage_percent % 2 = 0 THEN 'Reader' ELSE 'Manifest' END AS stated_by, ({_list(CAPABILITIES)})[1:(length(artifact_id) % 5 + 1)] AS accounted FROM {ARTIFACTS})"


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a DuckDB table expression."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({columns}))"
