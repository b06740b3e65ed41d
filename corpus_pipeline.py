"""Corpus pipeline: quality rules, near-duplicate removal, redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Near duplicates are found by row, not by id; rows equal in
every column count once. Null texts are empty documents, of which the quality rules keep none; empty tables stay empty; further
columns, of any type and name, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryscan.llm import mixing, ngram_join, packing, pii, quality_rules
from quarryscan.llm.common import Scratch, named, row_hash, table

#: Packing and the Jaccard join are not expressible in SQL; tests hold run() and near-duplicate removal against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the smallest id stays, then the smallest hash of the text; rows without an id come last."""
    keyed = docs.select(F.struct("*").alias("_row"), row_hash(docs).alias("_key"), F.col("doc_id"), F.col("text"))
    found = ngram_join.join(keyed.select(F.col("_key").alias("doc_id"), "text")).groupBy(F.col("doc_id").alias("_key")).agg(F.min("component_id").alias("component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "_key")
    stays = keyed.select("_key", order.alias("_order")).distinct().join(found, "_key").groupBy("component_id").agg(F.min("_order").alias("_first")).select(F.col("_first._key").alias("_key"))
    return keyed.join(stays, "_key").dropDuplicates(["_key"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(named, docs.columns)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("source"), F.col("text"))
    mixed = mixing.documents_mix(packed)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    again = mixed.where(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_time"))
    return again.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
