"""Document fingerprints: a bottom-k sketch of the 5-word shingle hashes of a text.

The k smallest distinct hashes stand for the set. Sketches of parts merge into the sketch of the whole;
two sketches estimate resemblance and containment, one the number of distinct shingles (exactly up to k).
As text a sketch is base64 of its little-endian 64-bit hashes in rising order; the empty text's is empty.

Defined cases: null counts as empty; two empty sketches have resemblance 1, one empty sketch 0; texts of fewer than five words
are one shingle; rows without an id come last in the order of documents, ties are ordered by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shingle_set

K = 128
#: Ranges of ids whose neighbours are found apart: at least, rows of one, and at most.
RANGES, RANGE_ROWS, MOST_RANGES = 64, 50_000, 2048


def sketch(text: str | bytes | None, k: int = K) -> np.ndarray:
    data = (text or b"") if isinstance(text, (bytes, type(None))) else text.encode("utf-8", "surrogatepass")
    return shingle_set(data.split())[:k]


def merge(left: np.ndarray, right: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(left, right)[:k]


def resemblance(left: np.ndarray, right: np.ndarray, k: int = K) -> float:
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    both = merge(left, right, k)
    return len(np.intersect1d(np.intersect1d(left, right, True), both, True)) / len(both)


def distinct(one: np.ndarray, k: int = K) -> float:
    return float(len(one)) if len(one) < k else (k - 1) * 2.0**64 / float(one[k - 1])


def containment(left: np.ndarray, right: np.ndarray, k: int = K) -> float:
    """The share of the left set that the right one holds."""
    if not len(left):
        return 1.0
    r, both = resemblance(left, right, k), distinct(merge(left, right, k), k)
    return min(1.0, r * both / distinct(left, k))


def encoded(one: np.ndarray) -> str:
    return base64.b64encode(one.astype("<u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, and per range of ids (`range_`, falling ids) its documents in one run of rows, followed by a
    row with `real` false: the document after the range, around the end."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = min(MOST_RANGES, max(RANGES, docs.count() // RANGE_ROWS))
    cuts = sorted({int(c) for c in rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], min(0.002, 0.1 / ranges))}) if ranges > 1 else []
    # Range 0 has the largest ids; rows without an id come last.
    last = len(cuts) + 1
    bucket = F.lit(last)
    if cuts:
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        bucket = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.size(F.filter(edges, lambda e: e > F.col("doc_id"))))
    placed = rows.withColumn("range_", bucket.cast("int"))
    tops = [(r["range_"], r["top"]) for r in placed.groupBy("range_").agg(F.max("doc_id").alias("top")).orderBy("range_").collect()]  # a row per range
    before = {r: tops[i - 1][0] for i, (r, _) in enumerate(tops)}
    spark = docs.sparkSession
    heads = spark.createDataFrame([(r, top, before[r]) for r, top in tops], "range_ int, top bigint, goes int")
    first = (
        placed.join(F.broadcast(heads), "range_").where(F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("goes").agg(F.max("doc_id").alias("doc_id"), F.min("text").alias("text"))
        .select("doc_id", "text", F.col("goes").alias("range_"), F.lit(False).alias("real"))
    )
    return placed.withColumn("real", F.lit(True)).unionByName(first)


def neighbours(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of all texts, their edited texts and likenesses, in one shuffle of the texts."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next is still to come, within its range
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, range_, real in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = sketch(text, k)
                if held and held[0] == range_:
                    _, before_id, before, theirs = held
                    edited = _edited(before, text)
                    new = sketch(edited, k)
                    out.append((before_id, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(theirs), encoded(new), resemblance(theirs, new, k), resemblance(theirs, own, k), distinct(theirs, k)))
                held = (range_, doc_id, text, own) if real else None
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    placed = with_next(docs)
    order = [F.col("range_"), F.col("real").desc(), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return placed.repartition("range_").sortWithinPartitions(*order).mapInArrow(run, schema)
