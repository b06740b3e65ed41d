"""Shared pieces of the operators over embeddings: rows that take part, blocks of vectors as numpy arrays.

A vector takes part when it is not null, not empty and has no null or non-finite entry. Vectors of another length than most have cannot meet the
others, and take no part either (of lengths equally frequent the longer counts).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taking_part(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """The rows whose vector takes part, as array<double>; their number; the length of their vectors (0 without rows)."""
    sound = rows.withColumn(vector, F.col(vector).cast("array<double>")).where(F.size(vector) > 0)
    sound = sound.where(~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = sound.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if most is None:
        return sound, 0, 0
    return sound.where(F.size(vector) == most["length"]), most["count"], most["length"]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of an array<double> column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def blobs(values: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.dtype.itemsize * values.shape[1]), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unblob(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of equally long binary values."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)
