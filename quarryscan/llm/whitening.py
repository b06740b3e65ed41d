"""Embedding whitening by a tiled covariance.

Entries become whole numbers x. Dimensions are cut into column blocks of `TILE`, rows into row-blocks. Column blocks are shuffled by row-block; each pair
(i, j), i <= j, of the blocks of a row-block is a tile key, whose product is summed in the task and then per tile on the cluster. The
tiles are assembled on the driver (dimensions squared, whatever the number of rows) and eigendecomposed there.

Precision: a dimension is centred by the whole number next to its mean before anything is multiplied, so products and sums are small whole numbers and exact;
what the centre misses (at most a half) is taken off in whole numbers too. The covariance is thus the exact one, rounded once to double, and
doesn't depend on the order of rows or tasks. The covariance of the whitened rows goes through the same tiles, centred by their means.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry, or has another length than most, are dropped; an id may be null, and
repeated rows all count and all come out; ties between eigenvalues leave the choice of their components open; components without variance (eigenvalue under
rounding) have whitened null and explained as computed, and the identity leaves them out; fewer dimensions than `COMPONENTS` give fewer rows;
an empty table gives no rows; a deviation beyond 64 bits is null. Of clashing columns only `vec_id` and `embedding` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import blobs, matrix, taking_part, unblob

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Dimensions of a column block, and rows of a row-block.
TILE, BLOCK = 32, 4096
_EXACT = float(1 << 53)

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, column: str, length: int, whole: bool) -> list:
    """The sum of each entry over all rows; of whole numbers x where `whole`, exactly."""
    kind = "long" if whole else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64 if whole else np.float64)
        for batch in batches:
            values = matrix(batch.column(0), length)
            total += (quantised(values) if whole else values).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], ["d", "s"])

    found = rows.select(column).mapInArrow(run, f"d long, s {kind}").groupBy("d").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    out = [0] * length
    for r in found:
        out[r["d"]] = r["s"]
    return out


def _column_blocks(rows: DataFrame, column: str, length: int, centre: np.ndarray, whole: bool) -> DataFrame:
    """rb (row-block), cb (column block), data (its centred entries, rows by dimensions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            values = matrix(batch.column(0), length)
            values = (quantised(values) if whole else values) - centre
            for a in range(0, len(values), BLOCK):
                part = values[a : a + BLOCK]
                data = [np.ascontiguousarray(part[:, c : c + TILE]).tobytes() for c in range(0, length, TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(data)), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], ["rb", "cb", "data"])
                at += 1

    return rows.select(column).mapInArrow(run, "rb long, cb int, data binary")


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left.T @ right; of whole numbers exactly, by way of doubles as long as no sum can leave their whole numbers."""
    if left.dtype == np.float64:
        return left.T @ right
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * len(left)
    return (left.T.astype(np.float64) @ right.astype(np.float64)).astype(np.int64) if most < _EXACT else left.T @ right


def _tile_sums(blocks: DataFrame, length: int, whole: bool) -> np.ndarray:
    """length x length: sums of products over all rows, from stored column blocks. Whole numbers come as Python's."""
    kind, dtype = ("long", np.int64) if whole else ("double", np.float64)
    wide = lambda c: min(TILE, length - c * TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(k).to_pylist() for k in ("i", "j", "x", "y"))):
                p = product(np.frombuffer(x, dtype).reshape(-1, wide(i)), np.frombuffer(y, dtype).reshape(-1, wide(j)))
                tiles[i, j] = tiles[i, j] + p if (i, j) in tiles else p
        for (i, j), p in tiles.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p.size, i, np.int32)), pa.array(np.full(p.size, j, np.int32)), pa.array(np.arange(p.size, dtype=np.int32)), pa.array(p.ravel())], ["i", "j", "k", "s"])

    left, right = blocks.select("rb", F.col("cb").alias("i"), F.col("data").alias("x")), blocks.select("rb", F.col("cb").alias("j"), F.col("data").alias("y"))
    tiled = left.join(right, "rb").where("i <= j").select("i", "j", "x", "y").mapInArrow(run, f"i int, j int, k int, s {kind}")
    out = np.zeros((length, length), object if whole else np.float64)
    for r in tiled.groupBy("i", "j", "k").agg(F.sum("s").alias("s")).toLocalIterator():  # at most dimensions squared
        d, e = r["i"] * TILE + r["k"] // wide(r["j"]), r["j"] * TILE + r["k"] % wide(r["j"])
        out[d, e] = out[e, d] = r["s"]
    return out


def covariance(products: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """The covariance, from sums of products about whole centres and the sums that are left about these."""
    return np.array([[(n * int(products[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(len(rest))] for i in range(len(rest))], np.float64)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and component: see the contract's columns in SCHEMA."""
    spark = embeddings.sparkSession
    rows, n, length = taking_part(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    if not n:
        return spark.createDataFrame([], SCHEMA)
    scratch = Scratch(spark, "whitening")
    sums = _sums(rows, "embedding", length, True)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    blocks = scratch.write(_column_blocks(rows, "embedding", length, np.array(centre, np.int64), True), "blocks")
    v = covariance(_tile_sums(blocks, length, True), rest, n)
    scratch.drop(blocks)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(v))
    sound = values > trace * length * np.finfo(float).eps
    scale = np.where(sound, vectors / np.sqrt(np.where(sound, values, 1.0)), 0.0)
    k = len(values)
    middle, left_over, offset = np.array(centre, np.int64), rest, np.array([r / n for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = quantised(matrix(batch.column(1), length)) - middle
            most = n * (int(np.abs(y).max(initial=0)) + 1)
            if length * most * most < 1 << 63:
                deviation = ((n * y - np.array(left_over, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                whole = [sum((n * int(a) - b) ** 2 for a, b in zip(row, left_over)) for row in y]
                deviation = [d if d < 1 << 63 else None for d in whole]
            w = ((y - offset) @ scale).ravel()
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, k, dtype=np.int32)), pa.array(w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), out], ["vec_id", "deviation", "w"])

    whitened = scratch.write(rows.select("vec_id", "embedding").mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    means = np.array(_sums(whitened, "w", k, False)) / n
    blocks = scratch.write(_column_blocks(whitened, "w", k, means, False), "blocks")
    error = np.abs(_tile_sums(blocks, k, False) / n - np.eye(k))[np.ix_(sound, sound)].max(initial=0.0)
    scratch.drop(blocks)
    explained = F.array(*[F.lit(float(x / trace) if trace else 0.0) for x in values])
    known = F.array(*[F.lit(bool(x)) for x in sound])
    each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(known[F.col("at")], F.col("whitened")).alias("whitened"),
        explained[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
