"""Shared pieces of the corpus operators: scratch tables, word hashing, batch access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every contract, as a regular-expression class and as bytes.split() takes them.
WORD_SEP = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch: texts reach megabytes, so the default of 10,000 rows is too much for a worker.
BATCH_ROWS = 1000
#: Entries packed into one row, and partitions that packed parts are dealt to at most (a task takes its parts one by one).
PACKED, PARTITIONS = 1024, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name as it is, with dots and quotes in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns; nulls count, and maps (which have no hash) by their JSON."""
    parts = [F.to_json(F.struct(named(f.name))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else named(f.name) for f in rows.schema.fields]
    return F.xxhash64(*[x for c, p in zip(rows.columns, parts) for x in (named(c).isNull(), p)])


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Without one, a temporary folder in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    base = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Intermediate tables in the shared checkpoint folder; they cut lineage and outlive executors.

    A table is deleted by `drop`, or by `keep`, which deletes all but the ones named.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{_shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: dict[str, DataFrame] = {}

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.live[path] = out
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
            self.live.pop(df._scratch_path, None)

    def keep(self, *frames: DataFrame) -> None:
        """Delete every table but these."""
        kept = {df._scratch_path for df in frames}
        self.drop(*[df for path, df in self.live.items() if path not in kept])


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id's decimal text, modulo 5, is 0. Rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def byte_slices(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    at = ends.tolist()
    for i in range(len(column)):
        yield b"" if valid is not None and not valid[i] else view[at[i] : at[i + 1]].tobytes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _MUL
    x ^= x >> _S
    x += right
    x *= _MUL2
    x ^= x >> _S
    return x


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive items, by doubling; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, level, width, at = None, hashes, 1, 0
    left = size
    while left:
        if left & 1:
            part = level[at : at + n]
            out = part if out is None else _mix(out, part)
            at += width
        left >>= 1
        if left:
            level = _mix(level[: len(level) - width], level[width:])
            width *= 2
    return out


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of `size`-word shingles; a shorter text is one shingle, a text without words none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(size, len(words))))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    if not len(keys[0]):
        return np.empty(0, bool)
    changed = np.zeros(len(keys[0]) - 1, bool)
    for x in keys:
        changed |= x[1:] != x[:-1]
    return np.append(True, changed)


def packed_rows(p: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows (part, bytes of each column), at most `PACKED` entries each: few rows to shuffle, and small Arrow batches."""
    order = np.argsort(p, kind="stable")
    p, columns = p[order], [c[order] for c in columns]
    at = np.flatnonzero(runs(p))
    ends = np.append(at[1:], len(p))
    return [(int(p[i]), *(c[x : min(x + PACKED, j)].tobytes() for c in columns)) for i, j in zip(at.tolist(), ends.tolist()) for x in range(i, j, PACKED)]


def grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[bytes]]]:
    """Each part's packed columns, from rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(width + 1))):
            if row[0] != part and held:
                yield part, [b"".join(c) for c in zip(*held)]
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield part, [b"".join(c) for c in zip(*held)]
