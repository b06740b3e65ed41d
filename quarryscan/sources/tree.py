"""A data source for folders of files, hidden ones included, and text decoding.

`spark.dataSource.register(SourceTree)`, then `spark.read.format("sourcetree").option("path", …).load()`. The built-in binary
source leaves out paths that begin with a point or an underscore, which a scan has to see. The folder must be readable by
the driver (names) and by executors (contents), as on a shared mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryscan.functions import paths as P
from quarryscan.operators import scans

# Files, bytes of a file and bytes of all files that are read.
MOST_FILES, MOST_BYTES, MOST_TOTAL = 20_000, 8 << 20, 256 << 20
#: Files read by one task.
TOGETHER = 200


class Part(InputPartition):
    def __init__(self, rows: list[tuple[int, str, int]]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.name = options.get("artifact", os.path.basename(os.path.normpath(self.root)))
        self.contents = options.get("contents", "true").lower() == "true"

    def partitions(self) -> list[Part]:
        found: list[str] = []
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if not os.path.islink(os.path.join(folder, d)))
            found += [os.path.join(folder, n) for n in sorted(names) if not os.path.islink(os.path.join(folder, n))]
        rows = [(i, os.path.relpath(p, self.root).replace(os.sep, "/"), os.path.getsize(p)) for i, p in enumerate(found[:MOST_FILES])]
        return [Part(rows[i : i + TOGETHER]) for i in range(0, len(rows), TOGETHER)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for i, path, size in partition.rows:
            data = None
            if self.contents and size <= MOST_BYTES:
                with open(os.path.join(self.root, path), "rb") as f:
                    data = f.read()
            yield self.name, i, path, size, data


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "artifact_id string, file_ord int, path string, bytes bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def decoded(data: Column) -> Column:
    """Text of bytes: UTF-16 or UTF-8 by byte order mark, else UTF-8 with replacement; null for binary (a NUL in the first 8,000 bytes)."""
    head = F.hex(F.substring(data, 1, 3))
    body = lambda n: F.substring(data, n + 1, 2_147_483_647)
    utf8 = lambda x: F.make_valid_utf8(x.cast("string"))
    binary = F.hex(F.substring(data, 1, 8000)).rlike(r"\A(?:..)*?00")
    return (
        F.when(data.isNull(), F.lit(None).cast("string"))
        .when(head.startswith("EFBBBF"), utf8(body(3)))
        .when(head.startswith("FFFE"), F.decode(body(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(body(2), "UTF-16BE"))
        .when(binary, F.lit(None).cast("string"))
        .otherwise(utf8(data))
    )


def candidates(listing: DataFrame) -> DataFrame:
    """Files worth reading, up to the budget of bytes in file order."""
    some = listing.where(P.is_candidate(F.col("path")) & (F.col("bytes") <= MOST_BYTES))
    return scans.within_budget(some, ["artifact_id"], "file_ord", F.col("bytes"), MOST_TOTAL, whole=True)


def recovered(listing: DataFrame) -> DataFrame:
    """files of the engine: artifact_id, file_ord, path, content, language, is_decompiled, for candidates that are text."""
    rows = candidates(listing).select("artifact_id", "file_ord", "path", decoded(F.col("data")).alias("content"), P.language_of(F.col("path")).alias("language"), F.lit(False).alias("is_decompiled"))
    return rows.where("content is not null")


def file_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def folder_hash(listing: DataFrame) -> DataFrame:
    """SHA-256 of the sorted manifest of relative paths and sizes, a line each."""
    line = F.concat("path", F.lit("|"), F.col("bytes").cast("string"), F.lit("\n"))
    return listing.groupBy("artifact_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "").cast("binary"), 256).alias("sha256"), F.sum("bytes").alias("bytes"))
