"""Derived columns and summaries of recovered files (artifact_id, file_ord, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: characters per line above which a file counts as minified.
MINIFIED_LINE = 200
# Significant lines of a file that counts as a duplicate, and groups listed for an artifact.
LEAST_LINES, MOST_GROUPS = 10, 10
WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters, for `trim`.
WHITE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Trimmed lines without logic: blank, lone closers, comments, imports.
IDLE = r"\A(?:\z|(?:\{|\}|\};|\)|\);|\]|\];|else)\z|//|#|\*|/\*|(?:using|import|from|export|package|namespace)\x20)"


def shape(files: DataFrame) -> DataFrame:
    """Adds line_count and is_minified (integer division)."""
    length = F.length("content").cast("long")
    lines = length - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    return files.withColumn("line_count", lines.cast("long")).withColumn("is_minified", F.floor(length / F.col("line_count")) > MINIFIED_LINE)


def duplicates(files: DataFrame) -> DataFrame:
    """Raw contents that occur more than once in an artifact; hashed before the shuffle. DUP-001 is `identical`."""
    hashed = files.where("content <> ''").select("artifact_id", "file_ord", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))
    return hashed.groupBy("artifact_id", "content_sha256").agg(F.count("*").alias("n_files"), F.min("file_ord").alias("first_file")).where("n_files > 1")


def coverage(shaped: DataFrame) -> DataFrame:
    """Sums by artifact; the percentages are in `shares`."""
    chars = F.length("content").cast("long")
    return shaped.groupBy("artifact_id").agg(
        F.count("*").alias("n_files"), F.sum(chars).alias("n_chars"), F.sum("line_count").alias("n_lines"),
        F.sum(F.when(F.col("is_minified"), chars).otherwise(0)).alias("minified_chars"),
    )


def trimmed(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.trim(line, F.lit(WHITE_CHARS))


def significant(content: Column) -> Column:
    """The trimmed lines that carry logic."""
    return F.filter(F.transform(F.split(content, "\n", -1), trimmed), lambda x: ~x.rlike(IDLE))


def identical(files: DataFrame) -> DataFrame:
    """DUP-001: files of an artifact whose significant lines are equal, the largest groups first; `n_groups` counts all groups."""
    lines = files.select("artifact_id", "file_ord", significant(F.col("content")).alias("lines")).where(F.size("lines") >= LEAST_LINES)
    hashed = lines.select("artifact_id", "file_ord", F.sha2(F.array_join("lines", "\n").cast("binary"), 256).alias("significant_sha256"))
    groups = hashed.groupBy("artifact_id", "significant_sha256").agg(F.count("*").alias("n_files"), F.min("file_ord").alias("first_file")).where("n_files > 1")
    own = Window.partitionBy("artifact_id")
    order = own.orderBy(F.desc("n_files"), F.asc_nulls_last("first_file"), "significant_sha256")
    return groups.withColumns({"place": F.row_number().over(order).cast("long"), "n_groups": F.count("*").over(own)}).where(F.col("place") <= MOST_GROUPS)


def shares(shaped: DataFrame) -> DataFrame:
    """Percent of an artifact's characters that are minified, and of its files that could be read (`readable`); halves to even."""
    chars = F.length("content").cast("long")
    sums = shaped.groupBy("artifact_id").agg(
        F.sum(chars).alias("n"), F.sum(F.when(F.col("is_minified"), chars).otherwise(0)).alias("minified"),
        F.count("*").alias("considered"), F.sum(F.col("readable").cast("long")).alias("n_readable"),
    )
    percent = lambda part, whole: F.when(F.col(whole) == 0, 0).otherwise(F.bround(F.col(part) / F.col(whole) * 100)).cast("long")
    return sums.select("artifact_id", percent("minified", "n").alias("minified_share"), F.least(F.lit(100), F.greatest(F.lit(0), percent("n_readable", "considered"))).cast("long").alias("coverage_percent"))
