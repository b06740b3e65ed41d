"""Repetition inside an artifact: equal files, repeated blocks and commented-out code.

Only files written by hand in a programming language count (`eligible`). Lines are compared without white space at their ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import files as shapes

# Lines of a block, lines of a commented run, groups listed, lines an artifact's windows may cover.
BLOCK, RUN, MOST_GROUPS, BUDGET = 8, 6, 10, 400_000
LANGUAGES = ("CSharp", "JavaScript", "TypeScript", "Python", "Java")
#: A comment line that reads like code: a statement's end, a call, an assignment or a block.
_CODE_COMMENT = r"\A(?://|#|\*)\s*(?:[^\s].*(?:;|\{|\}|\)\s*:?)\s*\z|(?:if|for|while|return|var|let|const|def|class|import|public|private)\b.*[=(;{:]|[\w.\[\]]+\s*[-+*/]?=[^=].*)"


def eligible(files: DataFrame) -> DataFrame:
    return files.where(~F.coalesce("is_decompiled", F.lit(False)) & F.col("language").isin(*LANGUAGES))


def significant_lines(files: DataFrame) -> DataFrame:
    """artifact_id, file_ord, path, line_no (1-based), text: trimmed lines that carry logic."""
    rows = F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), shapes.trimmed(x).alias("text")))
    return files.select("artifact_id", "file_ord", "path", F.explode(F.filter(rows, lambda x: ~x["text"].rlike(shapes.IDLE))).alias("l")).select("artifact_id", "file_ord", "path", "l.*")


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """artifact_id, file_ord, path, line_no, block_sha256: every window of `size` significant lines of a file.

    Windows slide over the file's own array of lines, so that no line is shuffled.
    """
    rows = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), shapes.trimmed(x).alias("text"))), lambda x: ~x["text"].rlike(shapes.IDLE))
    held = files.select("artifact_id", "file_ord", "path", rows.alias("ls")).where(F.size("ls") >= size)
    window = lambda i: F.array_join(F.transform(F.slice("ls", i, size), lambda x: x["text"]), "\n")
    made = F.transform(F.sequence(F.lit(1), F.size("ls") - size + 1), lambda i: F.struct(F.get("ls", i - 1)["line_no"].alias("line_no"), F.sha2(window(i).cast("binary"), 256).alias("block_sha256")))
    return held.select("artifact_id", "file_ord", "path", F.explode(made).alias("b")).select("artifact_id", "file_ord", "path", "b.*")


def within_budget(files: DataFrame, most: int = BUDGET) -> DataFrame:
    """Files in order until an artifact's lines pass the budget; files in one place count together at the end.

    Only places and numbers of lines are ordered; texts stay where they are and meet the last place of their artifact.
    """
    n = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("artifact_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("artifact_id", "file_ord", F.coalesce(n, F.lit(0)).alias("_n")).withColumn("_before", before)
    ends = placed.groupBy(F.col("artifact_id").alias("_a")).agg(F.max(F.when(F.col("_before") < most, F.col("file_ord"))).alias("_last"), F.max("_before").alias("_all"))
    over = F.broadcast(ends.where(F.col("_all") >= most).select("_a", "_last", F.lit(True).alias("_over")))  # at most a row for so many lines as the budget has
    joined = files.join(over, F.col("artifact_id").eqNullSafe(F.col("_a")), "left")
    return joined.where(F.col("_over").isNull() | F.col("file_ord").isNull() | (F.col("file_ord") <= F.col("_last"))).select(*files.columns)


def block_groups(made: DataFrame) -> DataFrame:
    """artifact_id, block_sha256, n_occurrences, n_files, first_file, first_line, set_a, set_b: blocks that occur more than once.

    set_a, set_b and n_files tell sets of files apart: exclusive ors of two hashes of each file, which merge part by part, so that no list of files is
    made. A block in very many files is first counted in each of them, then summed.
    """
    in_file = made.groupBy("artifact_id", "block_sha256", "file_ord").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    sign = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "file_ord"))
    rows = in_file.groupBy("artifact_id", "block_sha256").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_files"), F.min(F.struct("file_ord", "line_no")).alias("p"), sign(1).alias("set_a"), sign(2).alias("set_b"))
    return rows.where("n_occurrences > 1").select("artifact_id", "block_sha256", "n_occurrences", "n_files", F.col("p.file_ord").alias("first_file"), F.col("p.line_no").alias("first_line"), "set_a", "set_b")


def repeated_blocks(files: DataFrame) -> DataFrame:
    """DUP-002: per artifact one block for each set of files (the one with most occurrences), the ten largest groups."""
    groups = block_groups(blocks(within_budget(files)))
    of_set = Window.partitionBy("artifact_id", "n_files", "set_a", "set_b").orderBy(F.desc("n_occurrences"), "first_file", "first_line", "block_sha256")
    one = groups.withColumn("_n", F.row_number().over(of_set)).where("_n = 1").drop("_n")
    order = Window.partitionBy("artifact_id").orderBy(F.desc("n_occurrences"), "first_file", "first_line", "block_sha256")
    return one.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= MOST_GROUPS)


def commented_runs(files: DataFrame, least: int = RUN) -> DataFrame:
    """DUP-003: runs of at least `least` comment lines in a row that read like code; the ten longest of an artifact."""
    rows = files.select("artifact_id", "file_ord", "path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("line_no", "text"))
    code = rows.where(F.trim("text").rlike(_CODE_COMMENT)).withColumn("line_no", F.col("line_no") + 1)
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("artifact_id", "file_ord").orderBy("line_no"))
    runs = code.withColumn("_i", island).groupBy("artifact_id", "file_ord", "path", "_i").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= least).drop("_i")
    order = Window.partitionBy("artifact_id").orderBy(F.desc("n_lines"), "file_ord", "first_line")
    return runs.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= MOST_GROUPS)


def duplication_findings(files: DataFrame) -> DataFrame:
    """VC-DUP-001 to 003 as findings."""
    ours = eligible(files)
    some = lambda df, rule, title, evidence, line: df.select(
        "artifact_id", F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit("Maintainability").alias("category"), F.lit(6).alias("category_ord"),
        F.lit(0).alias("severity"), F.lit(0).alias("user_severity"), F.lit(False).alias("is_blocking"), F.lit(False).alias("is_capability"), F.lit(None).cast("string").alias("capability"),
        F.lit("Rule").alias("source"), F.lit(None).cast("string").alias("explained_by"), F.col("first_file").alias("file_ord"), line.cast("int").alias("line"), evidence.alias("evidence"),
    )
    same = some(shapes.identical(ours), "VC-DUP-001", "Files that are equal", F.concat(F.col("n_files").cast("string"), F.lit(" files")), F.lit(None))
    repeated = some(repeated_blocks(ours), "VC-DUP-002", "A block that is repeated", F.concat(F.col("n_occurrences").cast("string"), F.lit(" places")), F.col("first_line"))
    commented = some(commented_runs(ours).withColumnRenamed("file_ord", "first_file"), "VC-DUP-003", "Code that is commented out", F.concat(F.col("n_lines").cast("string"), F.lit(" lines")), F.col("first_line"))
    return same.unionByName(repeated).unionByName(commented)

