"""Reports: JSON and Markdown of an artifact, and the copy that is safe to share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import paths as P
from quarryscan.functions import text as T
from quarryscan.functions.versions import severity_name

from .rulebook import CATEGORIES, CATEGORY_LABELS

SCHEMA_VERSION = 1
#: Limitations listed in a Markdown report.
MOST_LIMITS = 30


@dataclass(frozen=True)
class Format:
    label: str
    extension: str
    carries_code: bool
    suffix: str = ""


FORMATS = {"json": Format("JSON", "json", True), "markdown": Format("Markdown", "md", True), "shared": Format("Markdown without code", "md", False, "-shared"), "scorecard": Format("Scorecard", "png", False, "-card")}


def reading(column: str, audience: str) -> Column:
    """`severity` or another column in an audience's reading."""
    return F.col(column if audience == "Developer" else f"user_{column}")


def category_label(category: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(CATEGORIES, CATEGORY_LABELS) for x in pair]), category)


def band_label(band: Column) -> Column:
    labels = {"CriticalIssues": "Critical issues", "SeriousIssues": "Serious issues", "NeedsWork": "Needs work", "NoKnownIssues": "No known issues", "InsufficientCoverage": "Too little could be read"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), band), band)


def method_label(kind: Column) -> Column:
    """How the files of a kind of artifact were recovered."""
    labels = {
        "SourceTree": "Read as source", "Archive": "Read from an archive", "PythonBundle": "Read from a bundle", "ElectronApp": "Read from an application archive", "AsarArchive": "Read from an application archive",
        "DotNetAssembly": "Decompiled", "DotNetSingleFile": "Unpacked from a single-file program", "WindowsInstaller": "Unpacked from an installer", "JavaArchive": "Read from an archive",
    }
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), kind), F.lit("Not recovered"))


def shared(findings: DataFrame) -> DataFrame:
    """The copy without code: no evidence and line, and paths as `file N (.ext)` by their first appearance (findings before capabilities).

    `route` and `nth` (the order of a row in its report) must be there; the column stays.
    """
    key = F.lower("path")
    order = F.struct((F.coalesce(F.col("route"), F.lit("finding")) == "capability").alias("late"), "nth")
    first = findings.where("path is not null").groupBy("artifact_id", key.alias("_p")).agg(F.min(order).alias("_o"))
    numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy("artifact_id").orderBy("_o", "_p")))
    rows = findings.withColumn("_p", key).join(numbered.select("artifact_id", "_p", "_n"), ["artifact_id", "_p"], "left")
    ext = P.extension(F.col("path"))
    label = F.when(F.col("_n").isNotNull(), F.concat(F.lit("file "), F.col("_n").cast("string"), F.when(ext != "", F.concat(F.lit(" (."), ext, F.lit(")"))).otherwise(F.lit(""))))
    return rows.withColumns({"path": label, "evidence": F.lit(None).cast("string"), "line": F.lit(None).cast("int")}).drop("_p", "_n").select(*findings.columns)


def _finding(audience: str) -> Column:
    return F.struct(
        "rule_id", "title", severity_name(reading("severity", audience)).alias("severity"), "category", "path", "line", F.col("col").alias("column"), "evidence",
        F.col("is_blocking").alias("is_blocking"), "capability", "explained_by", "source",
    )


def assembled(verdicts: DataFrame, findings: DataFrame, categories: DataFrame, checks: DataFrame | None = None, audience: str = "Developer") -> DataFrame:
    """One row for each artifact with its findings, capabilities, category scores and checks as nested arrays."""
    key = F.struct((-reading("severity", audience)).alias("s"), "category_ord", "rule_id", "path", "line", "col")
    route = F.coalesce(F.col("route"), F.lit("finding"))
    rows = lambda r: F.transform(F.array_sort(F.collect_list(F.when(route == r, F.struct(key.alias("k"), _finding(audience).alias("f"))))), lambda x: x["f"])
    lists = findings.groupBy("artifact_id").agg(rows("finding").alias("findings"), rows("capability").alias("capabilities"))
    scores = categories.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("category_ord", "category", "score"))), lambda x: F.struct(x["category"].alias("category"), x["score"].alias("score"))).alias("category_scores"))
    out = verdicts.join(lists, "artifact_id", "left").join(scores, "artifact_id", "left")
    if checks is not None:
        listed = checks.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "state", "files_examined"))).alias("checks"))
        out = out.join(listed, "artifact_id", "left")
    return out


def to_json(reports: DataFrame) -> DataFrame:
    """artifact_id, report: nulls are left out; the score is left out where too little could be read."""
    score = F.when(F.col("band") != "InsufficientCoverage", F.col("score"))
    others = [c for c in reports.columns if c != "score"]
    return reports.select("artifact_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema"), score.alias("score"), *others)).alias("report"))


def to_markdown(reports: DataFrame, audience: str = "Developer") -> DataFrame:
    """artifact_id, report: headings in fixed order; built on the cluster, a text for each artifact."""
    none = F.array().cast("array<string>")
    bullets = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")
    line = lambda f: F.concat(F.lit("**"), f["title"], F.lit("** ("), f["severity"], F.lit(", "), f["rule_id"], F.lit(")"), F.coalesce(F.concat(F.lit(" in "), T.location(f["path"], f["line"], f["column"])), F.lit("")))
    cols = reports.columns
    maybe = lambda c: F.coalesce(F.col(c), none) if c in cols else none
    section = lambda title, body: F.when(F.length(body) > 0, F.concat(F.lit(f"## {title}\n\n"), body))
    who = "for its developer" if audience == "Developer" else "for its user"
    scores = F.transform("category_scores", lambda c: F.concat(category_label(c["category"]), F.lit(": "), c["score"].cast("string")))
    head = F.concat(F.lit("# "), "artifact_id", F.lit(f"\n\nA report {who}.\n\n**"), band_label(F.col("band")), F.lit("**"), F.when(F.col("band") != "InsufficientCoverage", F.concat(F.lit(": "), F.col("score").cast("string"), F.lit(" of 100"))).otherwise(F.lit("")))
    basis = F.concat(F.lit("Worst: "), "worst", F.lit(", between "), F.col("floor").cast("string"), F.lit(" and "), F.col("ceiling").cast("string"), F.lit("; counted: "), F.col("counted").cast("string"), F.lit("; notes: "), F.col("informational").cast("string"))
    checks = F.transform("checks", lambda c: F.concat(c["rule_id"], F.lit(": "), c["state"])) if "checks" in cols else none
    parts = F.array(
        head, section("Reasons not to install", bullets(maybe("blocking_reasons"))), section("Accounted for by its purpose", bullets(maybe("accounted_for"))), section("The score", basis),
        section("Findings", bullets(F.transform("findings", line))), section("What it can do", bullets(F.transform("capabilities", line))), section("Categories", bullets(scores)),
        section("Dependencies", bullets(maybe("dependencies"))), section("Coverage", F.concat(F.col("coverage_percent").cast("string"), F.lit(" %"))), section("Checks", bullets(checks)),
        section("Limits", bullets(F.slice(maybe("limitations"), 1, MOST_LIMITS))),
    )
    return reports.select("artifact_id", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n").alias("report"))


def write(reports: DataFrame, path: str) -> None:
    """One text per artifact, dealt by Spark."""
    reports.select("report").write.mode("overwrite").text(path, lineSep="\n\n")
