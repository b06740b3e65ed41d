"""The whole scan as one plan: files to findings, verdicts, categories and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryscan.operators import advisories, dependencies, packaging, redundancy, report, rules, scoring
from quarryscan.operators import files as shapes


@dataclass(frozen=True)
class Scan:
    observed: DataFrame
    findings: DataFrame
    capabilities: DataFrame
    verdicts: DataFrame
    categories: DataFrame
    checks: DataFrame
    dependencies: DataFrame


def artifacts_of(files: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """artifact_id, coverage_percent; 100 where no coverage is given."""
    names = files.select("artifact_id").distinct()
    if coverage is None:
        return names.withColumn("coverage_percent", F.lit(100))
    return names.join(coverage.select("artifact_id", "coverage_percent"), "artifact_id", "left").select("artifact_id", F.coalesce("coverage_percent", F.lit(0)).alias("coverage_percent"))


def scan(files: DataFrame, listing: DataFrame | None = None, records: DataFrame | None = None, purpose: DataFrame | None = None, coverage: DataFrame | None = None, audience: str = "Developer", book=rules.RULES) -> Scan:
    """files as the engine takes them; listing for packaging checks, advisory records and a stated purpose are optional."""
    found = rules.findings(files, book)
    parts = [found, redundancy.duplication_findings(files)]
    inventory = dependencies.inventory(files)
    if listing is not None:
        parts.append(packaging.packaging(listing))
    if records is not None:
        parsed = advisories.parse(records)
        hits, _ = advisories.with_details(advisories.lookup(inventory, advisories.affected_packages(parsed)), parsed)
        parts.append(advisories.vulnerability_findings(advisories.by_package(hits)))
    observed = parts[0]
    for p in parts[1:]:
        observed = observed.unionByName(p, allowMissingColumns=True)
    return judged(observed, artifacts_of(files, coverage), rules.outcomes(files, found, book), inventory, purpose, audience)


def judged(observed: DataFrame, artifacts: DataFrame, checks: DataFrame, inventory: DataFrame, purpose: DataFrame | None, audience: str) -> Scan:
    """Everything after observation; another purpose or audience needs only this."""
    # Without a purpose: a relation that the optimiser knows is empty, so that nothing is observed a second time for it.
    nothing = observed.sparkSession.range(1).where(F.lit(False)).selectExpr("cast(id AS string) AS artifact_id", "'' AS stated_by", "array('') AS accounted")
    stated = purpose if purpose is not None else nothing
    routed = scoring.reconsider(observed, stated)
    findings, capabilities = routed.where("route = 'finding'"), routed.where("route = 'capability'")
    return Scan(routed, findings, capabilities, scoring.verdicts_of(artifacts, routed, audience), scoring.category_scores(artifacts, findings), checks, inventory)


def rescored(done: Scan, artifacts: DataFrame, audience: str) -> Scan:
    return Scan(done.observed, done.findings, done.capabilities, scoring.verdicts(artifacts, done.findings, done.capabilities, audience), done.categories, done.checks, done.dependencies)


def reports(done: Scan, audience: str = "Developer") -> DataFrame:
    return report.assembled(done.verdicts, done.observed, done.categories, done.checks, audience)


def effort(files: DataFrame) -> DataFrame:
    """Files, characters, lines and shares by artifact."""
    shaped = shapes.shape(files)
    return shapes.coverage(shaped).join(shapes.shares(shaped.withColumn("readable", F.lit(True))), "artifact_id")
