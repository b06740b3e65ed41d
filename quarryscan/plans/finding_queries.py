"""Queries over findings: order, deduplication, scores, purpose and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.operators import report, rules, scoring
from quarryscan.operators.rulebook import CATEGORIES

from .common import ARTIFACTS, FINDINGS, PURPOSE, artifacts, findings, purpose


def test_file_softening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and blocking of findings after softening in test files."""
    return rules.adjust(findings(spark, sf_dir)).select("file_ord", "severity", "is_blocking", "softened")


def dedup_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings left of each rule, path, line and region of 200 columns."""
    one = findings(spark, sf_dir).withColumn("path", F.lit("same"))
    return rules.deduplicate(one).select("artifact_id", "rule_id", "line", "col", "file_ord")


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every finding in its artifact's report."""
    order = Window.partitionBy("artifact_id").orderBy(F.desc("severity"), "category_ord", "rule_id", "path", "line", "col", "file_ord")
    return findings(spark, sf_dir).select("artifact_id", "file_ord", F.row_number().over(order).cast("long").alias("place"))


def score_by_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(findings(spark, sf_dir))


def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, band, advice and explanation of every artifact."""
    rows = scoring.verdicts(artifacts(spark, sf_dir), findings(spark, sf_dir))
    return rows.select("artifact_id", "coverage_percent", "score", "band", "advice", "governed_by", "worst", "counted", "informational", F.array_join("blocking_reasons", "|").alias("reasons"), "inferred_count", "worst_inferred")


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.category_scores(artifacts(spark, sf_dir), findings(spark, sf_dir)).select("artifact_id", "category", "score")


def weak_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories below 100, the lowest of an artifact first."""
    rows = scoring.category_scores(artifacts(spark, sf_dir), findings(spark, sf_dir)).where("score < 100")
    return rows.select("artifact_id", "category", "score", F.row_number().over(Window.partitionBy("artifact_id").orderBy("score", "category_ord")).cast("long").alias("place"))


def severity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_pivot(findings(spark, sf_dir))


def purpose_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every finding goes under a stated purpose."""
    return scoring.split(findings(spark, sf_dir), purpose(spark, sf_dir)).select("file_ord", "route", "explained_by")


def over_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts whose purpose accounts for three or more blocking capabilities."""
    return scoring.over_declared(findings(spark, sf_dir), purpose(spark, sf_dir)).select("artifact_id", "rule_id", "severity", "evidence")


def reconsidered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after the split, over the findings that stay."""
    routed = scoring.reconsider(findings(spark, sf_dir), purpose(spark, sf_dir))
    return scoring.scores(routed.where("route = 'finding'"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities of blocking findings that the purpose does not answer."""
    answered = purpose(spark, sf_dir).select("artifact_id", F.explode("accounted").alias("capability"))
    return scoring.questions(findings(spark, sf_dir), answered)


def sharing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of files in the copy to share."""
    order = Window.partitionBy("artifact_id").orderBy(F.desc("severity"), "category_ord", "rule_id", "path", "line", "col", "file_ord")
    rows = findings(spark, sf_dir).withColumn("route", F.when(F.col("is_capability"), "capability").otherwise("finding")).withColumn("nth", F.row_number().over(order))
    return report.shared(rows).select("artifact_id", "file_ord", F.col("path").alias("label"), "line", "col")


def rule_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the family of their rule."""
    return findings(spark, sf_dir).groupBy(rules.family(F.col("rule_id")).alias("family")).agg(F.count("*").alias("n"))


def triage_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each artifact to look at first: flagged, callers, then those that take input."""
    from quarryscan.operators import triage

    from .common import files

    known = findings(spark, sf_dir).where("is_blocking or severity = 4")
    return triage.triage(files(spark, sf_dir), known).select("artifact_id", "file_ord", "tier", "n_known", "place", "n_qualified")


def scores_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after findings came and others went, from stored states and the changes alone."""
    every = findings(spark, sf_dir)
    i = F.col("file_ord")
    stored = scoring.states(every.where(i % 5 > 0))
    arrived, gone = every.where(i % 5 == 0), every.where((i % 5 > 0) & ((i % 7 == 3) | (F.col("severity") == 4) & (i % 2 == 0)))
    return scoring.scores_of(scoring.merged(stored, scoring.states(arrived), scoring.states(gone, -1)))


_WEIGHT = "CASE {0} WHEN 4 THEN 40 WHEN 3 THEN 20 WHEN 2 THEN 8 WHEN 1 THEN 3 ELSE 0 END"


def _score(worst: str, weight: str) -> str:
    low, high = f"([100, 90, 70, 40, 10])[{worst} + 1]", f"([100, 99, 89, 69, 39])[{worst} + 1]"
    return f"CASE WHEN {worst} IS NULL THEN 100 ELSE round_even({high} - ({high} - {low}) * (1 - exp(-{weight} / 100.0)), 0) END::INT"


def _readings(source: str, keys: str) -> str:
    return f"""(SELECT {keys}, max(severity) FILTER (source = 'Rule') AS dw, max(user_severity) FILTER (source = 'Rule') AS uw,
  coalesce(sum({_WEIGHT.format('severity')}) FILTER (source = 'Rule'), 0) AS ds, coalesce(sum({_WEIGHT.format('user_severity')}) FILTER (source = 'Rule'), 0) AS us,
  count(*) FILTER (source = 'Rule' AND severity > 0) AS dc, count(*) FILTER (source = 'Rule' AND user_severity > 0) AS uc,
  count(*) FILTER (source = 'Rule' AND severity = 0) AS di, count(*) FILTER (source = 'Rule' AND user_severity = 0) AS ui FROM {source} GROUP BY {keys})"""


_D, _U = _score("dw", "ds"), _score("uw", "us")
_SPLIT = f"""(SELECT f.*, coalesce(f.is_capability OR (f.is_blocking AND list_contains(p.accounted, f.capability) AND p.stated_by = 'Reader'), false) AS aside,
  coalesce(list_contains(p.accounted, f.capability), false) AS known, p.stated_by, p.accounted FROM {FINDINGS} f LEFT JOIN {PURPOSE} p USING (artifact_id))"""
_OVER = f"""(SELECT artifact_id, string_agg(DISTINCT capability, ', ' ORDER BY capability) AS evidence, count(DISTINCT capability) AS n FROM {_SPLIT} WHERE is_blocking AND known GROUP BY 1 HAVING count(DISTINCT capability) >= 3)"""
_CATEGORY = f"""(SELECT a.artifact_id, c.category, c.ord, least({_D}, {_U}) AS score FROM {ARTIFACTS} a
  CROSS JOIN (SELECT unnest({list(CATEGORIES)}) AS category, unnest(range(7)) AS ord) c LEFT JOIN {_readings(FINDINGS, 'artifact_id, category')} r ON r.artifact_id = a.artifact_id AND r.category = c.category)"""
_TEST = "(lower(path) LIKE '%/test%' AND category <> 'Secrets' AND severity > 0)"
_NAMES = "(SELECT DISTINCT artifact_id, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS name FROM known WHERE length(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) >= 4)"


def _triage_sql() -> str:
    from quarryscan.operators.triage import SURFACE

    from .common import FILES

    surface = SURFACE.replace("'", "''")
    return f"""WITH files AS {FILES}, f AS {FINDINGS}, known AS (SELECT artifact_id, lower(path) AS p, any_value(path) AS path, count(*) AS n FROM f WHERE is_blocking OR severity = 4 GROUP BY 1, 2),
  names AS (SELECT DISTINCT artifact_id, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS name FROM f WHERE (is_blocking OR severity = 4) AND length(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) >= 4),
  called AS (SELECT DISTINCT files.artifact_id, file_ord FROM files JOIN names USING (artifact_id) WHERE contains(content, name)),
  tiers AS (SELECT files.artifact_id, files.file_ord, CASE WHEN known.n IS NOT NULL THEN 0 WHEN called.file_ord IS NOT NULL THEN 1 WHEN regexp_matches(content, '{surface}') THEN 2 END AS tier, coalesce(known.n, 0) AS n_known
    FROM files LEFT JOIN known ON known.artifact_id = files.artifact_id AND known.p = lower(files.path) LEFT JOIN called ON called.artifact_id = files.artifact_id AND called.file_ord = files.file_ord)
  SELECT artifact_id, file_ord, tier::INT AS tier, n_known::INT AS n_known, row_number() OVER (PARTITION BY artifact_id ORDER BY tier, n_known DESC, file_ord) AS place, count(*) OVER (PARTITION BY artifact_id) AS n_qualified
  FROM tiers WHERE tier IS NOT NULL QUALIFY place <= 40"""


QUERIES = {f.__name__: f for f in (
    test_file_softening, dedup_region, finding_order, score_by_artifact, verdict_bands, category_scores, weak_categories, severity_pivot,
    purpose_split, over_declaration, reconsidered_scores, questions, sharing_labels, rule_families, triage_top40, scores_after_changes,
)}
ORACLE_SQL = {
    "test_file_softening": f"SELECT file_ord, CASE WHEN {_TEST} THEN severity - 1 ELSE severity END AS severity, is_blocking AND NOT {_TEST} AS is_blocking, {_TEST} AS softened FROM {FINDINGS}",
    "dedup_region": f"SELECT artifact_id, rule_id, line, col, file_ord FROM {FINDINGS} QUALIFY row_number() OVER (PARTITION BY artifact_id, rule_id, line, (col - 1) // 200 ORDER BY col, file_ord) = 1",
    "finding_order": f"SELECT artifact_id, file_ord, row_number() OVER (PARTITION BY artifact_id ORDER BY severity DESC, category_ord, rule_id, path, line, col, file_ord) AS place FROM {FINDINGS}",
    "scores_after_changes": f"""SELECT a.artifact_id, coalesce({_D}, 100) AS developer_score, coalesce({_U}, 100) AS user_score, least(coalesce({_D}, 100), coalesce({_U}, 100)) AS score FROM (SELECT DISTINCT artifact_id FROM {FINDINGS}) a
  LEFT JOIN {_readings(f'(SELECT * FROM {FINDINGS} WHERE file_ord % 5 = 0 OR NOT (file_ord % 7 = 3 OR (severity = 4 AND file_ord % 2 = 0)))', 'artifact_id')} r ON r.artifact_id IS NOT DISTINCT FROM a.artifact_id""",
    "score_by_artifact": f"SELECT artifact_id, {_D} AS developer_score, {_U} AS user_score, least({_D}, {_U}) AS score FROM {_readings(FINDINGS, 'artifact_id')}",
    "verdict_bands": f"""WITH r AS (SELECT *, {_D} AS d, {_U} AS u FROM {_readings(FINDINGS, 'artifact_id')}),
  b AS (SELECT artifact_id, title, min((-severity, category_ord, rule_id, title)) AS k FROM {FINDINGS} WHERE is_blocking AND source = 'Rule' GROUP BY 1, 2),
  t AS (SELECT artifact_id, string_agg(title, '|' ORDER BY k) AS reasons FROM b GROUP BY 1),
  i AS (SELECT artifact_id, count(*) FILTER (severity > 0 OR user_severity > 0) AS n, max(greatest(severity, user_severity)) AS w FROM {FINDINGS} WHERE source <> 'Rule' GROUP BY 1)
  SELECT artifact_id, coverage_percent, least(d, u) AS score,
    CASE WHEN coverage_percent < 5 THEN CASE WHEN reasons IS NOT NULL THEN 'CriticalIssues' ELSE 'InsufficientCoverage' END WHEN least(d, u) <= 39 THEN 'CriticalIssues' WHEN least(d, u) <= 69 THEN 'SeriousIssues' WHEN least(d, u) <= 89 THEN 'NeedsWork' ELSE 'NoKnownIssues' END AS band,
    CASE WHEN reasons IS NOT NULL THEN 'AdviseAgainst' ELSE 'None' END AS advice, CASE WHEN d <= u THEN 'Developer' ELSE 'EndUser' END AS governed_by,
    (['Info', 'Low', 'Medium', 'High', 'Critical'])[coalesce(CASE WHEN d <= u THEN dw ELSE uw END, 0) + 1] AS worst,
    CASE WHEN d <= u THEN dc ELSE uc END AS counted, CASE WHEN d <= u THEN di ELSE ui END AS informational, coalesce(reasons, '') AS reasons,
    coalesce(n, 0) AS inferred_count, (['Info', 'Low', 'Medium', 'High', 'Critical'])[coalesce(w, 0) + 1] AS worst_inferred
  FROM {ARTIFACTS} a LEFT JOIN r USING (artifact_id) LEFT JOIN t USING (artifact_id) LEFT JOIN i USING (artifact_id)""",
    "category_scores": f"SELECT artifact_id, category, score FROM {_CATEGORY}",
    "weak_categories": f"SELECT artifact_id, category, score, row_number() OVER (PARTITION BY artifact_id ORDER BY score, ord) AS place FROM {_CATEGORY} WHERE score < 100",
    "severity_pivot": f"SELECT artifact_id, {', '.join(f'count(*) FILTER (severity = {i}) AS {n}' for i, n in enumerate(('info', 'low', 'medium', 'high', 'critical')))} FROM {FINDINGS} GROUP BY 1",
    "purpose_split": f"SELECT file_ord, CASE WHEN aside THEN 'capability' ELSE 'finding' END AS route, CASE WHEN aside AND known THEN stated_by END AS explained_by FROM {_SPLIT}",
    "over_declaration": f"SELECT artifact_id, 'VC-PUR-001' AS rule_id, 2 AS severity, evidence FROM {_OVER}",
    "reconsidered_scores": f"""WITH s AS (SELECT artifact_id, severity, user_severity, source FROM {_SPLIT} WHERE NOT aside UNION ALL SELECT artifact_id, 2, 2, 'Rule' FROM {_OVER})
  SELECT artifact_id, {_D} AS developer_score, {_U} AS user_score, least({_D}, {_U}) AS score FROM {_readings('s', 'artifact_id')}""",
    "questions": f"SELECT DISTINCT artifact_id, capability FROM {_SPLIT} WHERE is_blocking AND capability IS NOT NULL AND NOT known",
    "sharing_labels": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY severity DESC, category_ord, rule_id, path, line, col, file_ord) AS nth FROM {FINDINGS}),
  n AS (SELECT artifact_id, lower(path) AS p, row_number() OVER (PARTITION BY artifact_id ORDER BY min((is_capability, nth)), lower(path)) AS k FROM f GROUP BY 1, 2)
  SELECT f.artifact_id, file_ord, 'file ' || k || ' (.' || lower(regexp_extract(path, '\\.([^./]+)$', 1)) || ')' AS label, NULL::INT AS line, col FROM f JOIN n ON n.artifact_id = f.artifact_id AND n.p = lower(f.path)""",
    "rule_families": f"SELECT CASE split_part(rule_id, '-', 2) WHEN 'SEC' THEN 'Credentials in the files' WHEN 'CFG' THEN 'Unsafe configuration' WHEN 'CODE' THEN 'Unsafe code' ELSE 'Behaviour of malicious software' END AS family, count(*) AS n FROM {FINDINGS} GROUP BY 1",
    "triage_top40": _triage_sql(),
}
