"""Scores, verdicts, category scores and the split by stated purpose. All by artifact, from findings.

findings: artifact_id, rule_id, title, category, category_ord, severity, user_severity, source, is_blocking, is_capability, capability,
explained_by, path, line, col. An artifact without findings needs a row in `artifacts` to be scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryscan.functions.versions import severity_name

from .rulebook import CAPABILITIES, CATEGORIES

# Fixed values by severity code (Info to Critical): lowest and highest score, and weight.
FLOORS, CEILINGS, WEIGHTS = (100, 90, 70, 40, 10), (100, 99, 89, 69, 39), (0, 3, 8, 20, 40)
# The weights' scale, the least coverage with a score, and the blocking capabilities that are too many to account for.
SCALE, LEAST_COVERAGE, TOO_MANY = 100.0, 5, 3
OVER_DECLARED = "VC-PUR-001"
# Capabilities that a kind of application is expected to have.
EXPECTED = {
    "Unstated": (), "General": (), "SecurityTool": (), "CleanerOrPrivacy": ("BrowserCookies",), "PasswordManager": ("BrowserCredentials",),
    "CryptoWallet": ("CryptocurrencyWallets", "ClipboardMonitoring"), "ChatTool": ("ChatTokens",), "BackgroundUtility": ("StartsWithWindows", "DownloadsAndRunsCode"),
}


def _by_code(values: tuple, code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), code.cast("int") + 1)


def weight(code: Column) -> Column:
    return _by_code(WEIGHTS, code)


def score_of(worst: Column, weights: Column) -> Column:
    """From the worst severity (null without findings: 100) and the sum of weights; halves go to the even number."""
    low, high = _by_code(FLOORS, worst), _by_code(CEILINGS, worst)
    return F.when(worst.isNull(), F.lit(100)).otherwise(F.bround(high - (high - low) * (1 - F.exp(-weights / SCALE)))).cast("int")


def _sums(counts: Column | None = None) -> list[Column]:
    """Worst severity and weights of both audiences, over findings of rules (of those rows that count)."""
    ours = F.col("source") == "Rule"
    ours = ours if counts is None else ours & counts
    sums = {}
    for name, c in (("dev", "severity"), ("user", "user_severity")):
        sums[f"{name}_worst"] = F.max(F.when(ours, F.col(c)))
        sums[f"{name}_weight"] = F.sum(F.when(ours, weight(F.col(c))).otherwise(0))
        sums[f"{name}_counted"] = F.sum(F.when(ours & (weight(F.col(c)) > 0), 1).otherwise(0))
        sums[f"{name}_info"] = F.sum(F.when(ours & (weight(F.col(c)) == 0), 1).otherwise(0))
    return [v.alias(k) for k, v in sums.items()]


def _readings(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_sums())


def scores(findings: DataFrame) -> DataFrame:
    """artifact_id, developer_score, user_score, score (the smaller)."""
    rows = _readings(findings, "artifact_id")
    dev, user = score_of(F.col("dev_worst"), F.col("dev_weight")), score_of(F.col("user_worst"), F.col("user_weight"))
    return rows.select("artifact_id", dev.alias("developer_score"), user.alias("user_score"), F.least(dev, user).alias("score"))


_AUDIENCES = (("dev", "severity"), ("user", "user_severity"))
_COUNTS = [f"{name}_{i}" for name, _ in _AUDIENCES for i in range(len(WEIGHTS))]


def states(findings: DataFrame, sign: int = 1) -> DataFrame:
    """artifact_id and the number of findings of rules by severity and audience: all that a score needs, and a sum in each part.

    States of parts merge to the state of the whole, and with `sign` -1 findings are taken out again: the worst severity is the highest with a count, so
    withdrawals need no second look at what stays.
    """
    ours = F.col("source") == "Rule"
    count = lambda c, i: F.sum(F.when(ours & (F.col(c) == i), sign).otherwise(0))
    return findings.groupBy("artifact_id").agg(*[count(c, i).cast("long").alias(f"{name}_{i}") for name, c in _AUDIENCES for i in range(len(WEIGHTS))])


def merged(*parts: DataFrame) -> DataFrame:
    """The sum of states; an artifact of which nothing is left stays, with zeros."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("artifact_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def scores_of(stored: DataFrame) -> DataFrame:
    """artifact_id, developer_score, user_score, score, from states; 100 where nothing is left."""
    out = []
    for name, _ in _AUDIENCES:
        worst = F.coalesce(*[F.when(F.col(f"{name}_{i}") > 0, F.lit(i)) for i in reversed(range(len(WEIGHTS)))])
        out.append(score_of(worst, sum((F.col(f"{name}_{i}") * w for i, w in enumerate(WEIGHTS)), F.lit(0))))
    return stored.select("artifact_id", out[0].alias("developer_score"), out[1].alias("user_score"), F.least(*out).alias("score"))


def band(score: Column) -> Column:
    return F.when(score <= 39, "CriticalIssues").when(score <= 69, "SeriousIssues").when(score <= 89, "NeedsWork").otherwise("NoKnownIssues")


def _titles(condition: Column) -> Column:
    """Distinct titles in the order of severity, category and rule."""
    rows = F.array_sort(F.collect_set(F.when(condition, F.struct((-F.col("severity")).alias("s"), "category_ord", "rule_id", "title"))))
    return F.array_distinct(F.transform(rows, lambda x: x["title"]))


def verdicts(artifacts: DataFrame, findings: DataFrame, capabilities: DataFrame | None = None, audience: str = "Developer") -> DataFrame:
    """One row for each row of artifacts (artifact_id, coverage_percent): score, band, advice, reasons, explanation and inferred findings.

    `capabilities` are the rows that the split by purpose set aside; those explained and blocking are accounted for.
    """
    routed = findings.withColumn("route", F.lit("finding"))
    if capabilities is not None:
        routed = routed.unionByName(capabilities.withColumn("route", F.lit("capability")), allowMissingColumns=True)
    return verdicts_of(artifacts, routed, audience)


def verdicts_of(artifacts: DataFrame, routed: DataFrame, audience: str = "Developer") -> DataFrame:
    """`verdicts` of findings and capabilities in one table with `route`, which is read once."""
    found, ours = F.col("route") == "finding", F.col("source") == "Rule"
    if "explained_by" not in routed.columns:
        routed = routed.withColumn("explained_by", F.lit(None).cast("string"))
    sums = routed.groupBy("artifact_id").agg(
        *_sums(found), _titles(found & F.col("is_blocking") & ours).alias("blocking_reasons"),
        F.sum(F.when(found & ~ours & (F.greatest(weight(F.col("severity")), weight(F.col("user_severity"))) > 0), 1).otherwise(0)).alias("inferred_count"),
        F.max(F.when(found & ~ours, F.greatest("severity", "user_severity"))).alias("worst_inferred"),
        _titles((F.col("route") == "capability") & F.col("explained_by").isNotNull() & F.col("is_blocking") & ours).alias("accounted_for"),
    )
    out = artifacts.join(sums, "artifact_id", "left")
    for c in ("blocking_reasons", "accounted_for"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    dev, user = score_of(F.col("dev_worst"), F.coalesce("dev_weight", F.lit(0))), score_of(F.col("user_worst"), F.coalesce("user_weight", F.lit(0)))
    out = out.withColumns({"developer_score": dev, "user_score": user}).withColumn("score", F.least("developer_score", "user_score"))
    governs = F.when(F.col("developer_score") == F.col("user_score"), F.lit(audience)).when(F.col("developer_score") < F.col("user_score"), "Developer").otherwise("EndUser")
    blocked = F.size("blocking_reasons") > 0
    little = F.col("coverage_percent") < LEAST_COVERAGE
    pick = lambda x: F.when(F.col("governed_by") == "Developer", F.col(f"dev_{x}")).otherwise(F.col(f"user_{x}"))
    worst = F.coalesce(pick("worst"), F.lit(0))
    out = out.withColumn("governed_by", governs)
    return out.select(
        *artifacts.columns, "developer_score", "user_score", "score",
        F.when(little, F.when(blocked, "CriticalIssues").otherwise("InsufficientCoverage")).otherwise(band(F.col("score"))).alias("band"),
        F.when(blocked, "AdviseAgainst").when(F.size("accounted_for") > 0, "ConsistentWithStatedPurpose").otherwise("None").alias("advice"),
        "governed_by", severity_name(worst).alias("worst"), _by_code(FLOORS, worst).alias("floor"), _by_code(CEILINGS, worst).alias("ceiling"),
        F.coalesce(pick("counted"), F.lit(0)).cast("long").alias("counted"), F.coalesce(pick("info"), F.lit(0)).cast("long").alias("informational"),
        "blocking_reasons", "accounted_for", F.coalesce("inferred_count", F.lit(0)).cast("long").alias("inferred_count"),
        severity_name(F.coalesce("worst_inferred", F.lit(0))).alias("worst_inferred"),
    )


def category_scores(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """artifact_id, category, category_ord, score: all seven categories of every artifact; 100 without findings."""
    every = artifacts.select("artifact_id", F.posexplode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category_ord", "category"))
    rows = every.join(_readings(findings, "artifact_id", "category"), ["artifact_id", "category"], "left")
    both = [score_of(F.col(f"{x}_worst"), F.coalesce(f"{x}_weight", F.lit(0))) for x in ("dev", "user")]
    return rows.select("artifact_id", "category", "category_ord", F.least(*both).alias("score"))


def weak_categories(scored: DataFrame) -> DataFrame:
    """Categories below 100, the lowest first."""
    return scored.where("score < 100").orderBy("artifact_id", "score", "category_ord")


def severity_pivot(findings: DataFrame) -> DataFrame:
    """Findings by developer severity, a column each."""
    count = lambda i: F.sum(F.when(F.col("severity") == i, 1).otherwise(0)).cast("long")
    return findings.groupBy("artifact_id").agg(*[count(i).alias(n) for i, n in enumerate(("info", "low", "medium", "high", "critical"))])


def _accounted(purpose: DataFrame) -> DataFrame:
    """By artifact: who stated the purpose, and the capabilities accounted for."""
    return purpose.select("artifact_id", F.col("stated_by").alias("_by"), F.coalesce("accounted", F.array().cast("array<string>")).alias("_accounted"))


def split(findings: DataFrame, purpose: DataFrame) -> DataFrame:
    """Findings with `route`: capability for notes and for blocking capabilities that the reader accounts for, else finding.

    purpose: artifact_id (one row each), stated_by (Reader, Manifest, SourceComment), accounted array<string>. Only a reader's
    statement moves a blocking finding; it then carries the reason in explained_by.
    """
    rows = findings.join(_accounted(purpose), "artifact_id", "left")
    known = F.col("capability").isNotNull() & F.coalesce(F.array_contains("_accounted", F.col("capability")), F.lit(False))
    excused = F.col("is_blocking") & known & (F.col("_by") == "Reader")
    return rows.withColumns({
        "route": F.when(F.col("is_capability") | F.coalesce(excused, F.lit(False)), "capability").otherwise("finding"),
        "explained_by": F.when(known & (F.col("is_capability") | F.coalesce(excused, F.lit(False))), F.col("_by")),
    }).drop("_by", "_accounted")


def over_declared(findings: DataFrame, purpose: DataFrame) -> DataFrame:
    """A Medium finding where three or more different blocking capabilities are accounted for."""
    rows = findings.where(F.col("is_blocking") & F.col("capability").isNotNull()).join(_accounted(purpose), "artifact_id").where(F.array_contains("_accounted", F.col("capability")))
    return rows.groupBy("artifact_id").agg(F.collect_set("capability").alias("c")).where(F.size("c") >= TOO_MANY).select(
        "artifact_id", F.lit(OVER_DECLARED).alias("rule_id"), F.lit("The stated purpose covers most of what was found").alias("title"),
        F.lit("CodeSafety").alias("category"), F.lit(CATEGORIES.index("CodeSafety")).alias("category_ord"), F.lit(2).alias("severity"), F.lit(2).alias("user_severity"),
        F.lit(False).alias("is_blocking"), F.lit(False).alias("is_capability"), F.lit(None).cast("string").alias("capability"), F.lit("Rule").alias("source"),
        F.lit(None).cast("string").alias("explained_by"), F.array_join(F.array_sort("c"), ", ").alias("evidence"),
    )


def reconsider(observed: DataFrame, purpose: DataFrame) -> DataFrame:
    """The split of everything observed under another purpose: findings and capabilities together, without the old over-declaration."""
    plain = observed.where(F.col("rule_id") != OVER_DECLARED).drop("route")
    return split(plain.unionByName(over_declared(plain, purpose), allowMissingColumns=True), purpose)


def questions(findings: DataFrame, answered: DataFrame | None = None) -> DataFrame:
    """Distinct capabilities of blocking findings that nobody has answered for yet."""
    asked = findings.where(F.col("is_blocking") & F.col("capability").isNotNull()).select("artifact_id", "capability").distinct()
    return asked if answered is None else asked.join(answered, ["artifact_id", "capability"], "left_anti")


def expected(kind: Column) -> Column:
    """Capabilities that are normal for a kind of application."""
    rows = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(rows, kind), F.array().cast("array<string>"))


def capability_order(capability: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CAPABILITIES]), capability)


def limitations(notes: DataFrame, each: int = 20, unresolved: int = 5) -> DataFrame:
    """By artifact the ordered notes: kind (0 recovery, 1 engine, 2 not checked, 3 unresolved manifests), ord, note; of the last two kinds the first few."""
    from pyspark.sql.window import Window

    ranked = notes.withColumn("_n", F.row_number().over(Window.partitionBy("artifact_id", "kind").orderBy("ord", "note")))
    some = ranked.where((F.col("kind") < 2) | ((F.col("kind") == 2) & (F.col("_n") <= each)) | ((F.col("kind") == 3) & (F.col("_n") <= unresolved)))
    return some.groupBy("artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ord", "note"))), lambda x: x["note"]).alias("limitations"))


def caveats(artifacts: DataFrame) -> DataFrame:
    """Reservations about a report, from minified_share, unresolved (manifests without versions) and blocking findings without a capability."""
    return artifacts.select("artifact_id", F.filter(F.array(
        F.when(F.col("minified_share") >= 50, "mostly minified"), F.when(F.col("unresolved") > 0, "versions not pinned"), F.when(F.col("unanswerable"), "a blocking finding no purpose explains"),
    ), lambda x: x.isNotNull()).alias("caveats"))


def unanswerable(findings: DataFrame) -> DataFrame:
    """Whether a blocking finding has no capability, so that no stated purpose can account for it."""
    return findings.groupBy("artifact_id").agg(F.bool_or(F.col("is_blocking") & F.col("capability").isNull()).alias("unanswerable"))


def relevant(findings: DataFrame, audience: str) -> DataFrame:
    """Findings that concern the audience: all for developers, for end users those above Info in their reading."""
    return findings if audience == "Developer" else findings.where("user_severity > 0")


# Prices of a million tokens: input, output, cache write, cache read.
PRICES = {"input_tokens": "5", "output_tokens": "25", "cache_write_tokens": "6.25", "cache_read_tokens": "0.5"}


def token_usage(usage: DataFrame, *keys: str) -> DataFrame:
    """Sums of the four counters and their cost."""
    sums = usage.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in PRICES])
    cost = sum((F.col(c).cast("decimal(18,0)") * F.lit(p).cast("decimal(6,2)") for c, p in PRICES.items()), F.lit(0).cast("decimal(18,2)"))
    return sums.withColumn("cost", (cost / 1_000_000).cast("decimal(18,8)"))


def explanations(answers: DataFrame) -> DataFrame:
    """The first explanation of each capability in file order."""
    return answers.groupBy("artifact_id", "capability").agg(F.min_by("explanation", F.struct("file_ord", "explanation")).alias("explanation"), F.count("*").alias("n"))
