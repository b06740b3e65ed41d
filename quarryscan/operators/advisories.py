"""Advisories: records, their severity, and the join with dependencies.

An advisory table takes the place of a lookup service: records as JSON text in the open vulnerability format, or parsed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import versions as V

# Identifiers and fixed versions shown in a finding, details fetched for one lookup, coordinates of a batch.
MOST_IDS, MOST_FIXES, MOST_DETAILS, BATCH = 12, 8, 750, 500
SCHEMA = (
    "id string, aliases array<string>, summary string, details string, published string, severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string>, affected array<struct<package:struct<ecosystem:string,name:string>, versions:array<string>, "
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>, database_specific:struct<severity:string>>>"
)


def parse(records: DataFrame) -> DataFrame:
    """From a column `record`: id, aliases, summary, cvss_score, database_severity, severity, fixed_versions, cve_id, published, affected.

    A record without an id, or that is no JSON, gives no row. The summary falls back to the first line of the details.
    """
    row = records.select(F.from_json("record", SCHEMA).alias("r")).where("r.id is not null and r.id <> ''").select("r.*")
    none = F.array().cast("array<string>")
    score = F.array_max(F.transform("severity", lambda s: V.cvss_base(s["score"])))
    fixes = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda g: F.transform(g["events"], lambda e: e["fixed"])))))
    fixes = F.array_distinct(F.filter(F.coalesce(fixes, none), lambda v: v.isNotNull() & ~V.is_commit_hash(v)))
    database = F.coalesce("database_specific.severity", F.get("affected", F.lit(0))["database_specific"]["severity"])
    first_line = F.trim(F.substring_index(F.coalesce("details", F.lit("")), "\n", 1))
    summary = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(first_line, F.lit("")), F.lit("No description was published."))
    every = F.concat(F.array("id"), F.coalesce("aliases", none))
    return row.select(
        "id", F.coalesce("aliases", none).alias("aliases"), summary.alias("summary"), score.alias("cvss_score"), database.alias("database_severity"),
        V.advisory_severity(score, database).alias("severity"), fixes.alias("fixed_versions"),
        F.coalesce(F.get(F.filter(every, lambda x: F.upper(x).startswith("CVE-")), F.lit(0)), F.col("id")).alias("cve_id"),
        F.try_to_timestamp("published").alias("published"), "affected",
    )


def affected_packages(parsed: DataFrame) -> DataFrame:
    """id, ecosystem, name, versions, introduced, fixed: a row for each range, and one for each list of versions."""
    one = parsed.select("id", F.explode("affected").alias("a"))
    listed = one.where(F.size("a.versions") > 0).select("id", "a.package.ecosystem", "a.package.name", F.col("a.versions").alias("versions"), F.lit(None).cast("string").alias("introduced"), F.lit(None).cast("string").alias("fixed"))
    ranges = one.select("id", "a.package.ecosystem", "a.package.name", F.explode("a.ranges").alias("g")).where("g.type <> 'GIT'")
    bounds = lambda c: F.get(F.filter(F.transform("g.events", lambda e: e[c]), lambda x: x.isNotNull()), F.lit(0))
    spans = ranges.select("id", "ecosystem", "name", F.lit(None).cast("array<string>").alias("versions"), bounds("introduced").alias("introduced"), bounds("fixed").alias("fixed"))
    return listed.unionByName(spans)


def _ancestors(rank: Column, top: Column) -> Column:
    """The nodes over a rank in a binary tree: (level, number) from the leaf up to the level `top`."""
    return F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", rank, level).alias("node")))


def _cover(low: Column, high: Column, top: Column) -> Column:
    """The fewest nodes that together hold the ranks from low up to, not with, high: at most two of each level."""
    size = lambda level: F.call_function("shiftleft", F.lit(1), level)
    first = lambda level: F.call_function("shiftright", low + size(level) - 1, level)
    end = lambda level: F.call_function("shiftright", high, level)
    node = lambda level, number, fits: F.when(fits & (first(level) < end(level)), F.struct(level.alias("level"), number.alias("node")))
    both = F.transform(F.sequence(F.lit(0), top), lambda level: F.array(node(level, first(level), first(level) % 2 == 1), node(level, end(level) - 1, end(level) % 2 == 1)))
    return F.array_compact(F.flatten(both))


def inside_ranges(points: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """group, at, range: every point that lies in a range of its group. points: group, at; ranges: group, range, low (null: from the beginning), high (null: to the end; not in the range).

    Distinct ends and points are numbered in each group; a range becomes the few nodes of a binary tree over the numbers that cover it, a point the nodes above
    it, and both meet by equality. Every hit is made once and nothing else is: the cost follows the hits, not the ranges times the points. `at`, low and high
    are of one orderable type; points without one are in no range; groups may not be null.
    """
    keys = points.where("at IS NOT NULL").select(*group, "at").distinct()
    ends = ranges.select(*group, F.explode(F.array("low", "high")).alias("at")).where("at IS NOT NULL")
    order = Window.partitionBy(*group).orderBy("at")  # distinct values of a group
    ranked = keys.unionByName(ends).distinct().withColumn("rank", F.row_number().over(order) - 1)
    sizes = ranked.groupBy(*group).agg((F.max("rank") + 1).alias("n")).withColumn("top", F.ceil(F.log2(F.col("n"))).cast("int"))
    low, high = (ranked.select(*group, F.col("at").alias(c), F.col("rank").alias(f"{c}_rank")) for c in ("low", "high"))
    placed = ranges.select(*group, "range", "low", "high").join(sizes, group).join(low, [*group, "low"], "left").join(high, [*group, "high"], "left")
    spans = placed.select(*group, "range", F.explode(_cover(F.coalesce("low_rank", F.lit(0)), F.coalesce("high_rank", F.col("n")), F.col("top"))).alias("t"))
    over = keys.join(ranked, [*group, "at"]).join(sizes, group).select(*group, "at", F.explode(_ancestors(F.col("rank"), F.col("top"))).alias("t"))
    return over.join(spans, [*group, "t"]).select(*group, "at", "range").distinct()


def lookup_in_order(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """artifact_id, coordinate, id: dependencies that a list of versions names or that lie in a range. Versions meet lists by equality and ranges by `inside_ranges`, each version of a package once.

    For packages with many versions and ranges. It reads both sides several times, so store them first when they are dear to make; `lookup` reads them once.
    """
    group = ["_e", "_n"]
    key = [F.lower("ecosystem").alias("_e"), F.lower("name").alias("_n")]
    left = dependencies.select("artifact_id", "coordinate", "version", *key).where("_e IS NOT NULL AND _n IS NOT NULL")
    right = packages.select("id", "versions", "introduced", "fixed", *key)
    listed = right.where("versions IS NOT NULL").select(*group, "id", F.explode("versions").alias("version")).distinct()
    by_list = left.join(listed, [*group, "version"]).select("artifact_id", "coordinate", "id")
    # Without a beginning, or from 0, a range begins with everything; an end that is no version ends it nowhere.
    begins = F.when(F.col("introduced") != "0", V.semver_key(F.col("introduced")))
    known = F.col("introduced").isNull() | (F.col("introduced") == "0") | begins.isNotNull()
    ends = V.semver_key(F.col("fixed"))
    spans = right.where("versions IS NULL").where(known & (F.col("fixed").isNull() | ends.isNotNull())).select(*group, F.col("id").alias("range"), begins.alias("low"), ends.alias("high")).distinct()
    keyed = left.withColumn("at", V.semver_key(F.col("version")))
    # A version that cannot be ordered is only in ranges without ends.
    endless = spans.where("low IS NULL AND high IS NULL").select(*group, F.col("range").alias("id"))
    odd = keyed.where("at IS NULL").join(endless, group).select("artifact_id", "coordinate", "id")
    hit = inside_ranges(keyed.select(*group, "at"), spans, group)
    by_range = keyed.join(hit, [*group, "at"]).select("artifact_id", "coordinate", F.col("range").alias("id"))
    return by_list.union(by_range).union(odd).distinct()


def lookup(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """artifact_id, coordinate, id: dependencies that a list of versions names or that lie in a range. One equi-join by package, in which all its versions meet all its ranges."""
    key = [F.lower("ecosystem").alias("_e"), F.lower("name").alias("_n")]
    left = dependencies.select("artifact_id", "coordinate", "version", *key)
    right = packages.select("id", "versions", "introduced", "fixed", *key)
    at, low, high = (V.semver_key(F.col(c)) for c in ("version", "introduced", "fixed"))
    inside = (F.col("introduced").isNull() | (F.col("introduced") == "0") | (at >= low)) & (F.col("fixed").isNull() | (at < high))
    hit = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)) | (F.col("versions").isNull() & F.coalesce(inside, F.lit(False)))
    return left.join(right, ["_e", "_n"]).where(hit).select("artifact_id", "coordinate", "id").distinct()


def with_details(found: DataFrame, parsed: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs with their advisory (ids without regard to case), and the ids that have none as notes."""
    named = found.withColumn("_id", F.lower("id"))
    some = named
    if most:
        ids = named.select("_id").distinct().orderBy("_id").limit(most)  # the documented bound of one lookup
        some = named.join(ids, "_id", "left_semi")
    details = parsed.withColumn("_id", F.lower("id")).withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("id"))).where("_n = 1").drop("id", "_n")
    hits = some.join(details, "_id").drop("_id")
    missed = named.join(details.select("_id"), "_id", "left_anti").select("artifact_id", F.concat(F.lit("No details for "), "id").alias("note")).distinct()
    return hits, missed


def by_package(hits: DataFrame) -> DataFrame:
    """Per coordinate: distinct advisories, worst severity, CVE ids (the first 12) and fixed versions (the first 8)."""
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("artifact_id", "coordinate", F.lower("id")).orderBy("id"))).where("_n = 1")
    rows = one.groupBy("artifact_id", "coordinate").agg(
        F.count("*").alias("n_advisories"), F.max("severity").alias("severity"),
        F.array_sort(F.collect_set("cve_id")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fixed_versions")))).alias("fixes"),
    )
    return rows.select("artifact_id", "coordinate", "n_advisories", "severity", F.slice("ids", 1, MOST_IDS).alias("ids"), F.slice("fixes", 1, MOST_FIXES).alias("fixed_versions"))


def vulnerability_findings(grouped: DataFrame) -> DataFrame:
    """VC-DEP-001, one for each coordinate, by severity and coordinate."""
    return grouped.select(
        "artifact_id", F.lit("VC-DEP-001").alias("rule_id"), F.concat(F.lit("Known weaknesses in "), "coordinate").alias("title"), F.lit("Dependencies").alias("category"), F.lit(1).alias("category_ord"),
        "severity", F.col("severity").alias("user_severity"), F.lit(False).alias("is_blocking"), F.lit(False).alias("is_capability"), F.lit(None).cast("string").alias("capability"),
        F.lit("Rule").alias("source"), F.lit(None).cast("string").alias("explained_by"), F.array_join("ids", ", ").alias("evidence"),
    )


def ordered_matches(grouped: DataFrame) -> DataFrame:
    return grouped.orderBy("artifact_id", F.desc("severity"), "coordinate")


def age_in_days(as_of: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(now, as_of))
