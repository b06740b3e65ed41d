"""Checks of a folder's listing and of its binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryscan.functions import paths as P
from quarryscan.sources import artifacts as A

from .rulebook import CATEGORIES

# Paths looked at, names listed, and names of a program that decide whether it is obfuscated.
MOST_PATHS, MOST_NAMES, LEAST_NAMES, SHARE = 50_000, 6, 20, 0.6
# Prefixes of assemblies that belong to the framework.
FRAMEWORK = ("System.", "Microsoft.", "Windows.", "PresentationFramework", "PresentationCore", "PresentationUI", "PresentationBuildTasks", "WindowsBase", "mscorlib", "netstandard", "hostfxr", "hostpolicy", "clr", "coreclr")


def _rows(df: DataFrame, rule: str, title: str, category: str, severity: int, user: int, evidence: Column) -> DataFrame:
    return df.select(
        "artifact_id", F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit(category).alias("category"), F.lit(CATEGORIES.index(category)).alias("category_ord"),
        F.lit(severity).alias("severity"), F.lit(user).alias("user_severity"), F.lit(False).alias("is_blocking"), F.lit(False).alias("is_capability"), F.lit(None).cast("string").alias("capability"),
        F.lit("Rule").alias("source"), F.lit(None).cast("string").alias("explained_by"), "path", evidence.alias("evidence"),
    )


def _checks() -> list[tuple[str, str, str, int, int, Column]]:
    low, name = F.lower("path"), F.lower(P.basename(F.col("path")))
    return [
        ("VC-PKG-001", "Debug symbols are shipped", "BinaryHygiene", 1, 0, low.endswith(".pdb")),
        ("VC-PKG-002", "A settings file with credentials is shipped", "Secrets", 3, 1, name.startswith(".env") & ~low.endswith(".example") & ~low.endswith(".sample")),
        ("VC-PKG-003", "Source maps are shipped", "BinaryHygiene", 1, 0, low.endswith(".js.map")),
        ("VC-PKG-004", "The version history is shipped", "Secrets", 3, 0, P.slashed(F.col("path")).contains("/.git/")),
    ]


def packaging(listing: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """VC-PKG-001 to 004: the first path and how many there are. Build folders don't count; paths beyond `most` of an artifact are not looked at."""
    some = listing.where(F.col("file_ord") < most).where(~P.is_build_scratch(F.col("path")))
    checks = _checks()
    sums = some.groupBy("artifact_id").agg(*[x for i, c in enumerate(checks) for x in (F.sum(c[5].cast("long")).alias(f"n{i}"), F.min_by(F.when(c[5], F.col("path")), F.when(c[5], F.col("file_ord"))).alias(f"p{i}"))])
    out = None
    for i, (rule, title, category, severity, user, _) in enumerate(checks):
        rows = _rows(sums.where(f"n{i} > 0").withColumn("path", F.col(f"p{i}")), rule, title, category, severity, user, F.concat(F.col(f"n{i}").cast("string"), F.lit(" files")))
        out = rows if out is None else out.unionByName(rows)
    return out


def binary_flags(binaries: DataFrame) -> DataFrame:
    """VC-BIN-010 to 012 from (artifact_id, path, data): unsigned, no address randomisation, executable data."""
    rows = binaries.withColumn("f", A.pe_flags(F.col("data"))).where("f is not null")
    unsigned = _rows(rows.where(~F.col("f.signed")), "VC-BIN-010", "The program is not signed", "BinaryHygiene", 0, 1, F.lit(None).cast("string"))
    aslr = _rows(rows.where(~F.col("f.aslr")), "VC-BIN-011", "Address randomisation is off", "BinaryHygiene", 1, 1, F.lit(None).cast("string"))
    nx = _rows(rows.where(~F.col("f.nx")), "VC-BIN-012", "Data may be executed", "BinaryHygiene", 1, 1, F.lit(None).cast("string"))
    return unsigned.unionByName(aslr).unionByName(nx)


def owned(assemblies: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Assemblies that are the application's own: no framework prefix and, where known, named by a project of its deps.json."""
    name = F.col("assembly")
    known = name.startswith(FRAMEWORK[0])
    for p in FRAMEWORK[1:]:
        known = known | name.startswith(p)
    rows = assemblies.where(~known)
    if projects is None:
        return rows
    stated = rows.join(projects.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return stated.unionByName(rows.join(projects.select("artifact_id", "assembly").distinct(), ["artifact_id", "assembly"], "left_semi"))


def unnamed(assemblies: DataFrame) -> DataFrame:
    """VC-BIN-001: assemblies (artifact_id, assembly, strong_named) without a strong name, one row for each artifact with the first six names."""
    rows = assemblies.where(~F.col("strong_named")).groupBy("artifact_id").agg(F.array_sort(F.collect_set("assembly")).alias("a"))
    listed = F.concat(F.array_join(F.slice("a", 1, MOST_NAMES), ", "), F.when(F.size("a") > MOST_NAMES, F.concat(F.lit(" and "), (F.size("a") - MOST_NAMES).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return _rows(rows.withColumn("path", F.when(F.size("a") == 1, F.get("a", F.lit(0)))), "VC-BIN-001", "Assemblies without a strong name", "BinaryHygiene", 1, 1, listed)


def obfuscated(names: DataFrame) -> DataFrame:
    """VC-BIN-002: programs (artifact_id, path, name) of at least twenty names, over 60 % of them short, with a # or outside ASCII."""
    odd = (F.length("name") <= 2) | F.col("name").contains("#") | F.col("name").rlike(r"[^\x00-\x7F]")
    rows = names.groupBy("artifact_id", "path").agg(F.count("*").alias("n"), F.sum(odd.cast("long")).alias("odd")).where((F.col("n") >= LEAST_NAMES) & (F.col("odd") > SHARE * F.col("n")))
    return _rows(rows, "VC-BIN-002", "The program's names are obfuscated", "BinaryHygiene", 2, 2, F.concat(F.col("odd").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" names")))


def decompile_coverage(types: DataFrame) -> DataFrame:
    """Coverage of a decompiled program: types recovered of types seen, in percent."""
    share = F.bround(100 * F.sum("recovered") / F.sum("seen")).cast("long")
    return types.groupBy("artifact_id").agg(F.when(F.sum("seen") > 0, F.least(F.lit(100), F.greatest(F.lit(0), share))).otherwise(F.lit(0)).cast("long").alias("coverage_percent"))
