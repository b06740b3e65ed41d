"""Dependencies from manifests: one parser for each format, all from (artifact_id, file_ord, path, content).

Parsers give ecosystem, name, version, declared_in and pos (the order within the file). Malformed files give no rows and
a note. Nulls in a name or version drop the row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quarryscan.functions import paths as P
from quarryscan.functions import versions as V

# Fixed value: dependencies of an artifact, checked before each file.
MOST = 5_000
#: Levels of a nested npm tree.
DEPTH = 32
_PAIR = "array<struct<name:string,version:string>>"


def _json(schema: str) -> Column:
    return F.from_json("content", schema)


def _pairs(entries: Column, name: Callable[[Column], Column], version: Callable[[Column], Column]) -> Column:
    return F.transform(entries, lambda e: F.struct(name(e).alias("name"), version(e).alias("version")))


def _found(pattern: str, name: int = 1, version: int = 2, source: Column | None = None) -> Column:
    """Matches of a pattern as pairs of its groups."""
    hits = F.regexp_extract_all(F.col("content") if source is None else source, F.lit(pattern), F.lit(0))
    return _pairs(hits, lambda m: F.regexp_extract(m, pattern, name), lambda m: F.regexp_extract(m, pattern, version))


def _before_last_slash(key: Column) -> Column:
    return F.regexp_extract(key, r"\A(.*)/[^/]*\z", 1)


def deps_json() -> Column:
    libraries = F.map_entries(_json("libraries map<string,struct<type:string>>")["libraries"])
    packages = F.filter(libraries, lambda e: F.lower(e["value"]["type"]) == "package")
    return _pairs(packages, lambda e: _before_last_slash(e["key"]), lambda e: F.substring_index(e["key"], "/", -1))


def nuget_lock() -> Column:
    frameworks = F.map_values(_json("dependencies map<string,map<string,struct<resolved:string>>>")["dependencies"])
    return _pairs(F.flatten(F.transform(frameworks, F.map_entries)), lambda e: e["key"], lambda e: e["value"]["resolved"])


def npm_lock() -> Column:
    """Lock files of versions 2 and 3, the name after the last node_modules/."""
    entries = F.map_entries(_json("packages map<string,struct<version:string>>")["packages"])
    return _pairs(F.filter(entries, lambda e: e["key"].contains("node_modules/")), lambda e: F.regexp_extract(e["key"], r"(?:\A|/)node_modules/((?:@[^/]+/)?[^/]+)\z", 1), lambda e: e["value"]["version"])


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("version", StringType())])))
def _npm_tree(contents: pd.Series) -> pd.Series:
    """Lock files of version 1: a nested tree of dependencies."""
    import json

    def walk(node: object, depth: int) -> list[dict]:
        tree = node.get("dependencies") if isinstance(node, dict) and depth < DEPTH else None
        if not isinstance(tree, dict):
            return []
        out = []
        for name, child in tree.items():
            version = child.get("version") if isinstance(child, dict) else None
            if isinstance(version, str):
                out.append({"name": name, "version": version})
            out += walk(child, depth + 1)
        return out

    def read(text: str | None) -> list[dict]:
        try:
            whole = json.loads(text or "")
        except (ValueError, RecursionError):
            return []
        return [] if isinstance(whole, dict) and "packages" in whole else walk(whole, 0)

    return contents.map(read)


def vendored_package() -> Column:
    """A package inside node_modules whose folder is its name, with an exact version."""
    row = _json("name string, version string")
    folder = F.regexp_extract(P.slashed(F.col("path")), r"(?:\A|/)node_modules/((?:@[^/]+/)?[^/]+)/package\.json\z", 1)
    return F.when((row["name"] == folder) & (folder != "") & V.is_exact_version(row["version"]), F.array(row.cast("struct<name:string,version:string>")))


def pipfile_lock() -> Column:
    row = _json("default map<string,struct<version:string>>, develop map<string,struct<version:string>>")
    none = F.array().cast("array<struct<key:string,value:struct<version:string>>>")
    entries = F.concat(F.coalesce(F.map_entries(row["default"]), none), F.coalesce(F.map_entries(row["develop"]), none))
    return _pairs(F.filter(entries, lambda e: e["value"]["version"].startswith("==")), lambda e: e["key"], lambda e: F.substring(e["value"]["version"], 3, 10_000))


def composer_lock() -> Column:
    row = _json("packages array<struct<name:string,version:string>>, `packages-dev` array<struct<name:string,version:string>>")
    none = F.array().cast(_PAIR)
    return F.concat(F.coalesce(row["packages"], none), F.coalesce(row["packages-dev"], none))


def pnpm_lock() -> Column:
    """Keys of the packages section at two blanks, in four spellings; peer suffixes are cut."""
    section = F.regexp_extract("content", r"(?ms)^packages:[^\n]*\n(.*?)(?=^\S|\z)", 1)
    return _found(r"(?m)^\x20\x20['\"]?/?((?:@[^/\s'\"]+/)?[^@/\s'\":()]+)[@/]([0-9][^\s'\":()_]*)[^\n:]*['\"]?:", source=section)


#: Parser by lower-case file name: ecosystem and pairs. A deps.json goes by its ending, package.json by its folder.
PARSERS: dict[str, tuple[str, Callable[[], Column]]] = {
    "*.deps.json": ("NuGet", deps_json),
    "packages.lock.json": ("NuGet", nuget_lock),
    "package-lock.json": ("npm", npm_lock),
    "package.json": ("npm", vendored_package),
    "requirements.txt": ("PyPI", lambda: _found(r"(?m)^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]\n]*\])?\s*==\s*([^\s;#,]+)")),
    "pipfile.lock": ("PyPI", pipfile_lock),
    "yarn.lock": ("npm", lambda: _found(r"(?m)^\"?((?:@[^/\"\s]+/)?[^@\"\s#][^@\"\s]*)@[^\n]*:\x20*\r?\n(?:\x20{2,}(?!version)[^\n]*\n)*\x20{2}version:?\x20\"?([0-9][^\"\s]*)\"?")),
    "pnpm-lock.yaml": ("npm", pnpm_lock),
    "go.sum": ("Go", lambda: _found(r"(?m)^(\S+)\x20v([^\s/]+)\x20h1:")),
    "cargo.lock": ("crates.io", lambda: _found(r"(?m)^\[\[package\]\]\s*\n(?:(?!\[|name)[^\n]*\n)*name\s*=\s*\"([^\"]+)\"\s*\n(?:(?!\[|version)[^\n]*\n)*version\s*=\s*\"([^\"]+)\"")),
    "poetry.lock": ("PyPI", lambda: _found(r"(?m)^\[\[package\]\]\s*\n(?:(?!\[|name)[^\n]*\n)*name\s*=\s*\"([^\"]+)\"\s*\n(?:(?!\[|version)[^\n]*\n)*version\s*=\s*\"([^\"]+)\"")),
    "composer.lock": ("Packagist", composer_lock),
    "gemfile.lock": ("RubyGems", lambda: _found(r"(?m)^\x20{4}([A-Za-z0-9_.-]+)\x20\(([^)\n]+)\)\s*$")),
    "gradle.lockfile": ("Maven", lambda: _found(r"(?m)^([^:=#\s]+:[^:=\s]+):([^:=\s]+)=")),
}


def _name_is(key: str) -> Column:
    low = F.lower(P.basename(F.col("path")))
    return low.endswith(key[1:]) if key.startswith("*") else low == key


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """artifact_id, file_ord, declared_in, pos, ecosystem, name, version of every entry with an exact version."""
    files = manifests.where(P.is_manifest(F.col("path")))
    read = None
    for key, (ecosystem, parser) in PARSERS.items():
        value = F.when(_name_is(key), F.struct(F.lit(ecosystem).alias("ecosystem"), parser().cast(_PAIR).alias("pairs")))
        read = value if read is None else F.coalesce(read, value)
    rows = files.withColumn("_r", read).select(*files.columns, "_r.*").select("artifact_id", "file_ord", F.col("path").alias("declared_in"), "ecosystem", F.posexplode("pairs").alias("pos", "e"))
    old = files.where(_name_is("package-lock.json")).select("artifact_id", "file_ord", F.col("path").alias("declared_in"), F.lit("npm").alias("ecosystem"), F.posexplode(_npm_tree("content")).alias("pos", "e"))
    out = rows.union(old).select("artifact_id", "file_ord", "declared_in", "pos", "ecosystem", F.col("e.name").alias("name"), V.normalise_version(F.col("e.version")).alias("version"))
    return out.where((F.col("name") != "") & F.col("version").rlike(r"\A[0-9]"))


def coordinate() -> Column:
    return F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version")


def inventory(manifests: DataFrame, most: int = MOST) -> DataFrame:
    """Dependencies of each artifact, the first of each coordinate (without regard to case), by coordinate.

    The limit is looked at before each file: a file that begins below it is read whole.
    """
    rows = manifest_rows(manifests).withColumn("coordinate", coordinate())
    own = Window.partitionBy("artifact_id", F.lower("coordinate")).orderBy("file_ord", "pos", "coordinate")
    one = rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    per_file = one.groupBy("artifact_id", "file_ord").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("artifact_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1))
    open_ = per_file.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("artifact_id", "file_ord")
    return one.join(open_, ["artifact_id", "file_ord"], "left_semi").select("artifact_id", "coordinate", "ecosystem", "name", "version", "declared_in")


def unresolved(manifests: DataFrame) -> DataFrame:
    """Manifests that name dependencies only by ranges: a package.json outside node_modules, unpinned requirements."""
    root = (F.lower(P.basename(F.col("path"))) == "package.json") & ~P.slashed(F.col("path")).rlike(r"(?:\A|/)node_modules/")
    row = _json("dependencies map<string,string>, devDependencies map<string,string>")
    named = (F.coalesce(F.size(row["dependencies"]), F.lit(0)) > 0) | (F.coalesce(F.size(row["devDependencies"]), F.lit(0)) > 0)
    loose = (F.lower(P.basename(F.col("path"))) == "requirements.txt") & F.col("content").rlike(r"(?m)^\s*[A-Za-z][\w.-]*\s*(?:\[[^\]\n]*\])?\s*(?:$|[<>~!]|#)")
    return manifests.where((root & named) | loose).select("artifact_id", "file_ord", F.col("path").alias("declared_in"))


def malformed(manifests: DataFrame) -> DataFrame:
    """JSON manifests that can't be read."""
    low = F.lower(P.basename(F.col("path")))
    json_like = P.is_manifest(F.col("path")) & (low.endswith(".json") | low.isin("pipfile.lock", "composer.lock"))
    return manifests.where(json_like & F.try_parse_json("content").isNull()).select("artifact_id", "file_ord", F.concat(F.col("path"), F.lit(" could not be read")).alias("note"))
