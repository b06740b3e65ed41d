"""Manifests, advisories, versions and listings made from rows of the supplier and part tables, on both sides.

Formats need their own texts: each supplier is an artifact with one file of every format, in which `{k}` is its number. Versions, vectors, scores, advisories
and dependencies come from arithmetic on the keys of parts and suppliers. The texts are this project's own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import versions as V
from quarryscan.operators import advisories, dependencies, packaging, releases, scoring
from quarryscan.operators.rulebook import CAPABILITIES

from .common import table, values

LINES = [
    ("requirements.txt", "# pins\nrequests==2.{k}.1\nflask[async]==2.0.1 ; python_version > '3'\nnumpy>=1.2\n-r more.txt\n"),
    ("go.sum", "github.com/gin-gonic/gin v1.{k}.3 h1:abc=\ngithub.com/gin-gonic/gin v1.6.3/go.mod h1:def=\ngolang.org/x/text v0.3.2 h1:xyz=\n"),
    ("gradle.lockfile", "# comment\norg.apache.logging.log4j:log4j-core:2.{k}.1=runtimeClasspath\ncom.google.guava:guava:30.0-jre=compileClasspath\nempty=\n"),
    ("Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    nokogiri (1.{k}.4)\n      mini_portile2 (~> 2.4.0)\n    rake (13.0.1)\n\nDEPENDENCIES\n  rake\n"),
    ("Cargo.lock", "[[package]]\nname = \"smallvec\"\nversion = \"0.6.{k}\"\n\n[[package]]\nname = \"time\"\nversion = \"0.1.44\"\nsource = \"registry\"\n"),
    ("poetry.lock", "[[package]]\nname = \"jinja2\"\nversion = \"2.{k}.2\"\ndescription = \"x\"\n"),
    ("yarn.lock", "# yarn lockfile v1\n\nlodash@^4.17.20:\n  version \"4.{k}.21\"\n  resolved \"https://x\"\n\n\"@babel/core@^7.0.0\", \"@babel/core@^7.1.0\":\n  version \"7.14.0\"\n"),
    ("pnpm-lock.yaml", "lockfileVersion: '9.0'\n\npackages:\n  lodash@4.{k}.20:\n    resolution: {integrity: sha512-x}\n    dependencies:\n      something@1.0.0: {}\n  '@babel/core@7.14.0':\n    resolution: {}\n  /react-dom@18.2.0(react@18.2.0):\n    resolution: {}\n\nsnapshots:\n  lodash@4.17.21: {}\n"),
]
JSONS = [
    ("package-lock.json", json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "1.0.0"}, "node_modules/lodash": {"version": "4.{k}.20"}, "node_modules/a/node_modules/@x/y": {"version": "1.2.3"}}})),
    ("Pipfile.lock", json.dumps({"default": {"requests": {"version": "==2.{k}.2"}, "urllib3": {"version": ">=1"}}, "develop": {"pytest": {"version": "==6.2.2"}, "own": {"git": "x"}}})),
    ("composer.lock", json.dumps({"packages": [{"name": "monolog/monolog", "version": "v2.{k}.0"}], "packages-dev": [{"name": "phpunit/phpunit", "version": "8.5.1"}]})),
    ("app.deps.json", json.dumps({"libraries": {"app/1.0.0": {"type": "project"}, "Newtonsoft.Json/12.{k}.1": {"type": "package"}, "Serilog/2.10.0": {"type": "package"}}})),
    ("packages.lock.json", json.dumps({"version": 1, "dependencies": {"net6.0": {"Dapper": {"type": "Direct", "resolved": "2.{k}.90"}, "Polly": {"type": "Direct", "resolved": "7.2.1"}}}})),
    ("node_modules/left-pad/package.json", json.dumps({"name": "left-pad", "version": "1.{k}.0"})),
    ("node_modules/other/package.json", json.dumps({"name": "renamed", "version": "1.0.0"})),
    ("broken/composer.lock", "{not json"),
]
LISTING = [(p.split("/")[0], i, p) for i, p in enumerate((
    "one/bin/Release/App{k}.pdb", "one/bin/Debug/App.pdb", "one/obj/App.pdb", "one/.env", "one/.env.example", "one/dist/app.js.map", "one/x/.git/config", "two/.git/config", "two/App.PDB", "two/.env.local", "two/readme.md", "three/a/.git/HEAD", "three/.env.sample",
))]


#: Texts of the files of every supplier, and their SQL.
def _spread(spark: SparkSession, sf_dir: str, rows: list[tuple], columns: str) -> DataFrame:
    """The rows once for each supplier: artifact_id is its name, {k} in texts its number."""
    names = columns.split(", ")
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("artifact_id"), F.col("s_suppkey").cast("string").alias("_k"), F.explode(each).alias("_r"))
    return suppliers.select("artifact_id", *[(F.replace(F.col(f"_r.{n}"), F.lit("{k}"), F.col("_k")) if isinstance(rows[0][i], str) else F.col(f"_r.{n}")).alias(n) for i, n in enumerate(names)])


def _spread_sql(rows: list[tuple], columns: str) -> str:
    names = columns.split(", ")
    return f"(SELECT s_name AS artifact_id, {', '.join(f"replace(v.{n}, '{{k}}', s_suppkey::VARCHAR) AS {n}" if isinstance(rows[0][i], str) else f'v.{n}' for i, n in enumerate(names))} FROM supplier CROSS JOIN {values(rows, columns)} v)"


def _manifests(spark: SparkSession, sf_dir: str, rows: list[tuple[str, str]]) -> DataFrame:
    return _spread(spark, sf_dir, [(i, p, c) for i, (p, c) in enumerate(rows)], "file_ord, path, content")


def manifest_line_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of manifests that are read line by line."""
    return dependencies.manifest_rows(_manifests(spark, sf_dir, LINES)).select("artifact_id", "declared_in", "ecosystem", "name", "version")


def manifest_json_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of JSON manifests; what can't be read gives no row."""
    return dependencies.manifest_rows(_manifests(spark, sf_dir, JSONS)).select("artifact_id", "declared_in", "ecosystem", "name", "version")


def dependency_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each coordinate of an artifact, the first manifest's."""
    return dependencies.inventory(_manifests(spark, sf_dir, LINES + JSONS)).select("artifact_id", "coordinate", "declared_in")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))


#: Values of the metrics of a vector (one of each that doesn't exist), picked by a part's key; by it one is of another version and one lacks its end.
_METRICS = (("AV", "NALPX"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "HLN"), ("A", "HLN"))


def _vector(pick, concat):
    parts, step = [], 1
    for name, letters in _METRICS:
        parts.append((name, letters, step))
        step *= len(letters)
    return concat([x for name, letters, step in parts for x in (f"/{name}:", pick(letters, step))])


def _vectors(rows: DataFrame) -> DataFrame:
    key = F.col("k") * 17 + F.col("p_size")
    pick = lambda letters, step: F.substring(F.lit(letters), (F.floor(key / step) % len(letters) + 1).cast("int"), F.lit(1))
    text = _vector(pick, lambda xs: F.concat(F.when(F.col("k") % 19 == 0, "CVSS:2.0").when(F.col("k") % 2 == 0, "CVSS:3.0").otherwise("CVSS:3.1"), *[F.lit(x) if isinstance(x, str) else x for x in xs]))
    return rows.withColumn("vector", F.when(F.col("k") % 23 == 0, F.substring(text, F.lit(1), F.lit(24))).otherwise(text))


def _vectors_sql(source: str, key: str, k: str) -> str:
    pick = lambda letters, step: f"substring('{letters}', ({key} // {step} % {len(letters)} + 1)::INT, 1)"
    text = _vector(pick, lambda xs: f"CASE WHEN {k} % 19 = 0 THEN 'CVSS:2.0' WHEN {k} % 2 = 0 THEN 'CVSS:3.0' ELSE 'CVSS:3.1' END || " + " || ".join(f"'{x}'" if x.startswith("/") else x for x in xs))
    return f"(SELECT *, {k} AS k, CASE WHEN {k} % 23 = 0 THEN substring({text}, 1, 24) ELSE {text} END AS vector FROM {source})"


def cvss_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score of a vector for each part."""
    return _vectors(_parts(spark, sf_dir)).select("p_partkey", "vector", V.cvss_base(F.col("vector")).alias("score"))


_WORDS = (None, "LOW", "moderate", "HIGH", "Critical", "odd")


def _word(key: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in _WORDS]), (key % len(_WORDS)).cast("int"))


def advisory_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity by a score (every eleventh part has none), else by the word of a database."""
    rows = _parts(spark, sf_dir).select("p_partkey", F.when(F.col("k") % 11 > 0, F.col("k") % 101 / 10.0).alias("score"), _word(F.col("k")).alias("word"))
    return rows.select("p_partkey", "score", "word", V.advisory_severity(F.col("score"), F.col("word")).alias("severity"))


def _dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An advisory as JSON text for each supplier, some without an id, score, range or summary, and texts that are none."""
    rows = table(spark, sf_dir, "supplier").withColumns({"k": F.col("s_suppkey"), "p_size": F.col("s_nationkey").cast("long")})
    k = F.col("k")
    rows = _vectors(rows).withColumns({"low": F.when(k % 5 == 0, F.lit("0")).otherwise(_dotted(k % 9, k % 7, k % 2)), "high": F.when(k % 13 > 0, _dotted(k % 9 + k % 3 + 1, k % 5, k * 0))})
    package = F.struct(F.when(k % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("PKG"), (k % 25).cast("string")).alias("name"))
    events = F.array_compact(F.array(F.struct(F.col("low").alias("introduced"), F.lit(None).cast("string").alias("fixed")), F.when(F.col("high").isNotNull(), F.struct(F.lit(None).cast("string").alias("introduced"), F.col("high").alias("fixed")))))
    ranges = F.array(F.struct(F.when(k % 6 == 0, "GIT").otherwise("SEMVER").alias("type"), events.alias("events")))
    affected = F.array(F.struct(package.alias("package"), F.when(k % 4 == 0, F.array(_dotted(k % 11, k % 7, k % 3), F.lit("9.9.9"))).alias("versions"), ranges.alias("ranges")))
    record = F.struct(
        F.when(k % 17 > 0, F.concat(F.lit("ADV-"), k.cast("string"))).alias("id"), F.when(k % 2 == 0, F.array(F.concat(F.lit("CVE-2020-"), k.cast("string")))).alias("aliases"),
        F.when(k % 3 > 0, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.col("vector").alias("score")))).alias("severity"), F.struct(_word(k).alias("severity")).alias("database_specific"), affected.alias("affected"),
    )
    return rows.select(F.when(k % 29 == 1, F.lit("{broken")).otherwise(F.to_json(record)).alias("record"))


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Advisories of every coordinate, each looked up once, whatever the artifacts that have it; and the artifacts (artifact_id, coordinate)."""
    parsed = advisories.parse(_records(spark, sf_dir))
    k = F.col("k")
    version = F.concat(_dotted(k % 11, F.col("p_size") % 7, k % 3), F.when(k % 17 == 0, "-rc.1").otherwise(""))
    deps = _parts(spark, sf_dir).select(F.col("p_brand").alias("artifact_id"), F.when(k % 4 < 2, "npm").otherwise("PyPI").alias("ecosystem"), F.concat(F.lit("pkg"), (k % 25).cast("string")).alias("name"), version.alias("version"))
    # A coordinate tells ecosystem, name and version.
    deps = deps.withColumn("coordinate", dependencies.coordinate()).distinct()
    once = deps.drop("artifact_id").distinct().withColumn("artifact_id", F.lit("any"))
    found = advisories.with_details(advisories.lookup_in_order(once, advisories.affected_packages(parsed)), parsed)[0]
    return found, deps.select("artifact_id", "coordinate")


def vulnerable_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies and the advisories whose list or range they are in."""
    found, owners = _hits(spark, sf_dir)
    return found.select("coordinate", "id", "severity").join(owners, "coordinate").select("artifact_id", "coordinate", "id", "severity")


def vuln_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per coordinate: advisories, worst severity, identifiers and fixes."""
    found, owners = _hits(spark, sf_dir)
    rows = advisories.by_package(found).drop("artifact_id").join(owners, "coordinate")
    return rows.select("artifact_id", "coordinate", "n_advisories", "severity", F.array_join("ids", ",").alias("ids"), F.array_join("fixed_versions", ",").alias("fixed_versions"))


#: Ends of tags, picked by a part's key.
_ENDS = ("", "-beta", "-rc.2", "-rc.10", "-alpha", "-alpha.1", "+build.7", ".4", "-")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    end = F.get(F.array(*[F.lit(e) for e in _ENDS]), (k % len(_ENDS)).cast("int"))
    return _parts(spark, sf_dir).select("p_brand", F.concat(F.when(k % 2 == 0, "v").otherwise(""), _dotted(k % 3, F.col("p_size") % 12, k % 5), end).alias("tag")).distinct()


def semver_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's versions in order; texts that are none have no place."""
    rows = _tags(spark, sf_dir).withColumn("key", V.semver_key(F.col("tag"))).where("key is not null")
    return rows.select("p_brand", "tag", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "tag")).cast("long").alias("place"))


def newest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release of all parts above 0.1.5."""
    return releases.newest(_tags(spark, sf_dir).select("tag").distinct(), "0.1.5")


def packaging_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug symbols, settings files, source maps and version history in listings."""
    listing = _spread(spark, sf_dir, LISTING, "folder, file_ord, path").withColumn("artifact_id", F.concat_ws("/", "artifact_id", "folder"))
    return packaging.packaging(listing.drop("folder")).select("artifact_id", "rule_id", "path", "evidence", "severity", "user_severity")


_KINDS = (*scoring.EXPECTED, "other")


def expected_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kind of application is expected to do; suppliers have kinds in turn."""
    kind = F.get(F.array(*[F.lit(x) for x in _KINDS]), (F.col("s_suppkey") % len(_KINDS)).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"))
    return rows.select("s_suppkey", "kind", F.array_join(scoring.expected(F.col("kind")), ",").alias("capabilities"), F.size(scoring.expected(F.col("kind"))).cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    manifest_line_formats, manifest_json_formats, dependency_inventory, cvss_base, advisory_severity, vulnerable_dependencies, vuln_by_package, semver_latest, newest_release, packaging_checks, expected_capabilities,
)}
_LINE_SQL = {
    "requirements.txt": ("PyPI", r"(?m)^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]\n]*\])?\s*==\s*([^\s;#,]+)"),
    "go.sum": ("Go", r"(?m)^(\S+) v([^\s/]+) h1:"),
    "gradle.lockfile": ("Maven", r"(?m)^([^:=#\s]+:[^:=\s]+):([^:=\s]+)="),
    "Gemfile.lock": ("RubyGems", r"(?m)^ {4}([A-Za-z0-9_.-]+) \(([^)\n]+)\)\s*$"),
    "Cargo.lock": ("crates.io", r'\[\[package\]\]\nname = "([^"]+)"\nversion = "([^"]+)"'),
    "poetry.lock": ("PyPI", r'\[\[package\]\]\nname = "([^"]+)"\nversion = "([^"]+)"'),
    "yarn.lock": ("npm", r'(?m)^"?((?:@[^/"\s]+/)?[^@"\s#]+)@[^\n]*:\n  version "([^"]+)"'),
    "pnpm-lock.yaml": ("npm", r"(?m)^  ['\"]?/?((?:@[^/\s'\"]+/)?[^@/\s'\":()]+)@([0-9][^\s'\":()]*)"),
}


def _lines_sql() -> str:
    parts = []
    for path, content in LINES:
        ecosystem, p = _LINE_SQL[path]
        text = "split_part(content, chr(10) || 'snapshots:', 1)" if path == "pnpm-lock.yaml" else "content"
        p = p.replace("'", "''")
        parts.append(f"SELECT artifact_id, path AS declared_in, '{ecosystem}' AS ecosystem, unnest(regexp_extract_all({text}, '{p}', 1)) AS name, unnest(regexp_extract_all({text}, '{p}', 2)) AS version FROM m WHERE path = '{path}'")
    return f"SELECT * FROM (WITH m AS {_spread_sql(LINES, 'path, content')} {' UNION ALL '.join(parts)})"


def _jsons_sql() -> str:
    return f"""SELECT artifact_id, declared_in, ecosystem, name, regexp_replace(version, '^v', '') AS version FROM (WITH m AS (SELECT artifact_id, path, content::JSON AS j FROM {_spread_sql([r for r in JSONS if not r[0].startswith('broken')], 'path, content')})
  SELECT artifact_id, path AS declared_in, 'npm' AS ecosystem, regexp_extract(k, 'node_modules/((?:@[^/]+/)?[^/]+)$', 1) AS name, j->'packages'->k->>'version' AS version FROM (SELECT *, unnest(json_keys(j->'packages')) AS k FROM m WHERE path = 'package-lock.json') WHERE contains(k, 'node_modules/')
  UNION ALL SELECT artifact_id, path, 'PyPI', k, substr(j->s->k->>'version', 3) FROM (SELECT *, unnest(json_keys(j->s)) AS k FROM (SELECT *, unnest(['default', 'develop']) AS s FROM m WHERE path = 'Pipfile.lock')) WHERE (j->s->k->>'version') LIKE '==%'
  UNION ALL SELECT artifact_id, path, 'Packagist', p->>'name', p->>'version' FROM (SELECT artifact_id, path, unnest(from_json(json_extract(j, s), '["JSON"]')) AS p FROM (SELECT *, unnest(['$.packages', '$."packages-dev"']) AS s FROM m WHERE path = 'composer.lock'))
  UNION ALL SELECT artifact_id, path, 'NuGet', split_part(k, '/', 1), split_part(k, '/', 2) FROM (SELECT *, unnest(json_keys(j->'libraries')) AS k FROM m WHERE path = 'app.deps.json') WHERE (j->'libraries'->k->>'type') = 'package'
  UNION ALL SELECT artifact_id, path, 'NuGet', k, j->'dependencies'->f->k->>'resolved' FROM (SELECT *, unnest(json_keys(j->'dependencies'->f)) AS k FROM (SELECT *, unnest(json_keys(j->'dependencies')) AS f FROM m WHERE path = 'packages.lock.json'))
  UNION ALL SELECT artifact_id, path, 'npm', j->>'name', j->>'version' FROM m WHERE path LIKE 'node_modules/%/package.json' AND path = 'node_modules/' || (j->>'name') || '/package.json')"""


def _metric(name: str) -> str:
    return f"regexp_extract(vector, '(?:^|/){name}:([A-Z])(?:/|$)', 1)"


def _cvss_sql(source: str, columns: str) -> str:
    weight = lambda name, table: f"CASE {_metric(name)} {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in table.items())} END"
    w = {n: f"({weight(n, t)})::DOUBLE" for n, t in V.CVSS.items()}
    pr = f"(CASE {_metric('S')} WHEN 'C' THEN {weight('PR', V.CVSS_PRIVILEGES['C'])} WHEN 'U' THEN {weight('PR', V.CVSS_PRIVILEGES['U'])} END)::DOUBLE"
    return f"""(WITH a AS (SELECT *, {_metric('S')} = 'C' AS changed, 1 - (1 - {w['C']}) * (1 - {w['I']}) * (1 - {w['A']}) AS iss, 8.22 * {w['AV']} * {w['AC']} * {pr} * {w['UI']} AS ease FROM {source}),
  b AS (SELECT *, CASE WHEN changed THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact FROM a),
  c AS (SELECT *, round(least(10, CASE WHEN changed THEN 1.08 * (impact + ease) ELSE impact + ease END) * 100000)::BIGINT AS n FROM b)
  SELECT {columns}, vector, CASE WHEN NOT regexp_matches(vector, '^CVSS:3\\.[01]/') OR impact + ease IS NULL THEN NULL WHEN impact <= 0 THEN 0 WHEN n % 10000 = 0 THEN n / 100000.0 ELSE (n // 10000 + 1) / 10.0 END::DOUBLE AS score FROM c)"""


_WORD_LIST = "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in _WORDS) + "]"
_WORDS_SQL = "CASE lower(word) WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'moderate' THEN 2 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_SEVERITY_SQL = f"CASE WHEN score >= 9 THEN 4 WHEN score >= 7 THEN 3 WHEN score >= 4 THEN 2 WHEN score > 0 THEN 1 ELSE coalesce({_WORDS_SQL}, 2) END"
#: Versions as lists of four numbers, the last telling releases from what comes before them.
_RANGES_SQL = f"""r AS (SELECT k, 'ADV-' || k AS id, CASE WHEN k % 2 = 0 THEN 'npm' ELSE 'PyPI' END AS ecosystem, 'pkg' || k % 25 AS name, score, ({_WORD_LIST})[k % 6 + 1] AS word, CASE WHEN k % 2 = 0 THEN 'CVE-2020-' || k ELSE 'ADV-' || k END AS cve,
    CASE WHEN k % 5 > 0 THEN [k % 9, k % 7, k % 2, 1] END AS low, CASE WHEN k % 13 > 0 THEN [k % 9 + k % 3 + 1, k % 5, 0, 1] END AS high, (k % 9 + k % 3 + 1) || '.' || k % 5 || '.0' AS fix
    FROM (SELECT k, CASE WHEN k % 3 > 0 THEN score END AS score FROM {_cvss_sql(_vectors_sql('supplier', '(s_suppkey * 17 + s_nationkey)', 's_suppkey'), 'k')}) WHERE k % 17 > 0 AND k % 29 <> 1),
  d AS (SELECT DISTINCT p_brand AS artifact_id, CASE WHEN p_partkey % 4 < 2 THEN 'npm' ELSE 'PyPI' END AS ecosystem, 'pkg' || p_partkey % 25 AS name, [p_partkey % 11, p_size % 7, p_partkey % 3, (p_partkey % 17 > 0)::INT] AS at,
    p_partkey % 11 || '.' || p_size % 7 || '.' || p_partkey % 3 || CASE WHEN p_partkey % 17 = 0 THEN '-rc.1' ELSE '' END AS version FROM part),
  h AS (SELECT d.artifact_id, d.ecosystem || ':' || d.name || '@' || d.version AS coordinate, r.id, {_SEVERITY_SQL} AS severity, r.cve, CASE WHEN r.high IS NOT NULL THEN r.fix END AS fix FROM d JOIN r ON r.ecosystem = d.ecosystem AND r.name = d.name
    WHERE (r.k % 4 = 0 AND (d.version = r.k % 11 || '.' || r.k % 7 || '.' || r.k % 3 OR d.version = '9.9.9')) OR (r.k % 6 > 0 AND (r.low IS NULL OR d.at >= r.low) AND (r.high IS NULL OR d.at < r.high)))"""
_SEMVER_SQL = f"""(SELECT p_brand, tag, list_transform(string_split(regexp_extract(tag, '^v?([0-9]+\\.[0-9]+\\.[0-9]+)', 1), '.'), lambda x: x::INT) AS core, regexp_extract(tag, '^v?[0-9]+\\.[0-9]+\\.[0-9]+(?:-([0-9A-Za-z.-]+))?', 1) AS pre
  FROM (SELECT DISTINCT p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || p_partkey % 3 || '.' || p_size % 12 || '.' || p_partkey % 5 || ({list(_ENDS)})[p_partkey % {len(_ENDS)} + 1] AS tag FROM part) WHERE regexp_matches(tag, '^v?[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?(\\+[0-9A-Za-z.-]+)?$'))"""
_SEMVER_KEY = "core, pre = '', list_transform(list_filter(string_split(pre, '.'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '0' || lpad(x, 18, '0') ELSE '1' || x END)"
_PACKAGING = f"""WITH l AS (SELECT artifact_id || '/' || folder AS artifact_id, file_ord, path FROM {_spread_sql(LISTING, 'folder, file_ord, path')} WHERE NOT regexp_matches(lower(path), '(^|/)(obj(/|$)|bin/debug(/|$))')),
  c AS (SELECT artifact_id, file_ord, path, 'VC-PKG-001' AS rule_id, 1 AS severity, 0 AS user_severity FROM l WHERE lower(path) LIKE '%.pdb'
    UNION ALL SELECT artifact_id, file_ord, path, 'VC-PKG-002', 3, 1 FROM l WHERE regexp_matches(lower(path), '(^|/)\\.env[^/]*$') AND lower(path) NOT LIKE '%.example' AND lower(path) NOT LIKE '%.sample'
    UNION ALL SELECT artifact_id, file_ord, path, 'VC-PKG-003', 1, 0 FROM l WHERE lower(path) LIKE '%.js.map' UNION ALL SELECT artifact_id, file_ord, path, 'VC-PKG-004', 3, 0 FROM l WHERE contains(path, '/.git/'))
  SELECT artifact_id, rule_id, arg_min(path, file_ord) AS path, count(*) || ' files' AS evidence, any_value(severity) AS severity, any_value(user_severity) AS user_severity FROM c GROUP BY 1, 2"""
ORACLE_SQL = {
    "manifest_line_formats": _lines_sql(),
    "manifest_json_formats": _jsons_sql(),
    "dependency_inventory": f"""WITH o AS {values([(p, i) for i, (p, _) in enumerate(LINES + JSONS)], 'declared_in, ord')}, r AS (SELECT *, ecosystem || ':' || name || '@' || version AS coordinate FROM ({_lines_sql()} UNION ALL {_jsons_sql()}))
  SELECT artifact_id, coordinate, declared_in FROM r JOIN o USING (declared_in) QUALIFY row_number() OVER (PARTITION BY artifact_id, lower(coordinate) ORDER BY ord) = 1""",
    "cvss_base": f"SELECT * FROM {_cvss_sql(_vectors_sql('part', '(p_partkey * 17 + p_size)', 'p_partkey'), 'p_partkey')}",
    "advisory_severity": f"SELECT *, {_SEVERITY_SQL} AS severity FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 101 / 10.0 END AS score, ({_WORD_LIST})[p_partkey % 6 + 1] AS word FROM part)",
    "vulnerable_dependencies": f"WITH {_RANGES_SQL} SELECT artifact_id, coordinate, id, severity FROM h",
    "vuln_by_package": f"""WITH {_RANGES_SQL} SELECT artifact_id, coordinate, count(*) AS n_advisories, max(severity) AS severity, array_to_string(list_sort(list(DISTINCT cve))[1:{advisories.MOST_IDS}], ',') AS ids,
  coalesce(array_to_string(list_sort(list(DISTINCT fix) FILTER (fix IS NOT NULL))[1:{advisories.MOST_FIXES}], ','), '') AS fixed_versions FROM h GROUP BY 1, 2""",
    "semver_latest": f"SELECT p_brand, tag, row_number() OVER (PARTITION BY p_brand ORDER BY {_SEMVER_KEY}, tag) AS place FROM {_SEMVER_SQL}",
    "newest_release": f"SELECT tag FROM {_SEMVER_SQL} WHERE pre = '' AND core > [0, 1, 5] ORDER BY core DESC, tag DESC LIMIT 1",
    "packaging_checks": _PACKAGING,
    "expected_capabilities": f"SELECT s_suppkey, t.* FROM supplier JOIN {values([(k, ','.join(v), len(v), i) for i, (k, v) in enumerate([*scoring.EXPECTED.items(), ('other', ())])], 'kind, capabilities, n, i')} v ON v.i = s_suppkey % {len(_KINDS)}, LATERAL (SELECT v.kind, v.capabilities, v.n) t",
}
assert len(CAPABILITIES) == 7
