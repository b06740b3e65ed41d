"""Queries over whole texts: rule matches, checks, lines, blocks, comments, entropy, evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import paths as P
from quarryscan.functions import text as T
from quarryscan.operators import files as shapes
from quarryscan.operators import redundancy, rules, scans, scoring, triage
from quarryscan.operators.rulebook import BY_ID, CATEGORIES, RULES, Rule
from quarryscan.sources import tree

from .common import FILES, files, table

#: Rules whose patterns both engines read alike: no look-around, and no bare word beside letters outside ASCII, where word bounds differ.
PLAIN = tuple(r for r in RULES if not re.search(r"\(\?[=!<]", r.pattern) and r.id != "VC-CODE-006")
#: Plain words as rules, so that the given texts have matches of every kind.
WORDS = (
    Rule("QS-WORD-001", "A licence line", "Secrets", 1, 1, r"(?md)\bLicen[sc]e[d]?\b"),
    Rule("QS-WORD-002", "An address", "Network", 2, 1, r"(?md)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+", ("comment",)),
    Rule("QS-WORD-003", "A word of one language", "CodeSafety", 3, 2, r"(?md)\x20des\x20", languages=("fr",)),
    Rule("QS-WORD-004", "A short number", "Auth", 4, 2, r"(?md)\b[0-9]{3,5}\b", most=5),
    Rule("QS-WORD-005", "Nothing here", "Network", 2, 2, r"(?md)\bzqxjk[0-9]{9}\b"),
    Rule("QS-WORD-006", "A language that is not there", "Network", 2, 2, r"(?md)\bthe\b", languages=("xx", "yy")),
)
GUARD = r"(?i)licen[sc]e|copyright"
ADDRESS = Rule("QS-WORD-007", "An address sign", "Network", 1, 1, "@", ("scheme_checked",))


def _by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, F.coalesce("lang", F.lit("Unknown")))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in texts: name = "value" with a value that looks real, first of each line and region, masked."""
    return rules.findings(files(spark, sf_dir), (BY_ID["VC-SEC-010"],)).select("artifact_id", "file_ord", "rule_id", "line", "col", "evidence")


def secret_findings_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    inputs = turns.select(F.col("conv_id").cast("string").alias("artifact_id"), F.col("turn").alias("file_ord"), F.lit("turn.txt").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit("Unknown").alias("language"))
    return rules.findings(inputs, (BY_ID["VC-SEC-010"],)).select("artifact_id", "file_ord", "line", "col", "evidence")


def rule_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every plain rule in every artifact, before anything is dropped; rules without a match have 0."""
    found = files(spark, sf_dir)
    counts = rules.match_counts(found, PLAIN)
    every = found.select("artifact_id").distinct().crossJoin(F.broadcast(rules.rule_table(spark, PLAIN).select("rule_id")))  # a row per rule
    same = every["artifact_id"].eqNullSafe(counts["artifact_id"]) & (every["rule_id"] == counts["rule_id"])
    return every.join(counts, same, "left").select(every["artifact_id"], every["rule_id"], F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def word_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the word rules: line and region once, at most twenty of a file and rule."""
    return rules.examine(_by_lang(spark, sf_dir), WORDS).select("artifact_id", "file_ord", "rule_id", "line", F.col("column").alias("col"), "match", "nth")


def check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files examined and findings of every word rule, and whether it found issues, passed or was not checked."""
    inputs = _by_lang(spark, sf_dir)
    return rules.outcomes(inputs, rules.findings(inputs, WORDS), WORDS).select("artifact_id", "rule_id", "files_examined", "files_fired", "n_findings", "state")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _by_lang(spark, sf_dir)
    return rules.outcome_counts(rules.outcomes(inputs, rules.findings(inputs, WORDS), WORDS))


def inapplicable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules without a file, and the languages they were for."""
    inputs = _by_lang(spark, sf_dir)
    rows = rules.inapplicable(rules.outcomes(inputs, rules.findings(inputs, WORDS), WORDS), WORDS)
    return rows.select("artifact_id", "n_rules", F.array_join("languages", ",").alias("languages"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    return found.select("artifact_id", "file_ord", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def cipher_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the word des: how many hold it inside a string literal, and how many are comments."""
    rows = _lines(spark, sf_dir).where(F.col("text").rlike(r"(?i)\x20des\x20"))
    at = F.length(F.regexp_extract("text", r"(?i)^(.*?\x20)des\x20", 1))
    return rows.groupBy("artifact_id").agg(F.count("*").alias("n_lines"), F.sum(T.inside_string(F.col("text"), at).cast("long")).alias("n_inside"), F.sum(T.is_comment(F.col("text")).cast("long")).alias("n_comments"))


def guard_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an address that have a guard word on them or on the fifteen lines before."""
    found = rules.matches(files(spark, sf_dir), (ADDRESS,))
    rows = found.select("artifact_id", "file_ord", "line", rules.preceded_by(F.col("before"), GUARD).alias("guarded")).distinct()
    return rows.groupBy("artifact_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("guarded").cast("long")).alias("n_guarded"))


def shannon_entropy_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty texts whose longest run of letters and digits has the highest entropy."""
    word = F.array_max(F.transform(F.regexp_extract_all("content", F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = files(spark, sf_dir).select("file_ord", F.coalesce(word, F.lit("")).alias("word")).select("file_ord", "word", F.round(T.entropy(F.col("word")), 6).alias("entropy"))
    return rows.orderBy(F.desc("entropy"), "file_ord").limit(20)


def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many first quoted values are placeholders, read from the environment, or look like secrets."""
    rows = files(spark, sf_dir).select("artifact_id", F.regexp_extract("content", "\"([^\"\n]{1,200})\"", 1).alias("v"))
    total = lambda c, n: F.sum(c.cast("long")).alias(n)
    return rows.groupBy("artifact_id").agg(total(T.is_placeholder(F.col("v")), "n_placeholder"), total(T.is_environment_reference(F.col("v")), "n_environment"), total(T.looks_like_secret(F.col("v")), "n_secret"), total(T.looks_like_connection_string(F.col("v")), "n_connection"))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked evidence: the first line of each text with its first word hidden."""
    line = F.substring_index("content", "\n", 1)
    word = F.regexp_extract(line, "[A-Za-z0-9]+", 0)
    return files(spark, sf_dir).select("file_ord", T.mask(word).alias("masked"), T.evidence(line, word).alias("evidence"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six lines and a note on the rest."""
    return files(spark, sf_dir).select("file_ord", T.excerpt(F.col("content")).alias("excerpt"))


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight significant lines that occur more than once in an artifact."""
    return redundancy.block_groups(redundancy.blocks(files(spark, sf_dir))).drop("set_a", "set_b")


def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP-002: one block for each set of files, the ten largest of an artifact."""
    return redundancy.repeated_blocks(files(spark, sf_dir)).select("artifact_id", "block_sha256", "n_occurrences", "first_file", "first_line", "place")


def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: runs of at least three lines in a row with an unusual letter, the ten longest of an artifact."""
    rows = _lines(spark, sf_dir).where(F.col("text").rlike("[éèñüöäç]"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("file_ord").orderBy("line_no"))
    runs = rows.withColumn("i", island).groupBy("artifact_id", "file_ord", "i").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines")).where("n_lines >= 3").drop("i")
    order = Window.partitionBy("artifact_id").orderBy(F.desc("n_lines"), "file_ord", "first_line")
    return runs.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 10")


def evidence_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a claimed quotation stands: at its line, near it, or elsewhere in the text."""
    inputs = files(spark, sf_dir)
    lines = T.lines(F.col("content"))
    k = (F.col("file_ord") % F.size(lines)).cast("int")
    claims = inputs.select(F.col("file_ord").cast("string").alias("artifact_id"), "path", F.lit(0).alias("claim_id"), (k + 1 + F.col("file_ord") % 9 - 4).cast("int").alias("claimed_line"), F.element_at(lines, k + 1).alias("quote"))
    return triage.locate(claims, inputs.withColumn("artifact_id", F.col("file_ord").cast("string"))).select("artifact_id", "found_line", "tier")


def folder_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every artifact's sorted manifest of paths and sizes."""
    listing = files(spark, sf_dir).select("artifact_id", F.concat(F.col("file_ord").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("content").cast("long").alias("bytes"))
    return tree.folder_hash(listing)


def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of made-up paths, one extension after another."""
    names = sorted(e for es in P.EXTENSIONS.values() for e in es.split()) + ["none", "bin"]
    path = F.concat(F.lit("a.b/"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int")))
    path = F.regexp_replace(path, "^a.b/", F.lit("dir/file."))
    path = F.when(F.col("doc_id") % 10 == 0, F.lit("dir/.env.local")).otherwise(path)
    return table(spark, sf_dir, "documents").groupBy(P.language_of(path).alias("language")).agg(F.count("*").alias("n"))


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that may be called, by host."""
    return table(spark, sf_dir, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"), F.sum(P.is_endpoint_allowed(F.col("url")).cast("long")).alias("n_allowed"))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and cost of conversations, with lengths of turns as tokens."""
    turns = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    role = lambda r: F.when(F.col("role") == r, n).otherwise(0).cast("long")
    usage = turns.select("conv_id", role("user").alias("input_tokens"), role("assistant").alias("output_tokens"), (n % 100).alias("cache_write_tokens"), (n % 10).alias("cache_read_tokens"))
    return scoring.token_usage(usage, "conv_id").withColumn("cost", F.col("cost").cast("double"))


def limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged notes of every artifact, the later kinds cut."""
    notes = files(spark, sf_dir).select("artifact_id", (F.col("file_ord") % 4).cast("int").alias("kind"), F.col("file_ord").alias("ord"), F.concat(F.lit("note "), F.col("file_ord").cast("string")).alias("note"))
    return scoring.limitations(notes).select("artifact_id", F.array_join("limitations", "|").alias("limitations"))


def dropped_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every artifact within a running budget of characters."""
    listing = files(spark, sf_dir).select("artifact_id", "file_ord", F.length("content").alias("n"))
    read = scans.within_budget(listing, ["artifact_id"], "file_ord", F.col("n"), 50_000, whole=True).groupBy("artifact_id").agg(F.count("*").alias("n_read"))
    return listing.groupBy("artifact_id").agg(F.count("*").alias("n_files")).join(read, "artifact_id", "left").select("artifact_id", F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_files")


def sql_pattern(pattern: str) -> str:
    """A rule's pattern as DuckDB reads it in a quoted literal."""
    return re.sub(r"^\(\?m?d?(i?)\)", lambda m: "(?m" + m.group(1) + ")", pattern).replace("'", "''")


def _word_rows(rule: Rule) -> str:
    only = f"AND language IN ({', '.join(repr(x) for x in rule.languages)})" if rule.languages else ""
    drop = "AND NOT regexp_matches(line_text, '^\\s*(?://|#|\\*|<!--)')" if "comment" in rule.ignore else ""
    p = sql_pattern(rule.pattern)
    return f"""SELECT artifact_id, file_ord, '{rule.id}' AS rule_id, line, col, match, row_number() OVER (PARTITION BY file_ord ORDER BY line, col) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY file_ord, line, col // 200 ORDER BY pos) AS k FROM (
      SELECT artifact_id, file_ord, line, line_text, pos, m[pos] AS match, (list_sum(list_transform(b[1:pos], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:pos - 1], lambda x: length(x))), 0))::INT AS col
      FROM (SELECT *, string_split_regex(line_text, '{p}') AS b, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT *, regexp_extract_all(line_text, '{p}') AS m FROM l WHERE true {only} {drop}) WHERE len(m) > 0)))
    WHERE k = 1 QUALIFY nth <= {rule.most}"""


_LANG = f"(SELECT f.*, coalesce(d.lang, 'Unknown') AS language FROM {FILES} f JOIN documents d ON d.doc_id = f.file_ord)"
_NUMBERED = f"(SELECT artifact_id, file_ord, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT artifact_id, file_ord, string_split(content, chr(10)) AS ls FROM {FILES}))"
_WITH_LINES = f"""l AS (SELECT artifact_id, file_ord, language, unnest(ls) AS line_text, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {_LANG}))"""
_ENTROPY = "coalesce(list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE) * log2(len(list_filter(string_split({0}, ''), lambda x: x = c)) / length({0})::DOUBLE))), 0)"
_PLAIN_VALUE = "regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '^[<>{{}}\"'']+|[<>{{}}\"'']+$', '', 'g')"


def _placeholder(v: str) -> str:
    plain = _PLAIN_VALUE.format(v)
    words = " OR ".join(f"contains(lower({plain}), '{w}')" for w in T.PLACEHOLDER_WORDS)
    return f"(length({plain}) < 8 OR regexp_matches({plain}, '{T.BARE_NAME}') OR {words} OR len(list_distinct(string_split({plain}, ''))) <= 2)"


def _environment(v: str) -> str:
    return f"regexp_matches({v}, '{T.ENVIRONMENT}')"


def _secret(v: str) -> str:
    return f"(NOT {_placeholder(v)} AND NOT {_environment(v)} AND length({v}) >= 12 AND {_ENTROPY.format(v)} >= 3.2)"


def _mask(v: str) -> str:
    return f"CASE WHEN length({v}) <= 4 THEN repeat('*', length({v})) ELSE left({v}, 4) || repeat('*', least(length({v}) - 4, 16)) END"


def _evidence(line: str, v: str) -> str:
    shown = f"regexp_replace(CASE WHEN {v} <> '' THEN replace(regexp_replace({line}, '^\\s+|\\s+$', '', 'g'), {v}, {_mask(v)}) ELSE regexp_replace({line}, '^\\s+|\\s+$', '', 'g') END, '[\\x00-\\x1F\\x7F-\\x{{9F}}]', ' ', 'g')"
    return f"CASE WHEN length({shown}) > 200 THEN left({shown}, 200) || '…' ELSE {shown} END"


def _secrets_sql(source: str) -> str:
    p = sql_pattern(BY_ID["VC-SEC-010"].pattern)
    return f"""WITH l AS (SELECT artifact_id, file_ord, unnest(ls) AS t, unnest(range(1, len(ls) + 1))::INT AS line FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {source})),
  s AS (SELECT *, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', 1) AS vs, string_split_regex(t, '{p}') AS bs FROM l WHERE regexp_matches(t, '{p}')),
  x AS (SELECT *, vs[i] AS v, (list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::INT AS c0 FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM s)),
  y AS (SELECT * FROM x WHERE {_secret('v')} AND NOT regexp_matches(t, '^\\s*(?://|#|\\*|<!--)') QUALIFY row_number() OVER (PARTITION BY artifact_id, file_ord, line, c0 // 200 ORDER BY i) = 1)
  SELECT artifact_id, file_ord, 'VC-SEC-010' AS rule_id, line, c0 + 1 AS col, {_evidence('t', 'v')} AS evidence FROM y QUALIFY row_number() OVER (PARTITION BY artifact_id, file_ord ORDER BY line, i) <= 20"""


_OUTCOMES = f"""WITH {_WITH_LINES}, fired AS ({' UNION ALL '.join('SELECT * FROM (' + _word_rows(r) + ')' for r in WORDS)}),
  r AS (SELECT * FROM (VALUES {', '.join(f"('{r.id}', {[*r.languages]}::VARCHAR[])" for r in WORDS)}) AS t(rule_id, languages)),
  f AS (SELECT artifact_id, language, count(*) AS n FROM {_LANG} GROUP BY 1, 2),
  e AS (SELECT a.artifact_id, r.rule_id, r.languages, coalesce(sum(f.n) FILTER (len(r.languages) = 0 OR list_contains(r.languages, f.language)), 0) AS files_examined FROM (SELECT DISTINCT artifact_id FROM f) a CROSS JOIN r LEFT JOIN f ON f.artifact_id = a.artifact_id GROUP BY 1, 2, 3),
  g AS (SELECT artifact_id, rule_id, count(DISTINCT file_ord) AS files_fired, count(*) AS n_findings FROM fired GROUP BY 1, 2),
  o AS (SELECT e.artifact_id, e.rule_id, e.languages, e.files_examined, coalesce(g.files_fired, 0) AS files_fired, coalesce(g.n_findings, 0) AS n_findings,
    CASE WHEN g.n_findings > 0 THEN 'FoundIssues' WHEN e.files_examined > 0 THEN 'Passed' ELSE 'NotChecked' END AS state FROM e LEFT JOIN g ON g.artifact_id = e.artifact_id AND g.rule_id = e.rule_id)"""
_SIGNIFICANT = f"""(SELECT artifact_id, file_ord, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: {{'n': i, 't': regexp_replace(x, '\\A{shapes.WHITE}+|{shapes.WHITE}+\\z', '', 'g')}}),
  lambda x: NOT regexp_matches(x.t, '{shapes.IDLE}')) AS ls FROM {FILES})"""
_BLOCKS = f"""b AS (SELECT artifact_id, file_ord, ls[i].n AS line_no, sha256(array_to_string(list_transform(ls[i:i + 7], lambda x: x.t), chr(10))) AS h FROM (SELECT *, unnest(range(1, len(ls) - 6)) AS i FROM {_SIGNIFICANT} WHERE len(ls) >= 8)),
  g AS (SELECT artifact_id, h AS block_sha256, count(*) AS n_occurrences, count(DISTINCT file_ord) AS n_files, min((file_ord, line_no)) AS p, list_sort(list(DISTINCT file_ord)) AS files FROM b GROUP BY 1, 2 HAVING count(*) > 1)"""
_CONVERSATIONS = "(SELECT conv_id::VARCHAR AS artifact_id, turn AS file_ord, coalesce(text, '') AS content FROM conversations)"

QUERIES = {f.__name__: f for f in (
    secret_findings, secret_findings_conversations, rule_match_counts, word_findings, check_outcomes, outcome_counts, inapplicable_checks, cipher_word_lines, guard_lookback,
    shannon_entropy_top, value_classes, evidence_lines, excerpts, duplicate_blocks, repeated_blocks, line_runs, evidence_locate, folder_hashes, language_of_path, url_checks,
    token_usage, limitations, dropped_by_budget,
)}
ORACLE_SQL = {
    "secret_findings": _secrets_sql(FILES),
    "secret_findings_conversations": f"SELECT artifact_id, file_ord, line, col, evidence FROM ({_secrets_sql(_CONVERSATIONS)})",
    "rule_match_counts": " UNION ALL ".join(f"SELECT artifact_id, '{r.id}' AS rule_id, sum(len(regexp_extract_all(content, '{sql_pattern(r.pattern)}')))::BIGINT AS n_matches FROM {FILES} GROUP BY 1" for r in PLAIN),
    "word_findings": f"WITH {_WITH_LINES} " + " UNION ALL ".join(f"SELECT artifact_id, file_ord, rule_id, line, col, match, nth FROM ({_word_rows(r)})" for r in WORDS),
    "check_outcomes": f"{_OUTCOMES} SELECT artifact_id, rule_id, files_examined, files_fired, n_findings, state FROM o",
    "outcome_counts": f"{_OUTCOMES} SELECT artifact_id, count(*) FILTER (state = 'FoundIssues') AS found_issues, count(*) FILTER (state = 'Passed') AS passed, count(*) FILTER (state = 'NotChecked') AS not_checked FROM o GROUP BY 1",
    "inapplicable_checks": f"{_OUTCOMES} SELECT artifact_id, count(DISTINCT rule_id) AS n_rules, string_agg(DISTINCT x, ',' ORDER BY x) AS languages FROM (SELECT *, unnest(languages) AS x FROM o WHERE state = 'NotChecked') GROUP BY 1",
    "cipher_word_lines": f"""WITH l AS (SELECT *, regexp_extract(text, '(?i)^(.*?\\x20)des\\x20', 1) AS before FROM {_NUMBERED} WHERE regexp_matches(text, '(?i)\\x20des\\x20'))
  SELECT artifact_id, count(*) AS n_lines, count(*) FILTER (length(before) > 0 AND regexp_matches(regexp_replace(before, '"(?:[^"\\\\]+|\\\\.)*"|''(?:[^''\\\\]+|\\\\.)*''', '', 'g'), '["'']')) AS n_inside,
    count(*) FILTER (regexp_matches(text, '^\\s*(?://|#|\\*|<!--)')) AS n_comments FROM l GROUP BY 1""",
    "guard_lookback": f"""SELECT artifact_id, count(*) AS n_lines, count(*) FILTER (g) AS n_guarded FROM (SELECT *, bool_or(regexp_matches(text, '{GUARD}')) OVER (PARTITION BY file_ord ORDER BY line_no ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS g FROM {_NUMBERED})
  WHERE contains(text, '@') GROUP BY 1""",
    "shannon_entropy_top": f"""WITH w AS (SELECT file_ord, coalesce(list_max(list_transform(regexp_extract_all(content, '[A-Za-z0-9]+'), lambda w: {{'n': length(w), 'w': w}})).w, '') AS word FROM {FILES})
  SELECT file_ord, word, round({_ENTROPY.format('word')}, 6) AS entropy FROM w ORDER BY entropy DESC, file_ord LIMIT 20""",
    "value_classes": f"""WITH v AS (SELECT artifact_id, coalesce(regexp_extract(content, '"([^"\\n]{{1,200}})"', 1), '') AS v FROM {FILES})
  SELECT artifact_id, count(*) FILTER ({_placeholder('v')}) AS n_placeholder, count(*) FILTER ({_environment('v')}) AS n_environment, count(*) FILTER ({_secret('v')}) AS n_secret,
    count(*) FILTER ({' OR '.join(f"contains(lower(v), '{m}')" for m in T.CONNECTION_MARKERS)}) AS n_connection FROM v GROUP BY 1""",
    "evidence_lines": f"SELECT file_ord, {_mask('w')} AS masked, {_evidence('t', 'w')} AS evidence FROM (SELECT file_ord, t, regexp_extract(t, '[A-Za-z0-9]+', 0) AS w FROM (SELECT file_ord, split_part(content, chr(10), 1) AS t FROM {FILES}))",
    "excerpts": f"""SELECT file_ord, array_to_string(ls[1:6], chr(10)) || CASE WHEN len(ls) > 6 THEN chr(10) || '... ' || (len(ls) - 6) || ' more lines' ELSE '' END AS excerpt
  FROM (SELECT file_ord, list_transform(string_split(content, chr(10)), lambda x: rtrim(x, chr(13))) AS ls FROM {FILES})""",
    "duplicate_blocks": f"WITH {_BLOCKS} SELECT artifact_id, block_sha256, n_occurrences, n_files, p[1] AS first_file, p[2] AS first_line FROM g",
    "repeated_blocks": f"""WITH {_BLOCKS}, one AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY artifact_id, files ORDER BY n_occurrences DESC, p, block_sha256) = 1)
  SELECT artifact_id, block_sha256, n_occurrences, p[1] AS first_file, p[2] AS first_line, row_number() OVER (PARTITION BY artifact_id ORDER BY n_occurrences DESC, p, block_sha256) AS place FROM one QUALIFY place <= 10""",
    "line_runs": f"""WITH r AS (SELECT *, line_no - row_number() OVER (PARTITION BY file_ord ORDER BY line_no) AS i FROM {_NUMBERED} WHERE regexp_matches(text, '[éèñüöäç]')),
  g AS (SELECT artifact_id, file_ord, min(line_no) AS first_line, count(*) AS n_lines FROM r GROUP BY artifact_id, file_ord, i HAVING count(*) >= 3)
  SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY n_lines DESC, file_ord, first_line) AS place FROM g QUALIFY place <= 10""",
    "evidence_locate": f"""WITH f AS (SELECT file_ord, list_transform(string_split(content, chr(10)), lambda x: rtrim(x, chr(13))) AS ls FROM {FILES}),
  c AS (SELECT file_ord, (file_ord % len(ls) + 1 + file_ord % 9 - 4)::INT AS claimed, regexp_replace(ls[file_ord % len(ls) + 1], '\\s+', '', 'g') AS q FROM f),
  l AS (SELECT file_ord, regexp_replace(unnest(ls), '\\s+', '', 'g') AS t, unnest(range(1, len(ls) + 1)) AS line FROM f),
  h AS (SELECT *, abs(line - claimed) AS gap, CASE WHEN abs(line - claimed) = 0 THEN 0 WHEN abs(line - claimed) <= 3 THEN 1 WHEN length(q) >= 12 THEN 2 END AS tier FROM c JOIN l USING (file_ord) WHERE q <> '' AND t <> '' AND (contains(t, q) OR (contains(q, t) AND length(t) >= 12))),
  k AS (SELECT file_ord, min((tier, CASE WHEN tier = 1 THEN gap ELSE 0 END, line)) AS b FROM h WHERE tier IS NOT NULL GROUP BY 1)
  SELECT c.file_ord::VARCHAR AS artifact_id, b[3] AS found_line, b[1] AS tier FROM c LEFT JOIN k USING (file_ord)""",
    "folder_hashes": f"SELECT artifact_id, sha256(string_agg(file_ord || '.txt|' || strlen(content) || chr(10), '' ORDER BY file_ord || '.txt')) AS sha256, sum(strlen(content))::BIGINT AS bytes FROM {FILES} GROUP BY 1",
    "language_of_path": "",
    "url_checks": "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (url LIKE 'https://%' OR regexp_matches(url, '^http://(localhost|127\\.0\\.0\\.1)([:/]|$)')) AS n_allowed FROM pages GROUP BY 1",
    "token_usage": """WITH t AS (SELECT conv_id, role, coalesce(length(text), 0) AS n FROM conversations),
  s AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN n ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS output_tokens, sum(n % 100)::BIGINT AS cache_write_tokens, sum(n % 10)::BIGINT AS cache_read_tokens FROM t GROUP BY 1)
  SELECT *, (round((input_tokens * 5 + output_tokens * 25 + cache_write_tokens * 6.25 + cache_read_tokens * 0.5) / 1000000, 8))::DOUBLE AS cost FROM s""",
    "limitations": f"""WITH n AS (SELECT artifact_id, (file_ord % 4)::INT AS kind, file_ord AS ord, 'note ' || file_ord AS note, row_number() OVER (PARTITION BY artifact_id, file_ord % 4 ORDER BY file_ord) AS k FROM {FILES})
  SELECT artifact_id, string_agg(note, '|' ORDER BY kind, ord) AS limitations FROM n WHERE kind < 2 OR (kind = 2 AND k <= 20) OR (kind = 3 AND k <= 5) GROUP BY 1""",
    "dropped_by_budget": f"SELECT artifact_id, count(*) FILTER (t <= 50000) AS n_read, count(*) AS n_files FROM (SELECT artifact_id, sum(length(content)) OVER (PARTITION BY artifact_id ORDER BY file_ord) AS t FROM {FILES}) GROUP BY 1",
}


def _language_sql() -> str:
    names = sorted(e for es in P.EXTENSIONS.values() for e in es.split()) + ["none", "bin"]
    of = {e: lang for lang, es in P.EXTENSIONS.items() for e in es.split()}
    return f"SELECT CASE WHEN doc_id % 10 = 0 THEN 'Config' ELSE ({[of.get(n, 'Unknown') for n in names]})[doc_id % {len(names)} + 1] END AS language, count(*) AS n FROM documents GROUP BY 1"


ORACLE_SQL["language_of_path"] = _language_sql()
assert len(CATEGORIES) == 7
