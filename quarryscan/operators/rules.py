"""The rule engine: which rules match where, what is dropped, and the outcome of every check.

files: artifact_id, file_ord, path, content, language, is_decompiled. Matching is one pass over the files: a prefilter finds the rules whose
literals a text holds at all, and only their expressions run over it. Only matches are shuffled, without the text, to number them by place. Rules are rows of a catalogue, so further rules
are further `Rule` values; a predicate of their own goes into `ignores`.

Nulls: a null path or content counts as empty; repeated files are examined each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryscan.functions import paths as P
from quarryscan.functions import text as T

from .prefilter import bounded_batches, possible, quick
from .rulebook import CATEGORIES, FAMILIES, RULES, Rule

KEYS = ["artifact_id", "file_ord"]
#: Lines above a match that a guard may stand on.
LOOK_BACK = 15
#: Stands on both sides of a match while a text is cut at its matches: a code point that is no character.
MARK = "\uFDD0"
_SCHEME = r"(?i)uri\.(?:uriSchemeHttps?|trycreate)|\.scheme\b|startswith\s*\(\s*[\"']https?:"
_FETCHES = r"(?i)httpclient|webclient|downloadfile|\bfetch\s*\(|https?\.get\s*\(|requests\.get|urlretrieve|getbytearrayasync|invoke-webrequest|axios"
_WRITES = r"(?i)writeallbytes|createwritestream|writefile(?:sync)?\s*\(|gettemppath|os\.tmpdir|downloadfile|copytoasync|urlretrieve|\.exe[\"']"
_RUNS_FILE = r"(?i)\.exe\b|writeallbytes|createwritestream|downloadfile|urlretrieve"


def _jwt_role(token: Column) -> Column:
    body = F.regexp_extract(token, r"\.([\w-]+)\.", 1)
    plain = F.translate(body, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(4 - F.length(plain) % 4, F.lit(4)).cast("int")))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.role")


def preceded_by(before: Column, guard: str) -> Column:
    """Whether a guard stands on one of the lines down to the match's."""
    return F.exists(before, lambda x: x.rlike(guard))


#: Predicates that drop a match; columns: path, line_text, column, match, secret, context, before (lines), and the file's flags.
IGNORES: dict[str, Callable[[], Column]] = {
    "comment": lambda: T.is_comment(F.col("line_text")),
    "generated": lambda: P.is_generated(F.col("path")),
    "test_file": lambda: P.is_test_or_example(F.col("path")),
    "placeholder": lambda: T.is_placeholder(F.col("secret")) | T.is_environment_reference(F.col("secret")),
    "not_a_secret": lambda: ~T.looks_like_secret(F.col("secret")),
    "no_connection": lambda: ~T.looks_like_connection_string(F.col("line_text")),
    "not_service_role": lambda: F.coalesce(_jwt_role(F.col("match")) != "service_role", F.lit(True)),
    "pattern_text": lambda: F.col("context").rlike(r"\(\?[:=!<i]|\[\^|\]\{[0-9]|\\[rnsdbw][+*?]|\]\+|\.\*(?![\w/])|\)\?"),
    "no_download": lambda: ~F.col("fetches_and_writes"),
    "namespace_url": lambda: F.lower("match").rlike(r"://(?:www\.w3\.org|schemas\.|xmlns\.)|\.(?:xsd|dtd)\b") | F.lower("line_text").rlike(r"\bxmlns\b"),
    "package_metadata": lambda: F.lower(P.basename(F.col("path"))).isin("package.json", "package-lock.json"),
    "prose_not_sql": lambda: F.col("match").rlike(r"(?i)^[\"'`]\s*(?:select|update|delete\s+from)\s+(?:a|an|the|single|from|handler|cache)\b(?![^\n]*(?:=|\bwhere\b|\*))"),
    "switched_off": lambda: F.col("line_text").rlike(r"(?i)[:=]\s*false"),
    "triple": lambda: F.lower("match").rlike("3des|tripledes"),
    # The bare word is a cipher only in code: not inside a text with several words, and not in prose without quotes or calls.
    "cipher_in_prose": lambda: F.lower("match").isin("des", "rc4") & (T.inside_string(F.col("line_text"), F.col("column")) | ~F.col("line_text").rlike(r"(?i)\bdes\s*(?:\.|\(|:|=)|new\s+des\b|cipher|crypt")),
    "enum_member": lambda: F.col("line_text").rlike(r"^\s*\w+\s*(?:=\s*\d+)?\s*,?\s*$"),
    "bounded_size": lambda: F.col("line_text").rlike(r"(?i)math\.(?:min|clamp)|\b(?:length|len|size|count)\w*\s*(?:<=?|>=?)\s*[\w.]+|\?\s*stackalloc|:\s*stackalloc") | F.col("match").rlike(r"\[\s*(?:[A-Z][A-Z0-9_]*|Max\w*|\d+)\s*\]"),
    "bounded_read": lambda: F.col("line_text").rlike(r"(?i)\bbounded\w*\.|max\w*bytes|withlimit\s*\(|maxresponse"),
    "compiler_made": lambda: F.col("line_text").rlike(r"<>|>5__|<\w+>\w*__"),
    "scheme_checked": lambda: preceded_by(F.col("before"), _SCHEME),
}


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The catalogue as a dimension table."""
    rows = [(r.id, i, r.title, r.category, CATEGORIES.index(r.category), r.severity, r.user_severity, list(r.languages), r.is_blocking, r.is_capability, r.capability) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id string, rule_ord int, title string, category string, category_ord int, severity int, user_severity int, languages array<string>, is_blocking boolean, is_capability boolean, capability string")


def family(rule_id: Column) -> Column:
    """The family's description, from the middle part of a rule's id."""
    names = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.try_element_at(names, F.try_element_at(F.split(rule_id, "-"), F.lit(2)))


def applies(rule: Rule) -> Column:
    fits = F.col("language").isin(*rule.languages) if rule.languages else F.lit(True)
    return fits & F.col("path").rlike(rule.path_filter) if rule.path_filter else fits


def _lengths(x: Column, alias: str) -> Column:
    """Characters, line ends, and characters after the last line end."""
    return F.struct(F.length(x).alias("n"), T.newlines(x).alias("nl"), F.length(F.substring_index(x, "\n", -1)).alias("tail")).alias(alias)


def _by_rule(rules: Sequence[Rule], value: Callable[[Rule], Column]) -> Column:
    out = None
    for r in rules:
        out = F.when(F.col("rule_id") == r.id, value(r)) if out is None else out.when(F.col("rule_id") == r.id, value(r))
    return out


def cut_at(content: Column, pattern: str) -> Column:
    """The pieces between the matches of a pattern, with the matches between them; one piece if there are none. The expression runs over the text once."""
    once = F.split(F.regexp_replace(content, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # A text that has the mark itself: its matches and pieces are looked for one by one.
    found, pieces = F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), F.split(content, pattern, -1)
    apart = F.slice(F.flatten(F.zip_with(pieces, found, lambda b, m: F.array(b, m))), 1, F.size(found) * 2 + 1)
    return F.when(F.contains(content, F.lit(MARK)), apart).otherwise(once)


def matches(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every match of every applicable rule: the file's keys, path and flags, rule_id, pos, match, start (0-based), line (1-based), column
    (0-based), line_text, context (120 characters on both sides), before (the lines down to the match's, at most 16)."""
    bounded_batches(files.sparkSession)
    content = F.coalesce("content", F.lit(""))
    named = files.select(*KEYS, F.coalesce("path", F.lit("")).alias("path"), content.alias("content"), F.coalesce("language", F.lit("Unknown")).alias("language"))
    base = named.withColumn("_may", possible(F.col("content"), rules))

    def hits(r: Rule) -> Column:
        """The text cut at a rule's matches: what is before the first one, the match, what is before the second one, and so on."""
        may = F.array_contains("_may", rules.index(r)) & applies(r)
        return F.when(may, F.struct(F.lit(r.id).alias("rule_id"), cut_at(F.col("content"), quick(r.pattern)).alias("cut")))

    fired = F.filter(F.array(*[hits(r) for r in rules]), lambda x: x.isNotNull() & (F.size(x["cut"]) > 1))
    per_rule = base.withColumn("_r", F.explode(fired))
    plus, most = (lambda a, b: a + b), (lambda a, b: F.greatest(a, b))
    one = per_rule.select("*", F.col("_r.rule_id").alias("rule_id"), F.col("_r.cut").alias("_cut")).drop("_r")
    pair = lambda i: F.struct(F.get("_cut", 2 * i - 1).alias("m"), _lengths(F.get("_cut", 2 * i - 2), "b"), _lengths(F.get("_cut", 2 * i - 1), "l"))
    one = one.withColumn("_h", F.transform(F.sequence(F.lit(1), F.floor(F.size("_cut") / 2).cast("int")), pair)).drop("_cut")
    # Ends of the matches, and line ends up to there.
    one = one.withColumns({
        "_end": T.running(F.transform("_h", lambda x: x["b"]["n"] + x["l"]["n"]), F.lit(0), plus, "int"),
        "_nl": T.running(F.transform("_h", lambda x: x["b"]["nl"] + x["l"]["nl"]), F.lit(0), plus, "int"),
    })
    # Where a match's line begins: after the last line end before it, or in an earlier match.
    begins = F.transform(F.arrays_zip(F.col("_h").alias("h"), F.col("_end").alias("e")), lambda x: F.greatest(F.when(x["h"]["b"]["nl"] > 0, x["e"] - x["h"]["l"]["n"] - x["h"]["b"]["tail"]), F.lit(0)))
    after = F.transform(F.arrays_zip(F.col("_h").alias("h"), F.col("_end").alias("e")), lambda x: F.greatest(F.when(x["h"]["l"]["nl"] > 0, x["e"] - x["h"]["l"]["tail"]), F.lit(0)))
    one = one.withColumns({"_b": begins, "_a": F.slice(F.concat(F.array(F.lit(0)), after), 1, F.size("_h"))})
    one = one.withColumns({"_ls": T.running(F.zip_with("_b", "_a", most), F.lit(0), most, "int"), "_lines": T.lines(F.col("content"))})
    wants = lambda name: F.col("rule_id").isin(*[r.id for r in rules if name in r.ignore]) if any(name in r.ignore for r in rules) else F.lit(False)
    one = one.withColumns({
        "is_catalogue": T.is_pattern_catalogue(F.col("content")),
        "fetches_and_writes": wants("no_download") & F.col("content").rlike(_FETCHES) & F.col("content").rlike(_WRITES) & F.col("content").rlike(_RUNS_FILE),
    })

    def row(x: Column, i: Column) -> Column:
        """A match with what its predicates look at, so that the text stays behind."""
        start, line = x["e"] - x["h"]["l"]["n"], x["nl"] - x["h"]["l"]["nl"] + 1
        first = F.greatest(line - LOOK_BACK, F.lit(1))
        return F.struct(
            i.alias("pos"), x["h"]["m"].alias("match"), start.alias("start"), line.alias("line"), (start - x["ls"]).alias("column"),
            F.coalesce(F.get("_lines", line - 1), F.lit("")).alias("line_text"),
            F.when(wants("pattern_text"), F.substring("content", F.greatest(start - 119, F.lit(1)), x["h"]["l"]["n"] + 240)).alias("context"),
            F.when(wants("scheme_checked"), F.slice("_lines", first, line - first + 1)).alias("before"),
        )

    rows = F.transform(F.arrays_zip(F.col("_h").alias("h"), F.col("_end").alias("e"), F.col("_nl").alias("nl"), F.col("_ls").alias("ls")), row)
    flat = one.select(*KEYS, "path", "language", "is_catalogue", "fetches_and_writes", "rule_id", F.explode(rows).alias("m"))
    return flat.select(*KEYS, "path", "language", "is_catalogue", "fetches_and_writes", "rule_id", "m.*")


def match_counts(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """artifact_id, rule_id, n_matches: matches before anything is dropped, of the rules that have some; languages are not looked at."""
    bounded_batches(files.sparkSession)
    base = files.select("artifact_id", F.coalesce("content", F.lit("")).alias("content")).withColumn("_may", possible(F.col("content"), rules))
    counts = [F.when(F.array_contains("_may", i), F.struct(F.lit(r.id).alias("rule_id"), F.regexp_count("content", F.lit(r.pattern)).alias("n"))) for i, r in enumerate(rules)]
    each = base.select("artifact_id", F.explode(F.filter(F.array(*counts), lambda x: x.isNotNull() & (x["n"] > 0))).alias("r"))
    return each.groupBy("artifact_id", "r.rule_id").agg(F.sum("r.n").cast("long").alias("n_matches"))


def examine(files: DataFrame, rules: Sequence[Rule] = RULES, ignores: Mapping[str, Callable[[], Column]] = IGNORES) -> DataFrame:
    """Surviving and discounted matches: the columns of `matches` with secret, region, discounted, place_no and nth.

    A match inside a text that builds a pattern is discounted (not for credentials), then the rule's own predicates drop; of a line and
    region of 200 columns the first stays, and of a file and rule the first twenty. Discounted matches count up to the twentieth survivor.
    """
    found = matches(files, rules)
    found = found.withColumn("secret", _by_rule(rules, lambda r: F.lit(None).cast("string") if r.secret_group is None else F.regexp_extract("match", r.pattern, r.secret_group)))
    line, at = F.col("line_text"), F.col("column")
    near = F.substring(line, F.greatest(at - 399, F.lit(1)), F.least(at, F.lit(400))).rlike(T.PATTERN_BUILT)
    not_secret = ~F.col("rule_id").isin(*[r.id for r in rules if r.category == "Secrets"])
    discounted = not_secret & T.inside_string(line, at) & (F.col("is_catalogue") | near)
    dropped = _by_rule(rules, lambda r: reduce(lambda a, b: a | b, [ignores[name]() for name in r.ignore], F.lit(False)))
    kept = found.withColumns({"region": F.floor(at / T.REGION_WIDTH).cast("int"), "discounted": discounted}).withColumn("_dropped", F.coalesce(dropped, F.lit(False)))
    kept = kept.where(F.col("discounted") | ~F.col("_dropped"))
    of_file = Window.partitionBy(*KEYS, "rule_id")
    place = Window.partitionBy(*KEYS, "rule_id", "discounted", "line", "region").orderBy("pos")
    kept = kept.withColumn("place_no", F.row_number().over(place)).where(F.col("discounted") | (F.col("place_no") == 1))
    survivors = F.sum(F.when(~F.col("discounted"), 1).otherwise(0)).over(of_file.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    most = _by_rule(rules, lambda r: F.lit(r.most))
    return kept.withColumn("nth", survivors.cast("int")).where(F.when(F.col("discounted"), F.col("nth") < most).otherwise(F.col("nth") <= most)).drop("_dropped")


def findings(files: DataFrame, rules: Sequence[Rule] = RULES, ignores: Mapping[str, Callable[[], Column]] = IGNORES) -> DataFrame:
    """Findings of all rules after softening and deduplication, in the engine's columns."""
    spark = files.sparkSession
    rows = examine(files, rules, ignores).where(~F.col("discounted")).join(F.broadcast(rule_table(spark, rules)), "rule_id")  # a row per rule
    out = rows.select(
        *KEYS, "path", "rule_id", "title", "category", "category_ord", "severity", "user_severity", "is_blocking", "is_capability", "capability",
        F.lit("Rule").alias("source"), F.lit(None).cast("string").alias("explained_by"), "line", (F.col("column") + 1).alias("col"),
        T.evidence(F.col("line_text"), F.col("secret")).alias("evidence"),
    )
    return deduplicate(adjust(out))


def adjust(rows: DataFrame) -> DataFrame:
    """Findings in test and example files: one developer severity less and not blocking; credentials and notes stay."""
    soft = P.is_test_or_example(F.col("path")) & (F.col("category") != "Secrets") & (F.col("severity") > 0)
    return rows.withColumns({"severity": F.when(soft, F.col("severity") - 1).otherwise(F.col("severity")), "is_blocking": F.col("is_blocking") & ~soft, "softened": soft})


def deduplicate(rows: DataFrame) -> DataFrame:
    """One finding for each rule, path, line and region; the smallest column stays."""
    place = Window.partitionBy("artifact_id", "rule_id", "path", "line", F.floor((F.col("col") - 1) / T.REGION_WIDTH)).orderBy("col", "file_ord")
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def ordered(rows: DataFrame, audience: str = "Developer") -> DataFrame:
    """Severity of the audience falling, category, rule, path, line, column."""
    key = F.col("severity" if audience == "Developer" else "user_severity")
    return rows.orderBy("artifact_id", key.desc(), "category_ord", "rule_id", "path", "line", "col")


def outcomes(files: DataFrame, found: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per artifact and rule: files examined, files and findings with a match, and FoundIssues, Passed or NotChecked."""
    spark = files.sparkSession
    table = rule_table(spark, rules).select("rule_id", "rule_ord", "title", "category", "languages")
    by_language = files.groupBy("artifact_id", F.coalesce("language", F.lit("Unknown")).alias("language")).agg(F.count("*").alias("n"))
    wide = by_language.groupBy("artifact_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by_language"))  # at most a row per language each
    examined = F.aggregate(F.map_entries("by_language"), F.lit(0).cast("long"), lambda a, e: a + F.when((F.size("languages") == 0) | F.array_contains("languages", e["key"]), e["value"]).otherwise(0))
    every = wide.withColumn("_rule", F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("rule_ord"), F.array(*[F.lit(x) for x in r.languages]).cast("array<string>").alias("languages")) for i, r in enumerate(rules)])))
    every = every.select("artifact_id", "by_language", "_rule.*").withColumn("files_examined", examined).drop("by_language", "languages")
    fired = found.groupBy("artifact_id", "rule_id").agg(F.count("*").alias("n_findings"), F.countDistinct("file_ord").alias("files_fired"))
    rows = every.join(fired, ["artifact_id", "rule_id"], "left").join(F.broadcast(table.select("rule_id", "title", "category")), "rule_id")
    state = F.when(F.col("n_findings") > 0, "FoundIssues").when(F.col("files_examined") > 0, "Passed").otherwise("NotChecked")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("artifact_id", "rule_id", "rule_ord", "title", "category", "files_examined", zero("files_fired"), zero("n_findings"), state.alias("state"))


def outcome_counts(checks: DataFrame) -> DataFrame:
    count = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).cast("long")
    return checks.groupBy("artifact_id").agg(count("FoundIssues").alias("found_issues"), count("Passed").alias("passed"), count("NotChecked").alias("not_checked"))


def ordered_outcomes(checks: DataFrame) -> DataFrame:
    rank = F.when(F.col("state") == "FoundIssues", 0).when(F.col("state") == "Passed", 1).otherwise(2)
    return checks.orderBy("artifact_id", rank, "rule_id")


def inapplicable(checks: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """How many rules had no file, and the languages they were for."""
    names = checks.sparkSession.createDataFrame([(r.id, x) for r in rules for x in r.languages], "rule_id string, language string")
    rows = checks.where("state = 'NotChecked'").join(F.broadcast(names), "rule_id", "left")
    return rows.groupBy("artifact_id").agg(F.countDistinct("rule_id").alias("n_rules"), F.array_sort(F.collect_set("language")).alias("languages"))


def discounted_count(examined: DataFrame) -> DataFrame:
    return examined.groupBy("artifact_id").agg(F.sum(F.col("discounted").cast("long")).alias("n_discounted"))
