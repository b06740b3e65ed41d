"""Names and quotations found in texts, progress over events, budgets over one large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryscan.functions import variants
from quarryscan.operators import anchors, scans, triage

from .common import FILES, files, table

#: Words of a benchmark item that serve as names, and characters that an artifact of all documents may hold.
NAMES, BUDGET = 5, 1_000_000


def name_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source that hold one of its names: the first long words of benchmark items."""
    words = F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{6,}"), F.lit(0)), 1, NAMES)
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("artifact_id"), F.explode(words).alias("name"))
    return anchors.holding(names, files(spark, sf_dir), "artifact_id", "file_ord")


def quotation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where benchmark items, whole and their first halves, stand in documents."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    quotes = items.select((F.col("item_id") * 2).alias("quote_id"), "text").unionByName(items.select((F.col("item_id") * 2 + 1).alias("quote_id"), half.alias("text")))
    return triage.quoted_from(quotes, files(spark, sf_dir), "quote_id")


def _events(spark: SparkSession, sf_dir: str, key) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select(key.alias("run"), F.col("ts").alias("at"), "event_id", "event_type")
    i = F.col("event_id")
    reports = rows.where("event_type <> 'view'").select("run", "at", i.alias("report_id"), (i % 97).cast("int").alias("share"), (i % 5 * 20).cast("int").alias("start"), F.col("event_type").alias("message"))
    return reports, rows.where("event_type = 'view'").select("run", "at", i.alias("look_id"), (i * 7 % 101).cast("int").alias("paced"))


def progress_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's views show of the progress that their other events report; the paced value before the first of these, as in the SQL."""
    return scans.progress(*_events(spark, sf_dir, F.col("user_id")), "run", unreported=F.col("paced"))


def progress_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with half of all events in one run."""
    return scans.progress(*_events(spark, sf_dir, F.when(F.col("user_id") % 2 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long")), "run", slice_rows=500, unreported=F.col("paced"))


def budget_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are read when all are one artifact."""
    rows = files(spark, sf_dir).select(F.lit("all").alias("artifact_id"), "file_ord", F.length("content").alias("n"))
    return scans.within_budget(rows, ["artifact_id"], "file_ord", F.col("n"), BUDGET, slice_rows=100).select("file_ord", "n")


def quoted_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of every document, and what follows it while a bracket is open. Texts get brackets for two pairs of letters, and bare lines between theirs."""
    text = F.replace(F.replace(F.replace(F.col("content"), F.lit("th"), F.lit("(")), F.lit("an"), F.lit(")")), F.lit("\n"), F.lit("\n});\n/// <p>\n"))
    made = files(spark, sf_dir).withColumn("content", text)
    n = F.size(F.split("content", "\n", -1))
    found = made.select("artifact_id", "file_ord", "path", (F.col("file_ord") % n + 1).cast("int").alias("found_line"))
    return triage.quoted(found.where("artifact_id IS NOT NULL"), made).select("file_ord", "found_line", "excerpt")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events by name and type; every tenth text is broken, others are no object or hold further types."""
    i = F.col("event_id") % 10
    more = lambda x: F.replace("props", F.lit("}"), F.lit(x))
    text = F.when(i == 0, '{"k": ').when(i == 1, "[1, 2]").when(i == 2, more(', "tags": ["a"], "on": true}')).when(i == 3, more(', "name": "x", "n": null}')).when(i == 4, '{"k": {"deep": 1.5}, "r": 2.5}').otherwise(F.col("props"))
    found = variants.properties(table(spark, sf_dir, "events").select("event_id", text.alias("text")), F.col("text"))
    return found.groupBy("name", "kind", "note").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_NORMAL = "trim(regexp_replace(lower({0}), '[\\s/*#<>!-]+', ' ', 'g'))"


def _progress_sql(key: str) -> str:
    return f"""WITH e AS (SELECT {key} AS run, ts, event_id, event_type FROM events),
  r AS (SELECT run, ts, event_id, event_id % 97 AS share, event_id % 5 * 20 AS start, event_type AS message, coalesce(lag(event_type) OVER (PARTITION BY run ORDER BY ts, event_id) <> event_type, true) AS entry FROM e WHERE event_type <> 'view'),
  n AS (SELECT run, message, row_number() OVER w AS no, max(start) OVER w AS from_ FROM r WHERE entry WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
  u AS (SELECT run, ts, 0 AS look, event_id, share, entry::INT AS entry FROM r UNION ALL SELECT run, ts, 1, event_id, NULL, 0 FROM e WHERE event_type = 'view'),
  l AS (SELECT run, event_id AS look_id, coalesce(least(event_id * 7 % 101, furthest), 0) AS shown, so_far FROM (SELECT *, max(share) OVER w AS furthest, sum(entry) OVER w AS so_far FROM u WINDOW w AS (PARTITION BY run ORDER BY ts, look, event_id ROWS UNBOUNDED PRECEDING)) WHERE look = 1),
  b AS (SELECT l.run, look_id, shown, so_far, (SELECT max(no) FROM n WHERE n.run = l.run AND from_ <= shown) AS last FROM l)
  SELECT b.run, look_id, shown::INT AS shown, n.message FROM b LEFT JOIN n ON n.run = b.run AND so_far > 0 AND n.no = greatest(1, least(so_far, coalesce(last, 1)))"""


_PUNCT, _TAG, _BLANK = "regexp_matches(l[{0}], '^\\s*[{{}}()\\[\\];,]+\\s*$')", "regexp_matches(l[{0}], '^\\s*(///|//|\\*)\\s*</?[A-Za-z][A-Za-z0-9]*(\\s+[^<>]*)?/?>\\s*$')", "regexp_matches(l[{0}], '^\\s*$')"
_OPEN = "(length(regexp_replace({0}, '[^(\\[]', '', 'g')) - length(regexp_replace({0}, '[^)\\]]', '', 'g')))"


def _statements_sql() -> str:
    rows = f"(SELECT file_ord, (file_ord % len(l) + 1)::INT AS found_line, (file_ord % len(l) + 1)::INT AS i, l FROM (SELECT file_ord, string_split(replace(replace(replace(content, 'th', '('), 'an', ')'), chr(10), chr(10) || '}});' || chr(10) || '/// <p>' || chr(10)), chr(10)) AS l FROM {FILES} WHERE artifact_id IS NOT NULL))"
    for _ in range(triage.NEAR):
        rows = f"(SELECT file_ord, found_line, CASE WHEN i > 1 AND {_PUNCT.format('i')} THEN i - 1 ELSE i END AS i, l FROM {rows})"
    for _ in range(triage.NEAR):
        rows = f"(SELECT file_ord, found_line, CASE WHEN i < len(l) AND {_TAG.format('i')} THEN i + 1 ELSE i END AS i, l FROM {rows})"
    one, two = _OPEN.format("l[i]"), _OPEN.format("coalesce(l[i + 1], '')")
    taken = f"CASE WHEN {one} <= 0 THEN 1 WHEN {one} + {two} <= 0 THEN 2 ELSE 3 END"
    return f"""SELECT file_ord, found_line, CASE WHEN NOT ({_BLANK.format('found_line')} OR {_BLANK.format('i')} OR {_PUNCT.format('i')} OR {_TAG.format('i')}) THEN regexp_replace(array_to_string(l[i:i + ({taken}) - 1], chr(10)), '\\s+$', '') END AS excerpt FROM {rows}"""


QUERIES = {f.__name__: f for f in (name_holders, quotation_places, progress_by_user, progress_of_one, budget_of_one, quoted_statements, event_properties)}
ORACLE_SQL = {
    "name_holders": f"""WITH n AS (SELECT DISTINCT 'src' || (item_id % 20) AS artifact_id, unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')[1:{NAMES}]) AS name FROM benchmark)
  SELECT DISTINCT f.artifact_id, f.file_ord, n.name FROM n JOIN {FILES} f ON f.artifact_id = n.artifact_id AND contains(f.content, n.name)""",
    "quotation_places": f"""WITH b AS (SELECT item_id * 2 AS quote_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, left(text, (length(text) // 2)::INT) FROM benchmark),
  q AS (SELECT quote_id, {_NORMAL.format('text')} AS q FROM b), t AS (SELECT file_ord, {_NORMAL.format('content')} AS t FROM {FILES}),
  m AS (SELECT quote_id, file_ord, length(q) AS n, string_split(t, q) AS p FROM q JOIN t ON length(q) >= {anchors.LEAST} AND contains(t, q))
  SELECT quote_id, file_ord, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * n)::BIGINT AS start FROM (SELECT *, unnest(range(1, len(p))) AS k FROM m)""",
    "progress_by_user": _progress_sql("user_id"),
    "progress_of_one": _progress_sql("(CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END)"),
    "quoted_statements": _statements_sql(),
    "event_properties": """WITH t AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN '{"k": ' WHEN 1 THEN '[1, 2]' WHEN 2 THEN replace(props, '}', ', "tags": ["a"], "on": true}') WHEN 3 THEN replace(props, '}', ', "name": "x", "n": null}')
    WHEN 4 THEN '{"k": {"deep": 1.5}, "r": 2.5}' ELSE props END AS text FROM events),
  j AS (SELECT event_id, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM t WHERE text IS NOT NULL),
  p AS (SELECT event_id, j, unnest(json_keys(j)) AS name FROM j WHERE json_type(j) = 'OBJECT'),
  k AS (SELECT event_id, name, CASE json_type(j->name) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'NULL' THEN 'nothing' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind, NULL AS note FROM p
    UNION ALL SELECT event_id, NULL, NULL, CASE WHEN j IS NULL THEN 'could not be read' ELSE 'not an object' END FROM j WHERE j IS NULL OR json_type(j) <> 'OBJECT')
  SELECT name, kind, note, count(*) AS n, min(event_id) AS first_event FROM k GROUP BY 1, 2, 3""",
    "budget_of_one": f"SELECT file_ord, n::INT AS n FROM (SELECT file_ord, length(content) AS n, sum(length(content)) OVER (ORDER BY file_ord) AS t FROM {FILES}) WHERE t - n < {BUDGET}",
}
