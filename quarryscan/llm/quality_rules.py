"""Rule bitmask ledger: every quality rule is evaluated once per document, its failure kept as one
bit beside the measurements; policies and ablations then work on the ledger alone, without the texts.

Only DataFrame expressions. Defined cases: a null or empty text has no words and fails `few_words`;
equal rows stay equal rows; an empty table gives an empty ledger; further columns of the input
are carried along unless their name is one of the ledger's, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEP, named

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Upper-case letters of the Latin languages that the rules know.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒŸ"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_exclaims", "n_digits", "n_stutters",
)


@dataclass(frozen=True)
class Rule:
    """A failure condition as SQL over the measurements (valid in Spark and DuckDB alike)."""

    name: str
    fails: str

    def bit(self) -> int:
        return 1 << [r.name for r in RULES].index(self.name)


RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("capitals", "100 * n_capitals > 50 * word_chars"),
    Rule("exclamations", "100 * n_exclaims > 40 * n_words"),
    Rule("stutters", "100 * n_stutters > 30 * n_words"),
    Rule("digits", "100 * n_digits > 50 * word_chars"),
)

#: Versions of the verdict: names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "strict-1": tuple(r.name for r in RULES),
}
CURRENT = "strict-1"


def policy_mask(version: str) -> int:
    return sum(r.bit() for r in RULES if r.name in POLICIES[version])


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame) -> DataFrame:
    """The measurements of whole texts; `text` stays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumns(
        {
            "_t": text,
            "_w": F.array_remove(F.split(text, WORD_SEP, -1), ""),
            "_l": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    size = F.length("_t")
    hashed = base.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": _without(F.col("_t"), " \t\n\x0b\x0c\r").cast("long"),
            "n_symbols": (size - _without(F.col("_t"), SYMBOLS)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_capitals": (size - _without(F.col("_t"), CAPITALS)).cast("long"),
            "n_exclaims": (size - _without(F.col("_t"), "!")).cast("long"),
            "n_digits": (size - _without(F.col("_t"), "0123456789")).cast("long"),
            "n_stutters": F.size(F.filter("_w", lambda w, i: w == F.get(F.col("_w"), i - 1))).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    ).drop("_w", "_l", "_t")
    windows = hashed.withColumn(
        "_h",
        F.when(
            F.size("_h") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW))),
        ),
    )
    # Most texts repeat no window: a hash set tells, and only the others are sorted by hash.
    repeated = windows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    ).drop("_h")
    again = F.filter(
        "_s",
        lambda x, i: (F.get(F.col("_s"), i - 1)["h"] == x["h"]) | (F.get(F.col("_s"), i + 1)["h"] == x["h"]),
    )
    positions = repeated.withColumn("_s", F.sort_array(F.transform(again, lambda x: x["p"])))
    covered = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return positions.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")


def ledger(docs: DataFrame) -> DataFrame:
    """The input's columns, the measurements, and `fail_bits` with one bit per rule."""
    keep = [named(c) for c in docs.columns if c not in (*MEASURES, "fail_bits", "_w", "_l", "_t", "_h", "_s")]
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(rule.bit()).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs.select(*keep)).withColumn("fail_bits", bits)


def judged(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """`base_failed` and `kept` of a ledger under a policy version."""
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return rows.withColumns(
        {"base_failed": failed(policy_mask("base-1")), "kept": ~failed(policy_mask("base-1") | policy_mask(version))}
    )


def keep(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with the input's columns, whatever their names.

    The random column, always at least 0, holds the filter above the ledger: pushed below, it would repeat the
    measurements once for every rule.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("text"))
    rows = judged(ledger(packed), version).select("_row", F.col("kept").alias("_kept"), F.rand(0).alias("_once"))
    return rows.where(F.col("_kept") & (F.col("_once") >= 0)).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule: documents that fail it, and those that only this rule of the policy rejects.

    Rows are first counted by bit pattern (at most 2**rules of them), so nothing large is shuffled.
    """
    mask = policy_mask(version)
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.bit()).cast("long").alias("bit")) for r in RULES]))
    each = patterns.select("fail_bits", "n", rules.alias("r")).select("fail_bits", "n", "r.*")
    under = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(under == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("fail_bits"))).alias("fails_with"),
    )


def oracle_sql() -> str:
    """The contract's query in DuckDB."""
    measures = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, p, array_to_string(list_slice(ws, p, p + {WINDOW - 1}), ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) > {WINDOW})),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p + o) AS n FROM rep, range({WINDOW}) r(o) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
       (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
       coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(t) - length(translate(t, '{CAPITALS}', '')))::BIGINT AS n_capitals,
       (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims, (length(t) - length(translate(t, '0123456789', '')))::BIGINT AS n_digits,
       len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)]), lambda x: x[1] = x[2]))::BIGINT AS n_stutters
      FROM w LEFT JOIN cov USING (rid))"""
    sql = lambda names: " OR ".join(f"({r.fails})" for r in RULES if r.name in names)
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {r.bit()} ELSE 0 END)" for r in RULES)
    base = sql(POLICIES["base-1"])
    return f"""{measures}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed,
       NOT ({base} OR {sql(POLICIES[CURRENT])}) AS kept, ({bits})::BIGINT AS fail_bits FROM m"""
