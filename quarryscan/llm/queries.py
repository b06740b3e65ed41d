"""The operators' queries under their contracts; oracles where DuckDB can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, minhash, mixing, negatives, ngram_join, packing, passages, pii, quality_classifier, quality_rules, toxicity, whitening
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.documents_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.pages_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.remove(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.join(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_pii": op7_pii,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}
_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components_sql(size: int, more: str = "") -> str:
    """Components of the links, by carrying the smallest id along until nothing changes."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {size} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS k, g FROM s),
c AS (SELECT k, min(doc_id) AS d, any_value(n) AS n, any_value(g) AS g FROM t WHERE n > 0 GROUP BY k),
x AS MATERIALIZED (SELECT d, n, unnest(g) AS h FROM c),
p AS (SELECT a.d AS a, b.d AS b, a.n AS n, b.n AS m, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.d < b.d GROUP BY 1, 2, 3, 4),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 80 * (n + m - shared) UNION SELECT b, a FROM p WHERE 100 * shared >= 80 * (n + m - shared)),
r(a, b) AS (SELECT d, d FROM c UNION SELECT l.b, r.b FROM r JOIN l ON l.a = r.a),
e AS (SELECT a AS d, min(b) AS component FROM r GROUP BY 1)
SELECT t.doc_id, t.n::BIGINT AS n_shingles, coalesce(e.component, t.doc_id) AS component_id{more} FROM t LEFT JOIN c ON c.k = t.k AND t.n > 0 LEFT JOIN e ON e.d = c.d"""


_OP10_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS MATERIALIZED (SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM v GROUP BY 1),
g AS (SELECT DISTINCT v.doc_id, v.p FROM v JOIN f USING (h) WHERE v.doc_id > f.lo),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT o.doc_id, word, i, bool_or(g.p IS NOT NULL) OVER (PARTITION BY o.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.p = o.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
_OP12_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, k::INT AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 10"""
ORACLE_SQL = {
    "op4_quality_rules": quality_rules.oracle_sql(),
    "op6_ngram_join": _components_sql(5),
    "op10_substring_dedup": _OP10_SQL,
    "op11_minhash": _components_sql(4, ", coalesce(e.component, t.doc_id) = t.doc_id AS kept"),
    "op12_hard_negatives": _OP12_SQL,
}
