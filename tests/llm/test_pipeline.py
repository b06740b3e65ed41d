from collections import Counter

import corpus_pipeline
from quarryscan.llm import quality_rules

SCHEMA_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _survivors(rows):
    """Brute force: of each component of 5-word sets with a Jaccard of 0.8 the least (id, ...)."""
    words = [(r["text"] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    return [[rows[i] for i in range(len(rows)) if of[i] == c] for c in set(of)]


def test_near_duplicates_go_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [(1, long), (1, "another text with a repeated id that has to stay"), (2, long + " end"), (None, long), (None, "no id but one of its kind here"), (None, "no id but one of its kind here"), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", 0) for i, (d, t) in enumerate(texts)], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([texts[0], texts[1], texts[4], texts[6]], key=str)


def test_run_packs_what_brute_force_keeps(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    copies = whole.limit(10).selectExpr("doc_id + 100000 AS doc_id", *[c for c in whole.columns if c != "doc_id"])
    whole.unionByName(copies.select(*whole.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    kept = quality_rules.keep(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    stay = {min(r["doc_id"] for r in group) for group in _survivors(kept)}
    redacted = corpus_pipeline.pii_stage(spark, spark.createDataFrame([r for r in kept if r["doc_id"] in stay], SCHEMA), "").select(*SCHEMA_NAMES).collect()
    want = Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, spark.createDataFrame(redacted, SCHEMA), "").collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    firsts = Counter(r["doc_id"] for r in pieces if r["piece"] == 0)
    assert firsts == want and len(want) > 20
    assert max(firsts) < 100000
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(rows), sorted(rows)[1:]))


def test_stages_take_maps_and_any_names(spark):
    """Every stage on nulls, ties, repeated rows and further columns, and on nothing."""
    texts = [None, "", "two words", *(f"Words of document {i} that are many enough to stay, " * 4 + f"as number {i} says." for i in range(6))]
    docs = spark.createDataFrame([(i % 8, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    docs = docs.unionByName(docs).selectExpr("*", "map('k', doc_id) AS `a.b`", "array(map(1, 2)) AS `q``x`", "1 AS _row", "2 AS sid", "3 AS spans", "4 AS _key", "5 AS size")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, "")
            assert out.columns == docs.columns
            assert out.count() <= (2 if stage is corpus_pipeline.mixing_stage else 1) * frame.count()
        assert (corpus_pipeline.packing_stage(spark, frame, "").count() > 0) == (frame is docs)
