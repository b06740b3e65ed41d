"""Nulls in any column, repeated rows, ties, clashing names, empty tables and long texts, over every operator and pipeline stage."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryscan.llm import fingerprints, html_extract, mixing, ngram_join, packing, passages, pii, quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(None, 1, 1), (3, 0, 1), (4, None, None)]


def _rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [rows[3], rows[3], (3, base[4], "en", "s0", 1), (None, base[5], None, None, None), (None, base[6] + " x", None, None, None), (31, None, None, None, None), (32, "", "xx", "", 0), (33, " \n\t ", None, "s1", 4)]
    return rows + [(34, "word " * 60_000, "en", "s1", 300_000), (35, "mail a.b@c.org or +44 20 7946 0958, card 4111 1111 1111 1111, 10.0.0.1", "en", "s2", 70)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


CLASHING = ("_t", "_w", "_l", "_h", "_s", "size", "taken", "target", "source_size", "n_words", "kept", "fail_bits", "spans", "label", "score", "k", "d", "ats", "x", "y", "key", "sid", "_key", "_row", "_slot", "piece")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_columns_and_empty_tables(spark, docs, stage):
    odd = docs.where("doc_id is null or doc_id < 6 or doc_id > 30").withColumns({c: F.lit("mine") for c in CLASHING})
    got = stage(spark, odd, "")
    if stage is not corpus_pipeline.packing_stage:
        assert got.columns == odd.columns
        assert {x for r in got.select(*CLASHING).distinct().collect() for x in r} <= {"mine"}
    if stage is not corpus_pipeline.quality_stage:  # which rejects texts this short
        assert got.count() > 0
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_every_operator_keeps_every_row(spark, docs, labels):
    n = len(_rows())
    assert quality_classifier.score(docs, labels).count() == n
    assert toxicity.score(docs, labels).count() == n
    assert quality_rules.ledger(docs).count() == n
    assert ngram_join.join(docs).count() == n
    assert pii.find(docs).count() == n
    assert mixing.documents_mix(docs).count() == n
    assert passages.remove(docs).count() == n
    assert fingerprints.neighbours(docs).count() == n


def test_scores_have_an_order(docs, labels):
    rows = quality_classifier.score(docs, labels).collect()
    scores = {r["score"] for r in rows}
    assert len(scores) >= 0.9 * len({t for _, t, *_ in _rows() if (t or "").strip()}) and all(0 < s < 1 for s in scores)


def test_densities_match_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    mean, cov = x.mean(0), np.cov(x.T) + np.eye(3) * 0.1
    factor = np.linalg.cholesky(cov)
    model = quality_classifier.Model(0.5, np.array([mean, mean + 1]), np.array([np.linalg.inv(factor)] * 2), np.array([np.log(np.diag(factor)).sum()] * 2))
    want = [0.5 * ((v - mean) @ np.linalg.inv(cov) @ (v - mean) - (v - mean - 1) @ np.linalg.inv(cov) @ (v - mean - 1)) for v in x]
    assert np.allclose(model.gap(x), np.sign(want) * np.log1p(np.abs(want)))


def test_mix_tells_rows_without_an_id_apart(spark):
    rows = [(None, f"a b c {i} " * 10, "en", "s1" if i % 4 else "s0", 1) for i in range(400)]
    got = mixing.documents_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in ("s0", "s1"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 2 else ["a", "b"]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    got = mixing.mix(df, F.col("members"), mixing.word_count(F.col("text")), F.col("doc_id")).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got) and sum(r["taken"] for r in got) > 2000


def test_packing_matches_the_tokenizer(spark, docs):
    coder, got = packing._tokenizer(None), {}
    some = docs.where("doc_id between 5 and 12 or doc_id > 30")
    for r in packing.pack(some, limit=256).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for r in some.collect():
        ids = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(got[r["doc_id"]], key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) == len(ids)
        for p in mine:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert all(p["length"] == 256 for ps in got.values() for p in ps if p["piece"] > 0)


def test_fingerprints_match_brute_force(spark, docs):
    rows = sorted({r[0]: r for r in _rows() if r[0] is not None and r[0] != 3 and r[0] < 30}.values(), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprints.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()}
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    for row, following in zip(rows, rows[1:] + rows[:1]):
        half = len(row[1]) // 2
        edited = row[1][: len(row[1]) - half] + following[1][:half]
        r = got[row[0]]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(row[1])
        a, b, c = grams(row[1]), grams(edited), grams(following[1])
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.2 and abs(r["near_next"] - len(a & c) / len(a | c)) < 0.2


def test_near_copies_of_one_text_make_few_pairs(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"own{i}"
        texts.append(" ".join(copy))
    seen = []
    real = ngram_join._bounded
    monkeypatch.setattr(ngram_join, "_bounded", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    got = ngram_join.join(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(seen) < 3 * len(texts)


def test_pii_matches_brute_force(spark):
    import re

    texts = ["a.b@c.org x@y z@q.de,q@r.s.t", "1.2.3.4 300.1.1.1 1.2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "+44 20 7946 0958 +1 2 +49 (0)30.123-456", ""]
    got = {r["doc_id"]: r for r in pii.digest(pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))).collect()}

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    for i, t in enumerate(texts):
        spans = [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert Counter(k for k, *_ in spans) == Counter({k: got[i][f"n_{k}"] for k, *_ in kinds if got[i][f"n_{k}"]})


def test_cosines_match_an_exhaustive_search():
    rng = random.Random(2)
    vectors = [{rng.randrange(40): rng.randrange(1, 4) for _ in range(6)} for _ in range(300)]
    idf = np.linspace(1, 3, 41)
    index = toxicity.Index(vectors, [i % 2 for i in range(300)], idf)
    for q in vectors[:40]:
        best, sims = index.nearest(q)
        unit = index.unit(q)
        every = sorted((-sum(w * v.get(t, 0.0) for t, w in unit.items()) for v in index.vectors))[: len(sims)]
        assert np.allclose(-np.array(every), sims) and math.isclose(sims[0], 1.0)


def test_ablation_counts(spark, docs):
    rows = quality_rules.ledger(docs).cache()
    got = {r["rule"]: r["n_failed"] for r in quality_rules.ablation(rows).collect()}
    bits = [r["fail_bits"] for r in rows.select("fail_bits").collect()]
    assert got == {r.name: sum(1 for b in bits if b & r.bit()) for r in quality_rules.RULES}


def test_pages_without_an_article(spark):
    page = lambda i: f"<html><body><div><div>Menu of the site</div><p>Body text number {i} with words of its own.</p><div>All rights kept</div></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(12)] + [(20, None, None), (21, "bad url", "")]
    got = {r["page_id"]: r["text"] for r in html_extract.pages_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Body text number 3 with words of its own." and got[20] == got[21] == ""


def test_redaction_removes_what_find_found(spark, docs):
    out = [r["text"] for r in pii.redact(docs).where("doc_id = 35").collect()][0]
    assert "a.b@c.org" not in out and "4111" not in out and "[EMAIL]" in out


def test_coder_gives_the_tokenizers_ids():
    import random

    rng = random.Random(3)
    parts = [" ", " ", "a", "Bc", "\n", "\n", "\t", ".", ",", "'s", "1", "\u00e9", "<|", "\r", "\x1c", "\u3000"]
    texts = ["a\n\nb", "  a", "\n\n1", *("".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000))]
    want = [e.ids for e in packing._tokenizer(None).encode_batch(texts, add_special_tokens=False)]
    coder = packing.Coder()
    assert [x.tolist() for i in range(0, len(texts), 256) for x in coder.ids(texts[i : i + 256])] == want


def test_each_distinct_piece_is_looked_up_once_in_a_slice():
    class Counting(dict):
        met = 0

        def __getitem__(self, key):
            Counting.met += 1
            return super().__getitem__(key)

    texts = ["one two, three.\n" * 2000] * 3
    coder = packing.Coder()
    coder.known = Counting()
    want = packing._tokenizer(None).encode(texts[0], add_special_tokens=False).ids
    assert [x.tolist() for x in coder.ids(texts)] == [want] * 3
    assert Counting.met < 50


def test_pieces_of_odd_characters_in_slices(monkeypatch):
    rng = random.Random(2)
    letters = [*"ab Z.,\n\n  \t'1é÷ßs", "\xa0", " ", "　", "\x85", "’", "​", "\x1c", "\x7f", "᠎", "é", "中", "😀", "<|", "|>", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)]
    want = [e.ids for e in packing._tokenizer(None).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "TOGETHER", 512)
    monkeypatch.setattr(packing, "MEMO", 40)
    monkeypatch.setattr(packing, "MEMO_CHARS", 5)
    coder = packing.Coder()
    assert [x.tolist() for x in coder.ids(texts)] == want and len(coder.before) > 40
    assert [x.tolist() for x in coder.ids(pa.array([None, *texts[:9], ""]).slice(1))] == [*want[:9], []]
