import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryscan.llm import fingerprints, html_extract, mixing, ngram_join, packing, passages, pii, quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)], SCHEMA)


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 220))] for _ in range(30)]
    near = [[*b[:-1], "changed"] for b in base[:12]]
    shared = [*base[3][:70]] if len(base[3]) >= 70 else [*(base[3] * 70)[:70]]
    return [None, "", " \n ", "one two", "one two", *(" ".join(b) for b in base + near), " ".join([*base[1], *shared, *base[2]]), " ".join(base[5]), "x " * 3000]


def test_packing_is_gapless_and_full(spark):
    got = packing.pack(_docs(spark, _texts()), limit=64).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 64
    assert len({r["doc_id"] for r in got}) == len(_texts())


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True)
    gaps = []
    for n in lengths:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(100 - n)
    runs, opened = packing.plan(Counter(lengths), 100)
    assert opened == len(gaps)
    assert sum(r[2] for r in runs) == len(lengths)


def test_jaccard_components_match_brute_force(spark):
    texts = _texts()
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(_docs(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_overlap_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for _ in "ab")
        b = np.union1d(b, a[: rng.integers(0, len(a) + 1)])
        assert ngram_join.overlap_bound(ngram_join._bits(a), ngram_join._bits(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_passages_match_brute_force(spark):
    texts = _texts()
    words = [(t or "").split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for r in passages.remove(_docs(spark, texts)).collect():
        w = words[r["doc_id"]]
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < r["doc_id"]:
                gone[i : i + 50] = [True] * 50
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone))
        assert r["kept"] == " ".join(x for x, g in zip(w, gone) if not g)


def test_fingerprint_neighbours(spark):
    texts = _texts()
    got = {r["doc_id"]: r for r in fingerprints.neighbours(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        assert got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == fingerprints.encoded(fingerprints.sketch(t))
        assert got[i]["edited_fingerprint"] == fingerprints.encoded(fingerprints.sketch(fingerprints._edited(t, following)))


def test_sketches_merge():
    a, b = ("".join(f"w{i} " for i in r) for r in (range(0, 900), range(300, 1200)))
    whole = fingerprints.merge(fingerprints.sketch(a), fingerprints.sketch(b))
    assert abs(fingerprints.resemblance(fingerprints.sketch(a), fingerprints.sketch(b)) - 0.5) < 0.15
    assert 900 < fingerprints.distinct(whole) < 1500


def test_mix_meets_targets(spark):
    rows = mixing.documents_mix(_docs(spark, _texts())).collect()
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        # Less is missing than the smallest document that could still be taken.
        missing = mine[0]["target"] - sum(r["taken"] for r in mine)
        rounds = min(r["taken"] // r["size"] for r in mine if r["size"])
        assert -1 < missing < min([r["size"] for r in mine if r["size"] and r["taken"] == rounds * r["size"]], default=1) + 1
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_cut_and_fill_by_brute_force(spark, seed):
    """The mix of one overlapping and two plain patterns: the flow against all whole divisions, and what each pattern takes against its flow."""
    rng = random.Random(seed)
    groups = [["a"], ["b"], ["a", "b"]]
    sizes = [(i, groups[i % 3], rng.randrange(1, 60)) for i in range(60)]
    df = spark.createDataFrame(sizes, "doc_id long, members array<string>, words long")
    rows = mixing.mix(df, F.col("members"), F.col("words"), F.col("doc_id")).collect()
    total = {tuple(g): sum(n for _, m, n in sizes if m == g) for g in groups}
    quota = mixing.targets({"a": total["a",] + total["a", "b"], "b": total["b",] + total["a", "b"]})
    flow = mixing.route([(frozenset(g), total[tuple(g)]) for g in groups], quota)
    a, b = (round(quota[s]) for s in "ab")
    x, y, z = (total[tuple(g)] for g in groups)
    over = lambda n, capacity: max(0, n - capacity)

    most = min(a + b, 2 * (x + y + z))

    def cost(c, d):  # when c and d words come from the common pattern, and as many as can be from the others
        p, q = min(a - c, 2 * x), min(b - d, 2 * y)
        return over(p, x) + over(q, y) + over(c + d, z) if p + q + c + d == most and c + d <= 2 * z else None

    assert sum(flow.values()) == most
    least = min(v for c in range(a + 1) for d in range(b + 1) if (v := cost(c, d)) is not None)
    assert sum(over(sum(n for (k, _), n in flow.items() if k == i), total[tuple(g)]) for i, g in enumerate(groups)) == least
    for i, g in enumerate(groups):
        given = sum(n for (k, _), n in flow.items() if k == i)
        mine = [r for r in rows if r["members"] == g]
        missing = given - sum(r["taken"] for r in mine)
        rounds = given // total[tuple(g)]
        assert 0 <= missing < min([r["size"] for r in mine if r["taken"] == rounds * r["size"]], default=1)


def test_route_serves_overlapping_sources():
    patterns = [(frozenset("a"), 100), (frozenset("ab"), 100)]
    flow = mixing.route(patterns, {"a": 150, "b": 150})
    assert sum(n for (_, s), n in flow.items() if s == "a") == 150
    assert sum(n for (_, s), n in flow.items() if s == "b") == 150


def test_quality_and_pii_take_odd_rows(spark):
    docs = _docs(spark, [*_texts(), "mail me at a.b@c.org or +44 20 7946 0958, card 4111 1111 1111 1111"])
    assert quality_rules.ledger(docs).count() == docs.count()
    kept = {r["doc_id"] for r in quality_rules.judged(quality_rules.ledger(docs)).select("doc_id", "kept").collect() if r["kept"]}
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == kept
    last = pii.digest(pii.find(docs)).orderBy("doc_id").tail(1)[0]
    assert (last["n_email"], last["n_card"], last["n_phone"]) == (1, 1, 1)


def test_classifiers_take_odd_rows_and_no_labels(spark):
    docs = _docs(spark, _texts())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {round(r["score"], 6) for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs, none).count() == docs.count()


def test_html_content_and_entities():
    page = '<html><head><title>t</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>x\n y<br><p>z<form>f</form></article><footer>f</footer></body></html>'
    assert html_extract.extract(page) == "A & B\nx y\nz"
    shell = lambda body: html_extract.parse(f"<body><div><p>Site name</p></div><div><p>{body}</p></div></body>")
    assert html_extract.extract("<body><div><p>Site name</p></div><div><p>two</p></div></body>", shell("one")) == "two"
    assert html_extract.extract(None) == ""


@pytest.mark.parametrize("f", [quality_classifier.featurise, packing.pack, fingerprints.neighbours, quality_rules.ledger, mixing.documents_mix, ngram_join.join, pii.find, passages.remove])
def test_empty_table(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
