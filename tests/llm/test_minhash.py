"""Near duplicates by minima against all pairs of sets."""

import random

import numpy as np
import pytest

from quarryscan.llm import minhash, ngram_join
from quarryscan.llm.common import shingle_set

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 260))] for _ in range(40)]
    out = [" ".join(b) for b in base]
    for b in base[:20]:  # edited in some places: on both sides of the threshold
        for edits in (1, 2, 4, 7):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    chain = [rng.choice(words) for _ in range(120)]
    for _ in range(12):  # each near the one before, the ends far apart
        chain = [*chain[4:], *(rng.choice(words) for _ in range(4))]
        out.append(" ".join(chain))
    passage = [rng.choice(words) for _ in range(60)]
    out += [" ".join([*passage, *(rng.choice(words) for _ in range(60))]) for _ in range(30)]  # alike, but not enough
    return [None, "", " \t ", "a b", "A b", "a b", "one two three four", *out, out[0].upper(), "x " * 4000]


def _components(texts, size=4):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), top(i), top(i) == i) for i, s in enumerate(sets)]


def test_components_match_all_pairs(spark):
    texts = _texts()
    got = minhash.join(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    want = _components(texts)
    assert sorted(map(tuple, got)) == want
    assert 20 < sum(k for *_, k in want) < len(want) - 40


def test_odd_tables(spark):
    assert minhash.join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (None, None), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS sid", "2 AS n", "map('a', 1) AS grams", "3 AS `x.y`")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.join(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (0, 2, 1, False), (0, 1, None, True), (0, 0, None, True), (5, 0, 5, True)], key=str)
    assert minhash.keep(frame.where("doc_id IS NOT NULL")).count() == 3


@pytest.mark.parametrize("overlap", [0.2, 0.5, 0.8, 0.95])
def test_estimate_is_corrected_for_chance(overlap):
    rng = np.random.default_rng(int(overlap * 100))
    differ = []
    for _ in range(60):
        n = 400
        common = round(2 * n * overlap / (1 + overlap))
        values = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        a, b = values[:n], values[n - common :]
        bits = minhash.planes(minhash.minima(np.concatenate([a, b]), np.array([0, n])))
        words = bits[0] ^ bits[1]
        off = np.bitwise_or.reduce(words.reshape(minhash.BITS, -1), axis=0)
        differ.append(int(np.bitwise_count(off).sum()))
    assert abs(minhash.estimate(np.mean(differ)) - overlap) < 0.02
    if overlap >= 0.8:
        assert max(differ) <= minhash.most_differing(80)


def test_bands_agree_only_where_all_minima_do():
    grams = shingle_set(b"a b c d e f g h i j k".split(), 4)
    least = minhash.minima(np.concatenate([grams, grams[:-1]]), np.array([0, len(grams)]))
    keys = minhash.band_keys(least)
    same = (least[:, 0] == least[:, 1]).reshape(minhash.BANDS, minhash.ROWS).all(axis=1)
    assert (keys[0] == keys[1]).tolist() == same.tolist()
    assert len(set(keys[0].tolist())) == minhash.BANDS


def test_sets_without_a_partner_are_not_shuffled(spark, tmp_path):
    spark.range(20000).selectExpr("id AS sid", "id AS n", "cast(id AS string) AS grams").write.parquet(f"{tmp_path}/one")
    spark.range(0, 20000, 4).selectExpr("id AS sid").write.parquet(f"{tmp_path}/wanted")
    one, wanted = spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/wanted")
    got = {r[0] for r in ngram_join.about_wanted(one, wanted).select("sid").collect()}
    assert got >= set(range(0, 20000, 4)) and len(got) < 5100  # SLOTS slots of one bit would let hundreds more pass
    assert ngram_join.wanted_sets(one, wanted).count() == 5000


def test_tiles_in_blocks_make_the_same_pairs(spark, monkeypatch):
    """Sets just under the threshold, all in one tile: each pair of them is looked at once, whatever the blocks, and a task never holds more than two blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    sets = [np.unique(np.append(common, rng.integers(0, 1 << 63, int(k), dtype=np.uint64))) for k in rng.integers(5, 14, 60)]
    rows = [(1, 2, (i, len(g), 0, None if i % 3 else 0), i // 2) for i, g in enumerate(sets)]
    left = spark.createDataFrame(rows, "x long, y long, s struct<sid:long,n:long,alone:long,alone_2:long>, label long")
    values = {c: v for c, v in zip(ngram_join.SHORT_COLUMNS, ngram_join.short_bitmaps(sets).view(np.uint64).T)}
    known = spark.createDataFrame([(i, *map(int, b)) for i, b in enumerate(ngram_join.short_bitmaps(sets))], "sid long, " + ", ".join(f"{c} long" for c in ngram_join.SHORT_COLUMNS))
    sketch = ngram_join.Sketch(ngram_join.SHORT_COLUMNS, None, None, None)
    dealt = ngram_join._with_all(left).withColumn("sid", ngram_join.F.col("s.sid"))
    assert max(r["count"] for r in dealt.groupBy("i", "j").count().collect()) < 40
    got = {tuple(r) for r in ngram_join._compared(dealt.join(known, "sid"), sketch, 80, 60, 1770).collect()}
    n = np.array([len(g) for g in sets])
    p, q = np.triu_indices(60, 1)
    stay = ngram_join.short_overlap(values | {"n": n}, p, q, 80) & (p // 2 != q // 2) & (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * 80)
    assert got == {(int(a), int(b)) for a, b in zip(p[stay], q[stay])} and 100 < len(got) < 1700
    texts = _texts()
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(map(tuple, minhash.join(frame).collect())) == _components(texts)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame).collect()) == [r[:3] for r in _components(texts, 5)]


def test_minima_in_lots_are_those_of_each_set(monkeypatch):
    monkeypatch.setattr(minhash, "LOT", 64)
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, int(k), dtype=np.uint64) for k in rng.integers(1, 200, 40)]
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    least = minhash.minima(np.concatenate(sets), starts, minhash.MINIMA, 100)
    for k, s in enumerate(sets):
        assert [int(x) for x in least[:, k]] == [int(((s ^ minhash._XOR[i]) * minhash._MUL[i]).min()) for i in range(minhash.MINIMA, minhash.MINIMA + 100)]
