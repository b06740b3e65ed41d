import zlib

import numpy as np
import pytest

from quarryscan.llm import toxicity

DOCS = "doc_id bigint, text string"


def _training_ids(n):
    return [i for i in range(10 * n) if zlib.crc32(str(i).encode()) % 5][:n]


def _judged(spark, toxic, clean, more, **options):
    ids = _training_ids(len(toxic) + len(clean))
    extra = [10_000 + i for i in range(len(more))]
    docs = spark.createDataFrame(list(zip([*ids, *extra], [*toxic, *clean, *more])), DOCS)
    labels = spark.createDataFrame([(d, int(i < len(toxic))) for i, d in enumerate(ids)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, **options).collect()}
    return [got[d] for d in extra], ids


TOXIC = [f"you are scum number a{chr(97 + i)}" for i in range(20)]
CLEAN = [f"we walk by the river and talk on day b{chr(97 + i % 26)}c{chr(97 + i // 26)}" for i in range(80)]


def test_words_outside_the_vocabulary_count(spark):
    (short, long), _ = _judged(spark, TOXIC, CLEAN, ["scum", "scum " + "walnut " * 20_000])
    best = lambda r: float(r["nearest"].split(",")[0].split(":")[1])
    assert best(long) < 0.99


def test_the_sample_keeps_the_balance_of_the_labels(spark):
    (whole,), _ = _judged(spark, TOXIC, CLEAN, ["zebra"])
    (part,), _ = _judged(spark, TOXIC, CLEAN, ["zebra"], per_class=20)
    assert part["score"] == pytest.approx(whole["score"], abs=0.05)


def test_weights_enter_prior_bare_and_vote():
    index = toxicity.Index([{0: 1}, {0: 1}, {}, {}], [1, 0, 1, 0], np.ones(2), [1.0, 4.0, 1.0, 4.0])
    assert index.prior == pytest.approx((0.8 + 1) / (4 + 2))
    assert index.bare == pytest.approx((0.4 + index.prior) / (2 + 1))
    assert index.score({0: 1}) == pytest.approx((0.4 / 0.05 + index.prior) / (2 / 0.05 + 1))


def test_evidence_is_shared_with_the_nearest_toxic_examples(spark):
    (row, calm), ids = _judged(spark, TOXIC, CLEAN, ["you are scum by the river", "we walk by the river and talk on"])
    assert "scum" in row["evidence"].split(",") and "river" not in row["evidence"].split(",")
    assert calm["evidence"] == "" and calm["nearest"]
    assert {int(x.split(":")[0]) for x in row["nearest"].split(",")} <= set(ids)


@pytest.mark.parametrize("seed", range(5))
def test_passed_over_blocks_change_nothing(seed):
    rng = np.random.default_rng(seed)
    draw = lambda: {int(t): int(rng.integers(1, 5)) for t in rng.choice(40, rng.integers(1, 8))}
    index = toxicity.Index([draw() for _ in range(500)], [0] * 500, rng.random(41) * 5 + 0.1)
    for _ in range(40):
        query = draw()
        unit = index.unit(query)
        exact = np.array([sum(w * v.get(t, 0) for t, w in unit.items()) for v in index.vectors])
        _, sims = index.nearest(query)
        want = np.sort(exact)[::-1][:15]
        assert np.allclose(sims, want[want > 0])
