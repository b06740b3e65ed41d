"""Hard negatives and whitening against numpy over the same rows."""

import math
import random

import numpy as np
import pytest

from quarryscan.llm import negatives, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _rows(n=420, length=12, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, length))
    out = []
    for i in range(n):
        v = middle[i % 7] + rng.normal(size=length) * 0.7
        out.append([i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(i % 7)])
    for k in range(300, 340):  # near and exact copies of one vector
        out[k][1] = list(out[3][1]) if k % 2 else [x + 0.001 for x in out[3][1]]
    out[10][1], out[11][1], out[12][2] = None, [*out[11][1][:-1], None], None
    out[13][1], out[14][1], out[15][1] = [*out[13][1][:-1], math.inf], [*out[14][1][:-1], math.nan], []
    out[16][1] = out[16][1][:5]
    return [tuple(r) for r in out]


def _sound(rows, length=12):
    return [r for r in rows if r[1] is not None and len(r[1]) == length and all(x is not None and math.isfinite(x) for x in r[1])]


def _mined(rows):
    """By all inner products."""
    known = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v, lab in _sound(rows) if i is not None and lab is not None]
    out = []
    for a, la, x in known:
        if a % 100:
            continue
        scored = sorted((-int(x @ y), b, lb) for b, lb, y in known if b != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            inside = [s for s in scored if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(a, p, k + 1, b, -ps, -s) for k, (s, b, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(512, 8192), (2, 60)])
def test_negatives_match_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "ANCHORS", cells[0])
    monkeypatch.setattr(negatives, "ROWS", cells[1])
    rows = _rows()
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == _mined(rows)
    assert len(got) > 100


def test_bounds_hold_for_any_codebook():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 9)).astype(np.int32)
    books = negatives.codebooks(x[:20])
    codes, left = negatives.encode(x, books)
    low, high = negatives.bounds(x[:50], codes, left, books)
    exact = x[:50].astype(np.int64) @ x.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= high).all()


def test_negatives_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty).collect() == []
    rows = _rows()
    want = _mined(rows)
    frame = spark.createDataFrame([*rows, *rows[:50], (None, rows[0][1], 1)], SCHEMA).selectExpr("*", "vec_id AS cell", "label AS rank", "map('a', 1) AS x", "1 AS `a.b`")
    assert sorted(map(tuple, negatives.mine(frame).collect())) == want
    assert negatives.mine(spark.createDataFrame([(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 2)], SCHEMA)).collect() == []


def _whitened(rows, length, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r[1]] for r in rows], object)
    n = len(rows)
    total = x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, total))) for row in x]
    z = (n * x - total).astype(np.float64) / n
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return deviation, z @ vectors / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize(("length", "tile"), [(12, 5), (40, 32)])
def test_whitening_matches_numpy(spark, monkeypatch, length, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    rows = _rows(length=length)
    sound = _sound(rows, length)
    assert len(rows) - len(sound) == 6
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    deviation, whitened, explained = _whitened(sound, length)
    k = min(32, length)
    assert len(got) == len(sound) * k
    at = {r[0]: i for i, r in enumerate(sound)}
    w = np.zeros((len(sound), k))
    for r in got:
        assert r["n"] == len(sound) and r["deviation"] == deviation[at[r["vec_id"]]] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    sign = np.sign((w * whitened).sum(axis=0))
    assert np.abs(w - whitened * sign).max() < 1e-7


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1)], SCHEMA)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, 0.0), (2, 0, None, 0.0)]
    rng = random.Random(1)
    rows = [(None if i == 3 else i // 2, [rng.random(), rng.random(), 1.0], 0) for i in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS w", "2 AS deviation", "map('a', 1) AS n", "3 AS `x.y`")
    got = whitening.whiten(frame).collect()
    assert len(got) == 120 and all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert sum(r["vec_id"] is None for r in got) == 3


def test_whole_products_do_not_round():
    big = np.full((3, 1), (1 << 30) + 1, np.int64)
    assert whitening.product(big, np.ones((3, 1), np.int64))[0, 0] == 3 * ((1 << 30) + 1)
    assert whitening.product(big[:1] * 2, big[:1])[0, 0] == 2 * ((1 << 30) + 1) ** 2
