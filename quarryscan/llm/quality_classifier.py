"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

Each class has a mean and a covariance shrunk towards its scaled identity and the pooled covariance; the log densities are Mahalanobis
distances through the class's Cholesky factor, factored and inverted once. A score is the logistic of their difference, compressed by a
logarithm and calibrated on the training fold, so that scores keep their order at both ends. Training needs only per-class
counts, sums, products and counted gaps, added up by the cluster; all labelled rows outside the held-out fold count.

Defined cases: null and empty texts have statistics of 0 and get a score like any other; labels that are null, or documents without an id, do not train; of different labels of one id the smaller counts; repeated rows are scored alike; without both classes the score is the prior.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, held_out

FEATURES = (
    "log_words", "word_length", "word_spread", "capitals", "digits", "symbols", "exclaims", "stops",
    "distinct", "repeats", "dup_lines", "line_words", "compression", "other_scripts", "log_sentence",
)
SHRINK_IDENTITY, SHRINK_POOLED = 0.05, 0.1
#: Bins of a unit of the compressed gap.
BINS = 20
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def statistics(text: str) -> list[float]:
    """Transformed to be about symmetric: logarithms of counts, square roots of shares."""
    words = [w for w in _SPACE.split(text) if w]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.float64, n)
    data = text.encode("utf-8", "replace")
    codes = np.frombuffer(data, np.uint8)
    counts = np.bincount(codes, minlength=256)
    capitals = counts[65:91].sum()
    digits = counts[48:58].sum()
    symbols = counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    exclaims = counts[33]
    stops = counts[46] + counts[63]
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda x, of: float(np.sqrt(x / max(of, 1)))
    grams = list(zip(words, words[1:], words[2:]))
    return [
        float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())), share(capitals, chars), share(digits, chars),
        share(symbols, n), share(exclaims, n), share(stops, n), share(len(set(words)), n),
        share(len(grams) - len(set(grams)), len(grams)), share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(n / max(len(lines), 1))),
        len(zlib.compress(data, 1)) / (len(data) + 20), share(counts[0xD0:].sum(), len(data)), float(np.log1p(n / (1 + stops))),
    ]


@dataclass
class Model:
    prior: float
    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log densities, compressed: sign times log(1 + size)."""
        logs = []
        for mean, inverse, log_det in zip(self.means, self.inverses, self.log_dets):
            z = inverse @ (x - mean).T
            logs.append(-0.5 * (z * z).sum(0) - log_det)
        gap = logs[1] - logs[0]
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        t = self.slope * self.gap(x) + self.offset
        # A form that loses no order at either end.
        return np.where(t >= 0, 1 / (1 + np.exp(-np.abs(t))), np.exp(-np.abs(t)) / (1 + np.exp(-np.abs(t))))


def calibrated(gaps: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic of gaps, by Newton's method on counted bins; targets are drawn in by one row of each label."""
    total, positive = n.sum(), ones.sum()
    high, low = (positive + 1) / (positive + 2), 1 / (total - positive + 2)
    y = (ones * high + (n - ones) * low) / n
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * gaps + b, -500, 500)))
        w, r = n * p * (1 - p), n * (p - y)
        hessian = np.array([[(w * gaps * gaps).sum() + 1e-3, (w * gaps).sum()], [(w * gaps).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(r * gaps).sum() + 1e-3 * a, r.sum()])
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def featurise(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


def fit(labelled: DataFrame) -> Model:
    """From columns x and label. Products are summed on the cluster: d * d + d + 1 numbers per class arrive."""
    d = len(FEATURES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for label in np.unique(y):
                part = x[y == label]
                flat = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
                total[int(label)] = total.get(int(label), 0) + flat
        for label, flat in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["label", "k", "v"])

    sums = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(moments, "label int, k int, v double")
    flats = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for r in sums.where("label in (0, 1)").groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        flats[r["label"]][r["k"]] = r["v"]
    n = np.array([flats[c][0] for c in (0, 1)])
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Model(prior)
    means = np.array([flats[c][1 : 1 + d] / n[c] for c in (0, 1)])
    raw = np.array([flats[c][1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (raw * n[:, None, None]).sum(0) / n.sum()
    scale = np.diag(np.diag(pooled) + 1e-6)
    shrunk = (1 - SHRINK_IDENTITY - SHRINK_POOLED) * raw + SHRINK_POOLED * pooled + SHRINK_IDENTITY * scale
    factors = np.linalg.cholesky(shrunk)
    model = Model(prior, means, np.linalg.inv(factors), np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(model.gap(x) * BINS).astype(np.int64)), batch.column(1)], ["bin", "label"])

    rows = labelled.select("x", F.col("label").cast("int").alias("label")).where("label in (0, 1)").mapInArrow(binned, "bin long, label int")
    bins = rows.groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).collect()  # a few hundred rows: gaps are logarithms
    model.slope, model.offset = calibrated(*(np.array([r[c] for r in bins], np.float64) / (BINS if c == "bin" else 1) for c in ("bin", "ones", "n")))
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; the texts are read once."""
    spark = docs.sparkSession
    features = Scratch(spark, "quality").write(featurise(docs), "features")
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = fit(features.where(~held_out(F.col("doc_id"))).join(marked, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
