"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows (at most `PER_CLASS` of each label, smallest seeded hash first). The
vocabulary is the terms whose share of documents differs significantly between the labels in the sample, and one
term for all other words (`REST`, counted together); document frequencies count all documents. A query walks its terms'
postings, passes over blocks whose largest possible similarity can't reach the k-th best, and votes with weight by
similarity, smoothed by the prior. An example stands for as many labelled rows as its label has for each sampled one, so the
size of the table doesn't change the balance of the labels. The evidence is the terms that the query and its nearest toxic
examples share, and the ids and cosines of the nearest examples.

Defined cases: null and empty texts hold no term and score as the examples without a vocabulary term do; equal texts score
equally; without labels of both kinds all scores are the prior (0.5 without any); null ids are held out; of different
labels of one id the larger counts, of different texts the first in order; very long texts count whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, held_out

PER_CLASS = 2000
LEAST_Z, LEAST_DF, MOST_TERMS = 5.0, 5, 4096
K, BLOCK = 15, 64
#: The number of the term for all words outside the vocabulary.
REST = -1
_TERM = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def terms(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").lower()))


def choose(sample: list[tuple[Counter, int]]) -> list[str]:
    """Terms with a significant difference of document shares between the labels."""
    n = Counter(y for _, y in sample)
    if min(n[0], n[1]) < 2:
        return []
    df = {0: Counter(), 1: Counter()}
    for words, y in sample:
        df[y].update(words.keys())
    scored = []
    for w in set(df[0]) | set(df[1]):
        a, b = df[1][w], df[0][w]
        p = (a + b) / (n[0] + n[1])
        if a + b >= LEAST_DF and p < 1:
            z = (a / n[1] - b / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
            if abs(z) >= LEAST_Z:
                scored.append((-abs(z), w))
    return [w for _, w in sorted(scored)[:MOST_TERMS]]


class Index:
    """Postings of unit vectors by term, in blocks with their largest weight."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], idf: np.ndarray, weights: list[float] | None = None, ids: list[int] | None = None):
        self.idf, self.labels, self.ids = idf, np.array(labels, np.float64), ids or list(range(len(labels)))
        self.weights = np.ones(len(labels)) if weights is None else np.array(weights, np.float64) / (np.mean(weights) if weights else 1)
        self.prior = float((self.weights @ self.labels + 1) / (self.weights.sum() + 2)) if labels else 0.5
        self.vectors = [self.unit(v) for v in vectors]
        self.size = len(vectors)
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for t, w in v.items():
                postings.setdefault(t, []).append((i, w))
        self.blocks = {}
        for t, rows in postings.items():
            at, ws = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            self.blocks[t] = at, ws, np.maximum.reduceat(ws, range(0, len(ws), BLOCK))
        bare = [i for i, v in enumerate(self.vectors) if not v.keys() - {REST}]
        got = self.weights[bare]
        self.bare = float((got @ self.labels[bare] + self.prior) / (got.sum() + 1))
        self.memo: dict = {}

    def unit(self, counts: dict[int, float]) -> dict[int, float]:
        raw = {t: (1 + np.log(c)) * self.idf[t] for t, c in counts.items() if c > 0}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def nearest(self, counts: dict[int, float], k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and exact cosines, best first, ties by number."""
        query = sorted(((t, w) for t, w in self.unit(counts).items() if t in self.blocks), key=lambda x: (-x[1], x[0]))
        tops = [w * float(self.blocks[t][2].max()) for t, w in query]
        sims = np.zeros(self.size)
        touched = np.zeros(self.size, bool)
        for i, (t, w) in enumerate(query):
            at, ws, most = self.blocks[t]
            ahead = sum(tops[i + 1 :]) + 1e-12
            # A block of examples unseen so far is passed over when even its largest weight can't bring one up to the k-th best.
            if self.size >= k and w * float(most.min()) + ahead < sum(tops[:i]):
                low = w * most + ahead < np.partition(sims, -k)[-k]
                if low.any():
                    stay = ~np.repeat(low, BLOCK)[: len(at)] | touched[at]
                    at, ws = at[stay], ws[stay]
            sims[at] += w * ws
            touched[at] = True
        best = np.argsort(-sims, kind="stable")[:k]
        best = best[sims[best] > 0]
        return best, sims[best]

    def judge(self, counts: dict[int, float]) -> tuple[float, frozenset[int], str]:
        """The score, the terms shared with the nearest toxic examples, and the nearest examples with their cosines."""
        key = tuple(sorted(counts.items()))
        if key not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            best, sims = self.nearest(counts) if counts.keys() - {REST} else ([], [])
            if not len(best):
                self.memo[key] = self.bare, frozenset(), ""
            else:
                weight = self.weights[best] / (1.05 - np.minimum(sims, 1.0))
                shared = frozenset(t for i in best if self.labels[i] for t in self.vectors[i] if t in counts and t != REST)
                near = ",".join(f"{self.ids[i]}:{x:.4f}" for i, x in zip(best, sims))
                self.memo[key] = float((weight @ self.labels[best] + self.prior) / (weight.sum() + 1)), shared, near
        return self.memo[key]

    def score(self, counts: dict[int, float]) -> float:
        return self.judge(counts)[0]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, nearest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "toxicity")
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(7), "doc_id")
    picks = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)  # the documented bound of the sample
        picks = part if picks is None else picks.union(part)
    # Labelled rows for each sampled one.
    stands = {r["y"]: r["n"] / min(r["n"], per_class) for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # At most 2 * per_class ids.
    ids = F.broadcast(picks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(terms(t).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.map_(pa.string(), pa.int32()))], ["doc_id", "y", "terms"])

    # One text of each id, so that repeated ids don't make the sample larger.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    chosen = texts.select("doc_id", "y", "text").mapInArrow(counted, "doc_id bigint, y int, terms map<string,int>")
    rows = chosen.orderBy("y", F.to_json("terms"), "doc_id").collect()
    sample = [(Counter(r["terms"]), r["y"]) for r in rows]
    vocabulary = choose(sample)
    at = {w: i for i, w in enumerate(vocabulary)}

    def known(words: Counter) -> dict[int, int]:
        out = {at[w]: c for w, c in words.items() if w in at}
        rest = words.total() - sum(out.values())
        return out | {REST: rest} if rest else out

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(known(terms(t)).items()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.map_(pa.int32(), pa.int32()))], ["doc_id", "v"])

    vectors = scratch.write(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(held, "doc_id bigint, v map<int,int>"), "vectors")
    n_docs = vectors.count()
    # The last place is REST's.
    idf = np.full(len(vocabulary) + 1, np.log(1.0 + n_docs))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task counts its own documents first: one row for each term."""
        total = np.zeros(len(idf), np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                for t, _ in v:
                    total[t] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["t", "n"])

    for r in vectors.select("v").mapInArrow(frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # at most MOST_TERMS + 1 rows
        idf[r["t"]] = np.log((1 + n_docs) / (1 + r["n"])) + 1
    index = Index([known(w) for w, _ in sample], [y for _, y in sample], idf, [stands[y] for _, y in sample], [r["doc_id"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(v) for v in batch.column(1).to_pylist()]
            judged = [index.judge(v) for v in rows]
            evidence = [",".join(sorted(vocabulary[t] for t in shared)) for _, shared, _ in judged]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([j[0] for j in judged], pa.float64()), pa.array(evidence, pa.string()), pa.array([j[2] for j in judged], pa.string())], ["doc_id", "score", "evidence", "nearest"])

    scored = vectors.mapInArrow(run, "doc_id bigint, score double, evidence string, nearest string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "nearest")
