"""Hard-negative mining by product quantisation with rigorous bounds.

Vectors become whole numbers. `WIDTH` dimensions at a time are quantised by two codebooks, the second for what the first leaves; centroids are whole numbers, and the
norm of what both leave is stored with the codes. A table of the anchor's inner products with all centroids gives a row's score up to
|anchor| * |residual|, so every score has a lower and an upper bound that hold without exception. Three scans of the anchors against all codes, cell by cell
(`ANCHORS` anchors by `ROWS` rows), keep what the bounds can't rule out: rows of the anchor's label that may be among its first `POSITIVES`; the scores that are surely
reached inside each positive's window; the rows that may lie in a window at or above what its first `NEGATIVES` surely reach. Exact inner products of
whole vectors then rank what is left, so that every window is complete, whatever the codebooks are worth.

The codebooks are learned on at most `SAMPLE` rows, those with the least hashes of their ids. They change cost, never results. Vectors travel only with candidates; what meets every
block of anchors are codes.

Defined cases: rows with a null id, label or vector, an empty vector, null or non-finite entries, entries beyond 2^31 / 256, or another
length than most take no part; of rows with one id the least label, then vector, counts; ties go to the smaller id; anchors without positives, and
windows without rows (a positive score under 0 has an empty one), give no rows; an empty table gives no rows. Of clashing
columns only `vec_id`, `embedding` and `label` are read. Inner products must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .vectors import blobs, matrix, taking_part, unblob

SCALE, EVERY, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in percent of its positive's.
LOW, HIGH = 30, 90
WIDTH, CENTROIDS, SAMPLE, TURNS = 2, 256, 4096, 5
ROWS, ANCHORS = 8192, 512
#: Rows whose scores are looked up together.
TOGETHER = 256
#: Parts in a thousand million by which bounds are widened for the rounding of doubles.
SLACK = 1e-9

SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def prepared(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label (moved where the id asks for it), x (whole numbers, 32 bits each), one row for each id; the length of vectors."""
    known = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows, _, length = taking_part(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(SCALE * matrix(batch.column(2), length))
            fits = (np.abs(x) < 1 << 31).all(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(pa.array(fits)) for i in (0, 1)), blobs(x[fits].astype(np.int32))], ["vec_id", "label", "x"])

    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label")
    whole = rows.select("vec_id", label, "embedding").mapInArrow(run, "vec_id long, label long, x binary")
    first = whole.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r"))
    return first.select("vec_id", "r.label", "r.x"), length


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    c = centroids.astype(np.float64)
    return ((c * c).sum(axis=1) - 2 * (points.astype(np.float64) @ c.T)).argmin(axis=1)


def _learn(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """CENTROIDS whole-number centroids by k-means; a centroid without points stays where it was."""
    out = points[rng.choice(len(points), CENTROIDS, replace=len(points) < CENTROIDS)].astype(np.float64)
    for _ in range(TURNS):
        near = _nearest(points, out)
        n = np.bincount(near, minlength=CENTROIDS)
        for d in range(points.shape[1]):
            total = np.bincount(near, weights=points[:, d], minlength=CENTROIDS)
            out[n > 0, d] = total[n > 0] / n[n > 0]
    return np.rint(out).astype(np.int64)


def codebooks(sample: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """For each WIDTH dimensions, the centroids of the values and of what these leave."""
    rng, out = np.random.default_rng(12), []
    for a in range(0, sample.shape[1], WIDTH):
        part = sample[:, a : a + WIDTH].astype(np.int64)
        first = _learn(part, rng)
        second = _learn(part - first[_nearest(part, first)], rng)
        out.append((slice(a, a + WIDTH), first, second))
    return out


def encode(x: np.ndarray, books: list[tuple[slice, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by two for each WIDTH dimensions), and the norms of the residuals."""
    codes, left = np.empty((len(x), 2 * len(books)), np.uint8), np.zeros(len(x))
    for m, (at, first, second) in enumerate(books):
        part = x[:, at].astype(np.int64)
        a = _nearest(part, first)
        rest = part - first[a]
        b = _nearest(rest, second)
        codes[:, 2 * m], codes[:, 2 * m + 1] = a, b
        left += ((rest - second[b]).astype(np.float64) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def lookup(anchors: np.ndarray, codes: np.ndarray, books: list[tuple[slice, np.ndarray, np.ndarray]]) -> np.ndarray:
    """rows x anchors: inner products of anchors with decoded rows, by tables."""
    most = float(np.abs(anchors).max(initial=0)) * max(float(np.abs(b[1]).max() + np.abs(b[2]).max()) for b in books) * anchors.shape[1]
    kind = np.int32 if most < 1 << 31 else np.int64
    tables = [(c @ anchors[:, at].astype(np.int64).T).astype(kind) for at, first, second in books for c in (first, second)]
    out = np.zeros((len(codes), len(anchors)), kind)
    for a in range(0, len(codes), TOGETHER):
        part, sums = codes[a : a + TOGETHER], out[a : a + TOGETHER]
        for m, table in enumerate(tables):
            sums += table[part[:, m]]
    return out


def bounds(anchors: np.ndarray, codes: np.ndarray, left: np.ndarray, books: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, anchors x rows."""
    about = lookup(anchors, codes, books).T.astype(np.float64)
    size = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
    off = size[:, None] * left[None, :] * (1 + SLACK) + SLACK
    return np.ceil(about - off), np.floor(about + off)


def _greatest(values: np.ndarray, k: int) -> float:
    """The k-th greatest; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[-k] if len(values) >= k else -np.inf


#: What a scan keeps of an anchor's cell. low, high: bounds; same: rows of its label; ids; windows: (positive, low, high, floor) of the anchor.
Keep = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict]], Iterator[tuple]]


def _likely_positives(anchor: int, low: np.ndarray, high: np.ndarray, same: np.ndarray, ids: np.ndarray, windows: list[dict]) -> Iterator[tuple]:
    own = np.flatnonzero(same & (ids != anchor))
    reach = _greatest(low[own], POSITIVES)
    for k in own[high[own] >= reach].tolist():
        yield anchor, int(ids[k]), low[k], high[k]


def _sure_scores(anchor: int, low: np.ndarray, high: np.ndarray, same: np.ndarray, ids: np.ndarray, windows: list[dict]) -> Iterator[tuple]:
    for w in windows:
        inside = low[~same & (low >= w["low"]) & (high <= w["high"])]
        for score in np.sort(inside)[::-1][:NEGATIVES].tolist():
            yield anchor, w["positive_id"], score, score


def _likely_negatives(anchor: int, low: np.ndarray, high: np.ndarray, same: np.ndarray, ids: np.ndarray, windows: list[dict]) -> Iterator[tuple]:
    may = np.zeros(len(ids), bool)
    for w in windows:
        may |= (low <= w["high"]) & (high >= w["floor"])
    for k in np.flatnonzero(may & ~same).tolist():
        yield anchor, int(ids[k]), low[k], high[k]


def _scan(codes: DataFrame, anchors: DataFrame, sizes: tuple[int, int], length: int, books: list, keep: Keep) -> DataFrame:
    """anchor_id, other_id, low, high: what `keep` leaves of every cell of anchors (vec_id, label, x, windows) and rows (vec_id, label, codes, residual)."""
    down, across = (max(1, -(-n // size)) for n, size in zip(sizes, (ANCHORS, ROWS)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    cells = lambda first, n, step: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * step + first)).alias("cell")
    rows = codes.select(cells(block(across), down, across), *codes.columns)
    asked = anchors.select(cells(block(down) * across, across, 1), *anchors.columns)
    names, kinds = ["anchor_id", "other_id", "low", "high"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, labels = (left[c].to_numpy() for c in ("vec_id", "label"))
            low, high = bounds(unblob(right["x"], np.int32, length), unblob(left["codes"], np.uint8, 2 * len(books)), left["residual"].to_numpy(), books)
            for i, (anchor, label, windows) in enumerate(zip(right["vec_id"].to_pylist(), right["label"].to_pylist(), right["windows"].to_pylist())):
                found += keep(anchor, low[i], high[i], labels == label, ids, windows or [])
        return pa.table([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, kinds)], names=names)

    return rows.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(run, "anchor_id long, other_id long, low double, high double")


def _exact(pairs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """anchor_id, other_id, score: inner products of whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (unblob(batch.column(i), np.int32, length).astype(np.int64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b))], ["anchor_id", "other_id", "score"])

    side = lambda c, x: rows.select(F.col("vec_id").alias(c), F.col("x").alias(x))
    both = pairs.select("anchor_id", "other_id").join(side("other_id", "b"), "other_id").join(side("anchor_id", "a").where(F.col("anchor_id") % EVERY == 0), "anchor_id")
    return both.select("anchor_id", "other_id", "a", "b").mapInArrow(run, "anchor_id long, other_id long, score long")


def _first(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered from 1 in `rank`; each task cuts its own groups down before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _reached(scores: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, reach: the k-th greatest `low` of each group that has as many."""
    return _first(scores, by, [F.desc("low")], k).where(F.col("rank") == k).select(*by, F.col("low").alias("reach"))


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: every window's first negatives."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "negatives")
    whole, length = prepared(embeddings)
    if not length:
        return spark.createDataFrame([], SCHEMA)
    rows = scratch.write(whole, "rows")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()["x"]
    if not n:
        return spark.createDataFrame([], SCHEMA)
    books = codebooks(unblob(sample, np.int32, length))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, left = encode(unblob(batch.column(2), np.int32, length), books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs(codes), pa.array(left)], ["vec_id", "label", "codes", "residual"])

    codes = scratch.write(rows.mapInArrow(coded, "vec_id long, label long, codes binary, residual double"), "codes")
    asked = rows.where(F.col("vec_id") % EVERY == 0)
    sizes = (asked.count(), n)
    bare = asked.withColumn("windows", F.lit(None).cast("array<struct<positive_id:bigint,low:bigint,high:bigint,floor:double>>"))
    likely = scratch.write(_scan(codes, bare, sizes, length, books, _likely_positives), "likely")
    likely = likely.join(_reached(likely, ["anchor_id"], POSITIVES), "anchor_id", "left").where("reach IS NULL OR high >= reach")
    order = [F.desc("score"), F.asc("other_id")]
    positives = _first(_exact(likely, rows, length), ["anchor_id"], order, POSITIVES).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # Whole percents: LOW * p <= 100 * s <= HIGH * p.
    low, high = F.ceil(F.col("positive_score") * LOW / F.lit(100).cast("decimal(3,0)")).cast("long"), F.floor(F.col("positive_score") * HIGH / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = scratch.write(positives.withColumns({"low": low, "high": high}).where("low <= high"), "windows")

    def with_windows(floors: Column, of: DataFrame) -> DataFrame:
        each = of.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "low", "high", floors.alias("floor"))).alias("windows"))  # at most POSITIVES
        return asked.join(each, "vec_id")

    sure = scratch.write(_scan(codes, with_windows(F.col("low").cast("double"), windows), sizes, length, books, _sure_scores), "sure")
    reach = _reached(sure.withColumnRenamed("other_id", "positive_id"), ["anchor_id", "positive_id"], NEGATIVES)
    floors = windows.join(reach, ["anchor_id", "positive_id"], "left")
    kept = _scan(codes, with_windows(F.greatest(F.col("low").cast("double"), "reach"), floors), sizes, length, books, _likely_negatives)
    scores = scratch.write(_exact(kept, rows, length), "scores")
    inside = scores.join(windows, "anchor_id").where("score BETWEEN low AND high")
    ranked = _first(inside, ["anchor_id", "positive_id"], order, NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
