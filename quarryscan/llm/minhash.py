"""b-bit MinHash near-duplicate removal: sets of 4-word shingles that overlap by at least 80%, one document of each component kept.

A set's signature is `ROWS * BANDS` minima under seeded permutations of its shingle hashes. Sets that agree in all `ROWS` minima of a band
are candidates. Of every minimum only the `BITS` low bits are kept, packed as bit planes, so the minima that differ are counted by `bit_count` over
the planes of two sets; their share, corrected for the 2^-BITS chance that different minima agree, estimates the similarity. A candidate whose
estimate lies more than `SURE` standard deviations under the threshold goes; all others are confirmed by exact intersection of the full sets.

Equal sets are one class before anything is paired. A bucket (a band's hash and a band of set sizes) doesn't become all its
pairs: its members meet centres in rounds, and only members of different components are paired in the end (`ngram_join.settle`). The members left for that get
a second, longer signature (`FINE` minima of `FINE_BITS` bits) and a bitmap that bounds their overlap from above, which rule out most pairs before they
are made; sets just under the threshold are beyond what an estimate tells apart. Two sets at the threshold
share no band with a probability of (1 - 0.8^ROWS)^BANDS, 5e-8; links above it are lost more rarely still.

Defined cases: null or wordless texts have an empty set, link with nothing and are kept; fewer than four words are one shingle; repeated rows share
a component, and so does a repeated id, kept in each of its rows that equals the component's smallest id; a row without an id is kept only
where no row of its component has one; an empty table gives no rows; very long texts are sets like any other. Of clashing columns
only `doc_id` and `text` are read. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, signed
from .ngram_join import SHORT_COLUMNS, THRESHOLD, Sketch, _band, _flat, about_wanted, classes, sets, settle, short_bitmaps, wanted_sets

SIZE = 4
#: Minima of a band, and bands. Their product is a multiple of 64.
ROWS, BANDS = 4, 32
#: Low bits kept of each minimum, and standard deviations of the estimate that a candidate may lie under the threshold.
BITS, SURE = 4, 6
#: Shingles hashed together, and how many of them at a time: what stays in a core's cache.
TOGETHER, LOT = 1 << 19, 1 << 15
MINIMA = ROWS * BANDS
#: Members of a bucket that all others meet in a round.
CENTRES = 8
#: Minima and low bits of the signature of sets that are paired with each other.
FINE, FINE_BITS = 1024, 2


def _names(prefix: str, bits: int, count: int) -> tuple[str, ...]:
    return tuple(f"{prefix}{j}_{w}" for j in range(bits) for w in range(count // 64))


PLANES, FINE_PLANES = _names("b", BITS, MINIMA), _names("f", FINE_BITS, FINE)
_SEEDS = np.random.default_rng(20).integers(0, 1 << 64, (2, MINIMA + FINE), np.uint64)
_XOR, _MUL = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def minima(flat: np.ndarray, starts: np.ndarray, first: int = 0, count: int = MINIMA) -> np.ndarray:
    """count x sets: the least hash of each set under each permutation from `first` on; sets are the runs of flat that begin at starts."""
    out = np.empty((count, len(starts)), np.uint64)
    ends = np.append(starts, len(flat))
    cut = (np.flatnonzero(np.diff(ends[:-1] // LOT)) + 1).tolist()
    for a, b in zip([0, *cut], [*cut, len(starts)]):
        part, at = flat[ends[a] : ends[b]], starts[a:b] - ends[a]
        hashes = np.empty_like(part)
        for i in range(count if b > a else 0):
            np.bitwise_xor(part, _XOR[first + i], out=hashes)
            np.multiply(hashes, _MUL[first + i], out=hashes)
            np.minimum.reduceat(hashes, at, out=out[i, a:b])
    return out


def _slices(batch: pa.RecordBatch, grams: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of sets with about `most` shingles each, and the sizes of their sets."""
    sizes = np.fromiter((len(x) // 8 for x in batch.column(grams).to_pylist()), np.int64, batch.num_rows)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)).tolist()
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a), sizes[a:b]


def planes(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """sets x planes: bit j of all minima of a set, in words of 64."""
    of_bit = (least[None] >> np.arange(bits, dtype=np.uint64)[:, None, None]) & np.uint64(1)  # bits x minima x sets
    words = of_bit.reshape(bits, len(least) // 64, 64, -1) << np.arange(64, dtype=np.uint64)[None, None, :, None]
    return np.bitwise_or.reduce(words, axis=2).reshape(bits * len(least) // 64, -1).T


def band_keys(least: np.ndarray) -> np.ndarray:
    """sets x BANDS: a hash of each band's minima and its number."""
    rows = least.reshape(BANDS, ROWS, -1)
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], least.shape[1], axis=1)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.T


def estimate(differ: float, count: int = MINIMA, bits: int = BITS) -> float:
    """Similarity of two sets, by the number of kept minima that differ; chance agreement is taken off."""
    return 1 - differ / count / (1 - 2.0**-bits)


def most_differing(percent: int, count: int = MINIMA, bits: int = BITS) -> int:
    """Kept minima that may differ in a pair at the threshold, SURE standard deviations out."""
    p = (1 - percent / 100) * (1 - 2.0**-bits)
    return int(np.ceil(count * p + SURE * np.sqrt(count * p * (1 - p))))


def signatures(one: DataFrame) -> DataFrame:
    """sid, n, keys (a hash for each band), and the bit planes, of sets (sid, grams); a set given twice comes twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes in _slices(batch, 1, TOGETHER):
                flat, _ = _flat(part, 0, 1)
                least = minima(flat, np.append(0, np.cumsum(sizes)[:-1]))
                keys = pa.FixedSizeListArray.from_arrays(pa.array(signed(np.ascontiguousarray(band_keys(least))).ravel()), BANDS).cast(pa.list_(pa.int64()))
                bits = signed(np.ascontiguousarray(planes(least).T))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), keys, *map(pa.array, bits)], ["sid", "n", "keys", *PLANES])

    return one.select("sid", "grams").mapInArrow(run, "sid long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in PLANES))


def fine_signatures(open_sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, FINE_PLANES and the short bitmap of the open sets in wanted (sid), and of some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sizes in _slices(batch, 1, LOT):
                flat, _ = _flat(part, 0, 1)
                starts = np.append(0, np.cumsum(sizes)[:-1])
                fine = signed(planes(minima(flat, starts, MINIMA, FINE), FINE_BITS))
                columns = [np.ascontiguousarray(c) for c in (*fine.T, *short_bitmaps(np.split(flat, starts[1:])).T)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], ["sid", *FINE_PLANES, *SHORT_COLUMNS])

    return about_wanted(open_sets.select("sid", "grams"), wanted).mapInArrow(run, "sid long, " + ", ".join(f"{c} long" for c in (*FINE_PLANES, *SHORT_COLUMNS)))


def _differ(left: str, right: str) -> Column:
    """The kept minima that differ: a minimum differs where any of its planes does."""
    of_word = []
    for w in range(MINIMA // 64):
        x = None
        for j in range(BITS):
            plane = F.col(f"{left}b{j}_{w}").bitwiseXOR(F.col(f"{right}b{j}_{w}"))
            x = plane if x is None else x.bitwiseOR(plane)
        of_word.append(F.bit_count(x))
    return sum(of_word[1:], of_word[0])


def _near(values: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows p and q that the longer signatures do not rule out."""
    differ = np.zeros(len(p), np.int64)
    for w in range(FINE // 64):
        differ += np.bitwise_count(np.bitwise_or.reduce([(v := values[f"f{j}_{w}"])[p] ^ v[q] for j in range(FINE_BITS)]))
    return differ <= most_differing(percent, FINE, FINE_BITS)


def _bounded(pairs: DataFrame, open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the estimate does not rule out."""
    side = lambda x: open_sets.select(F.col("sid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in PLANES])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_differ("a_", "b_") <= most_differing(percent)).select("a", "b")


def join(docs: DataFrame, size: int = SIZE, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    stored = scratch.write(sets(docs, size), "sets")
    ids = scratch.write(stored.select("doc_id", "n", "sid"), "ids")
    one = stored.where("grams is not null").select("sid", "n", "grams")
    signed_sets = scratch.write(signatures(one), "signatures")
    # The next band of sizes is offered too, where larger partners may be.
    bands = F.array_distinct(F.array(_band(F.col("n"), percent), _band(F.col("n") * (100.0 / percent), percent)))
    rows = signed_sets.select("sid", "n", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("key")
    members = scratch.write(rows.join(met, "key").select("key", F.explode(bands).alias("tile"), "sid", "n").distinct(), "members")
    # A bucket is named by its members, so that bands in which the same sets agree count once.
    about = F.struct("sid", "n", F.lit(0).cast("long").alias("alone"), F.lit(0).cast("long").alias("alone_2"))
    centre = F.min(F.struct(F.lit(0).cast("long").alias("own"), F.xxhash64("sid").alias("h"), about.alias("s"))).alias("c")
    tiles = members.groupBy("key", "tile").agg(F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sid")).alias("y"), F.count("*").alias("m"), centre).where("m > 1")
    shared = scratch.write(members.join(tiles, ["key", "tile"]).select("x", "y", about.alias("s"), "c").distinct(), "tiles")
    wanted = shared.select("s.sid").distinct()
    planes_of = signed_sets.join(wanted, "sid", "left_semi").groupBy("sid").agg(*[F.first(c).alias(c) for c in PLANES])
    open_sets = scratch.write(wanted_sets(one, wanted).join(planes_of, "sid"), "open")
    scratch.keep(ids, shared, open_sets)
    found = classes(ids, settle(shared, open_sets, Sketch((*FINE_PLANES, *SHORT_COLUMNS), fine_signatures, _near, _bounded, CENTRES), scratch, percent), scratch)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep(docs: DataFrame, size: int = SIZE, percent: int = THRESHOLD) -> DataFrame:
    """The rows of docs that stay: of each component those of its smallest id."""
    ids = join(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")
