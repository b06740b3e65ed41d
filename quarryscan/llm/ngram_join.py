"""N-gram Jaccard self-join of documents: sets of 5-word shingles that overlap by at least 80%.

Equal sets are one class from the start. Two sets that reach the threshold share one of the first
n - ceil(0.8 n) + 1 shingles of each in any common order. The order is by rarity: exact numbers of sets are counted for a fixed region of the
hash space (`REGION`), and for all shingles of the sets that find too few rare ones (`FEW`) there; shingles whose counter of
a fixed table stands out come last. A set with enough shingles of its own has no partner and leaves. A tile is one shared shingle and one band of set
sizes. In a tile, parity bitmaps of hashed shingles (short ones inside the join, then full ones) bound the overlap from above (popcount of
the exclusive or is at most the symmetric difference); what passes is verified by exact intersection of the sorted arrays.

Tiles with the same members are one. They are worked in steps so that groups of near copies don't become all their pairs:
first every set meets the centre of one of its tiles; then, in rounds, the members outside a tile's largest component meet one
member of it, each in one tile; last, only members of a tile that are still in different components are paired. A tile's members are dealt to blocks, and
a task holds two blocks against each other at a time. Components come from hooking and pointer
jumping over stored tables, later ones over the labels of earlier ones. Region, tables, rounds and blocks change cost, never links.

Defined cases: null or wordless texts have an empty set and no links, and are their own component; fewer than five words
are one shingle; repeated rows share a component; a component without any id has a null id; an empty table
gives no rows; very long texts are sets like any other. Of clashing columns only `doc_id` and `text` are read. Sets and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PARTITIONS, Scratch, bounded_batches, byte_slices, grouped, packed_rows, runs, shingle_set, signed

SIZE = 5
THRESHOLD = 80  # percent
#: The share of the hash space whose shingles are counted for all sets, and shingles packed and counted together in a task.
REGION, TOGETHER = 0.3, 1 << 19
#: Counters that find very frequent shingles.
COUNTERS = 1 << 16
#: Sets of a shingle that counts as rare, and slots of the filter that finds sets without enough of them.
FEW, SLOTS = 64, 1 << 18
#: Steps of 1 / threshold in a band of sizes.
BAND_STEPS = 3
#: At most so many rounds of linking to large components; pairs left per tile row that end them (as does a round that leaves nine tenths).
ROUNDS, LINEAR = 6, 2
#: A round with several centres that finds one link for so many tile rows, or fewer, is the last.
FEW_LINKS = 1000
#: Numbers of a short bitmap, which pairs of a tile are held against before they are made.
SHORT = 8
SHORT_COLUMNS = tuple(f"g{i}" for i in range(SHORT))
#: Members of a block of a tile, pairs held against each other at once, rows taken together, rows of a group that is worked as a table of its own, and rows and
#: pairs for a task more.
BLOCK, AT_ONCE, ROWS_TOGETHER, WIDE, TASK_ROWS, TASK_PAIRS = 4096, 1 << 15, 1 << 14, 32, 1 << 13, 1 << 25
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(32)


def _bits(grams: np.ndarray, width: int = 0) -> bytes:
    """Parity bitmap of a power of two of bits, by default at least the set's size; folds to any smaller one."""
    width = width or max(64, 1 << int(len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(20)) & np.uint64(width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def short_bitmaps(sets_of: list[np.ndarray]) -> np.ndarray:
    """sets x SHORT: bitmaps of one width for all, as whole numbers."""
    return np.array([np.frombuffer(_bits(g, 64 * SHORT), np.int64) for g in sets_of], np.int64).reshape(-1, SHORT)


def overlap_bound(left: bytes, right: bytes, n_left: int, n_right: int) -> int:
    """At least the size of the intersection."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return (n_left + n_right - int(np.bitwise_count(a ^ b).sum())) // 2


def linked(common: int, n_left: int, n_right: int, percent: int = THRESHOLD) -> bool:
    return 100 * common >= percent * (n_left + n_right - common)


def sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n, sid (hash of the set, null if empty), grams (sorted 64-bit hashes; null where the task gave the same set before)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, sids, blobs = [], [], []
            for data in byte_slices(batch.column(1)):
                grams = shingle_set(data.lower().split(), size)
                sid = xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None
                sizes.append(len(grams))
                sids.append(sid)
                blobs.append(None if sid is None or sid in seen else grams.tobytes())
                if sid is not None:
                    seen.add(sid)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n", "sid", "grams"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n bigint, sid bigint, grams binary")


def _flat(batch: pa.RecordBatch, sid: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a batch of sets, and the set each belongs to."""
    blobs = batch.column(grams).to_pylist()
    sizes = np.fromiter((len(x) // 8 for x in blobs), np.int64, len(blobs))
    return np.frombuffer(b"".join(blobs), np.uint64), np.repeat(batch.column(sid).to_numpy(zero_copy_only=False), sizes)


def _first(values: np.ndarray) -> np.ndarray:
    """Of shingles, those in the region that is ordered first."""
    return (values >> _HIGH) < np.uint64(REGION * (1 << 32))


def _slot(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(COUNTERS - 1)).astype(np.int64)


def _sid_slot(sid: str = "sid") -> Column:
    return F.pmod(F.xxhash64(sid), F.lit(SLOTS))


def _frequent(one: DataFrame) -> np.ndarray:
    """Counters that stand out: True for the slots of very frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            values, _ = _flat(batch, 0, 1)
            total += np.bincount(_slot(values), minlength=COUNTERS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "c"])

    counts = one.select("sid", "grams").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[counts["slot"].to_numpy()] = counts["c"].to_numpy()
    return out > 2 * out.mean() + 64


def _token(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and place in it of shingles of the region."""
    return ((values >> _HIGH) % np.uint64(parts)).astype(np.int64), (values & _LOW).astype(np.uint32)


def _summary(one: DataFrame, often: np.ndarray, parts: int, percent: int) -> DataFrame:
    """sid, n, first, second (distinct tokens inside and outside the region), last (very frequent shingles, as far as a prefix can reach)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(blob, np.uint64)
                hot = often[_slot(values)]
                inside = _first(values)
                counts = []
                for part in (inside & ~hot, ~inside & ~hot):
                    p, t = _token(values[part], parts)
                    counts.append(len(np.unique((p << 32) | t.astype(np.int64))))
                rows.append((sid, len(values), *counts, signed(values[hot][: len(values) - -(-percent * len(values) // 100) + 1]).tolist()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.list_(pa.int64())))], ["sid", "n", "first", "second", "last"])

    return one.select("sid", "grams").mapInArrow(run, "sid long, n long, first long, second long, last array<long>")


def _counted(one: DataFrame, often: np.ndarray, parts: int, inside: bool) -> DataFrame:
    """sid, key, sets: tokens inside or outside the region that more than one of these sets has. They travel packed, by part."""
    shift = 0 if inside else parts

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            values, sids = (np.concatenate(x) for x in zip(*held))
            p, t = _token(values, parts)
            columns = list(zip(*packed_rows(p, [t, sids]))) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["p", "tokens", "sids"])

        held, n = [], 0
        for batch in batches:
            values, sids = _flat(batch, 0, 1)
            stay = (_first(values) == inside) & ~often[_slot(values)]
            held.append((values[stay], sids[stay]))
            n += len(held[-1][0])
            if n >= TOGETHER:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (tokens, sids) in grouped(batches, 2):
            t, s = np.frombuffer(tokens, np.uint32), np.frombuffer(sids, np.int64)
            order = np.lexsort((s, t))
            t, s = t[order], s[order]
            one_each = runs(t, s)
            t, s = t[one_each], s[one_each]
            n = np.diff(np.append(np.flatnonzero(runs(t)), len(t)))
            n = np.repeat(n, n)
            more = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(s[more]), pa.array(((part + shift) << 32) | t[more].astype(np.int64)), pa.array(n[more].astype(np.int64))], ["sid", "key", "sets"])

    rows = one.select("sid", "grams").mapInArrow(packed, "p long, tokens binary, sids binary")
    return rows.repartition(min(parts, PARTITIONS), "p").sortWithinPartitions("p").mapInArrow(counted, "sid long, key long, sets long")


def _prefixes(one: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """sid, n, key: the shingles of each set's prefix that another set may share; alone and alone_2: how many no other set has, in the
    region and outside it (null if those were not counted; they are alone among the sets whose alone_2 is known).

    The order: tokens of the region that at most `FEW` sets have, by their number of sets; the tokens outside it, by the number of sets that
    get so far; the other tokens of the region; very frequent shingles. Tokens of one set alone link it with nothing, and
    stand first in their class.
    """
    often = _frequent(one)
    total = one.agg(F.sum("n")).first()[0] or 0
    parts = max(32, int(total * REGION) // TOGETHER)
    about = _summary(one, often, parts, percent).groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "first", "second", "last")])
    inside = scratch.write(_counted(one, often, parts, True), "inside")
    met = inside.groupBy("sid").agg(F.count("*").alias("met"), F.sum((F.col("sets") <= FEW).cast("long")).alias("low"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    sums = about.join(met, "sid", "left").select("sid", "n", "first", "second", "last", length.alias("length"), zero("met"), zero("low"))
    sums = scratch.write(sums.withColumn("have", F.col("first") - F.col("met") + F.col("low")), "about")
    # Sets that need more than the first class; others may slip in by their slot, which changes an order's counts but no result.
    further = F.broadcast(sums.where("have < length").select(_sid_slot().alias("_slot")).distinct())  # at most SLOTS rows
    outside = scratch.write(_counted(one.withColumn("_slot", _sid_slot()).join(further, "_slot", "left_semi").drop("_slot"), often, parts, False), "outside")
    met_2 = sums.where("have < length").select("sid").join(outside.groupBy("sid").agg(F.count("*").alias("met_2")), "sid", "left").select("sid", zero("met_2"))
    sums = scratch.write(sums.join(met_2, "sid", "left").withColumns({"alone": F.col("first") - F.col("met"), "alone_2": F.col("second") - F.col("met_2")}), "sums")
    brief = sums.drop("last")
    of_set = Window.partitionBy("sid")
    order = of_set.orderBy("sets", "key")
    one_row = inside.withColumn("rank", F.row_number().over(order)).join(brief, "sid")
    c = F.col
    needs_2 = c("length") - c("have") - c("second")
    first = one_row.where(F.when(c("rank") <= c("low"), c("rank") <= F.least("length", "have") - c("alone")).otherwise(c("rank") - c("low") <= needs_2))
    ranked = outside.withColumn("rank", F.row_number().over(order)).join(brief.where("have < length"), "sid")
    second = ranked.where(c("rank") <= F.least(c("length") - c("have"), c("second")) - c("alone_2"))
    needs_3 = needs_2 - (c("met") - c("low"))
    third = sums.where(needs_3 > 0).withColumn("key", F.explode(F.slice("last", F.lit(1), needs_3.cast("int"))))
    columns = ["sid", "n", "alone", "alone_2", "key"]
    return first.select(columns).union(second.select(columns)).union(third.select(columns))


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n) / (F.log(F.lit(100.0 / percent)) * BAND_STEPS) + 1e-9).cast("int")


def _pairs_within(n_a: Column, n_b: Column, percent: int) -> Column:
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)


#: What a tile knows of a set.
ABOUT = ("sid", "n", "alone", "alone_2")


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and shingles that only one of the two sets has leave room for the threshold; a and b are structs of ABOUT."""
    both = F.col(f"{a}.alone_2").isNotNull() & F.col(f"{b}.alone_2").isNotNull()
    most = F.least(*[F.col(f"{x}.n") - F.col(f"{x}.alone") - F.when(both, F.col(f"{x}.alone_2")).otherwise(0) for x in (a, b)])
    return (most * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent) & _pairs_within(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)


def about_wanted(rows: DataFrame, wanted: DataFrame, sid: str = "sid") -> DataFrame:
    """The rows whose sid is in wanted (sid), and some others: by a filter of fixed size, 64 bits in each of SLOTS slots, without a shuffle of the rows."""
    bit = F.pmod(F.xxhash64(F.lit(1), sid), F.lit(64)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = wanted.select(_sid_slot(sid).alias("_slot"), mark.alias("_mark")).groupBy("_slot").agg(F.bit_or("_mark").alias("_marks"))  # at most SLOTS rows
    # A semi-join, which no other one is moved under.
    return rows.join(F.broadcast(marks), (_sid_slot(sid) == F.col("_slot")) & (F.col("_marks").bitwiseAND(mark) != 0), "left_semi")


def wanted_sets(one: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, n, grams of the sets in wanted (sid), once each."""
    # Most sets are in no tile: the filter spares them the shuffle of the join.
    return about_wanted(one, wanted).join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))


def _open_sets(one: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, n, bits, grams of the sets in tiles, and a short bitmap in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            bits = pa.array([_bits(g) for g in grams], pa.binary())
            short = short_bitmaps(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits, batch.column(2), *(pa.array(c) for c in short.T)], ["sid", "n", "bits", "grams", *SHORT_COLUMNS])

    return wanted_sets(one, wanted).mapInArrow(run, "sid long, n long, bits binary, grams binary, " + ", ".join(f"{c} long" for c in SHORT_COLUMNS))


def _bounded(pairs: DataFrame, open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps don't rule out."""
    left, right = (open_sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b")}
            keep = [linked(min(overlap_bound(x, y, m, n), m, n), m, n, percent) for x, y, m, n in zip(c["bits_a"], c["bits_b"], c["n_a"], c["n_b"])]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (stored) whose exact overlap reaches the threshold. Only sets in a pair are shuffled."""
    left, right = (about_wanted(open_sets.select("sid", "grams"), pairs.select(F.col(x).alias("sid"))).toDF(x, f"grams_{x}") for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """sid, label (the smallest sid reachable) for every node of the stored edges (a, b)."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "graph")
    now = scratch.write(both.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(now.select(F.col("sid").alias("b"), "label"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("label").alias("m"))
        hooked = scratch.write(now.join(near, "sid").select("sid", F.least("label", "m").alias("label"), F.col("label").alias("was")), "hooked")
        root = hooked.select(F.col("sid").alias("label"), F.col("label").alias("root"))
        after = scratch.write(hooked.join(root, "label").select("sid", F.least("label", "root").alias("label"), (F.least("label", "root") != F.col("was")).alias("moved")), "labels")
        scratch.drop(now, hooked)
        now = after
        if now.where("moved").isEmpty():
            scratch.drop(both)
            return now.select("sid", "label")


def _joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links: components of the labels, not of all links again."""
    at = lambda x: labels.select(F.col("sid").alias(x), F.col("label").alias(f"l_{x}"))
    named = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).where("a <> b").distinct()
    forest = components(scratch.write(named, "forest"), scratch)
    new = forest.join(labels, "sid", "left_anti").select("sid", F.col("sid").alias("label"))
    return scratch.write(labels.union(new).join(forest.select(F.col("sid").alias("label"), F.col("label").alias("root")), "label", "left").select("sid", F.coalesce("root", "label").alias("label")), "labels")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component's label, of the tiles that hold more than one component."""
    placed = shared.select("x", "y", "s", "s.sid").join(labels, "sid", "left").select("x", "y", "s", F.coalesce("label", "sid").alias("label")).distinct()
    torn = placed.groupBy("x", "y").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("x", "y")
    return placed.join(torn, ["x", "y"], "left_semi")


def own_of(s: str) -> Column:
    """About how many shingles a set has alone."""
    return (F.col(f"{s}.alone") + F.coalesce(f"{s}.alone_2", F.col(f"{s}.alone") * 2)).alias("own")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


@dataclass(frozen=True)
class Sketch:
    """What rules a pair out before its sets are compared. of(open_sets, wanted): sid, the short bitmap and the other columns that near() needs of both, at least for
    the sets in wanted; near(values, p, q, percent): which of the pairs of rows p and q stay that the short bitmaps leave; bounded(pairs, open_sets,
    percent): the pairs it leaves. centres: how many members of a tile the others meet in a round."""

    columns: tuple[str, ...]
    of: Callable[[DataFrame, DataFrame], DataFrame]
    near: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, int], np.ndarray] | None
    bounded: Callable[[DataFrame, DataFrame, int], DataFrame]
    centres: int = 1


def short_overlap(values: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows p and q the short bitmaps don't rule out; a column of rows and a line of rows give a table."""
    differ = np.zeros(np.broadcast_shapes(p.shape, q.shape), np.int32)
    for c in SHORT_COLUMNS:
        v = values[c]
        differ += np.bitwise_count(v[p] ^ v[q])
    n = values["n"]
    return differ * (100 + percent) <= (n[p] + n[q]) * (100 - percent)


def _likely(v: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Labels differ, and `_possible` and the short bitmaps leave room for the threshold."""
    n, less, less_2, known, label = (v[c] for c in ("n", "less", "less_2", "known_2", "label"))
    most = np.where(known[p] & known[q], np.minimum(less_2[p], less_2[q]), np.minimum(less[p], less[q]))
    small, large = np.minimum(n[p], n[q]), np.maximum(n[p], n[q])
    return (label[p] != label[q]) & (most * (100 + percent) >= (small + large) * percent) & (small * 100 >= large * percent) & short_overlap(v, p, q, percent)


def _met(v: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are `_likely`. v: x, y, i, j and side of rows sorted by these and label: within a group of equal i and j all rows of different labels
    meet, in any other those of side 0 meet those of side 1."""
    label, total = v["label"], len(v["label"])
    less = v["n"] - v["alone"]
    v = v | {"less": less, "less_2": less - v["alone_2"], "known_2": v["alone_2"] >= 0}
    key = [v[c] for c in _ROW[:5]]
    first = np.flatnonzero(runs(*key[:4]))
    size = np.diff(np.append(first, total))
    end, middle = first + size, first + np.add.reduceat(1 - key[4], first)
    at = np.flatnonzero(runs(*key, label))
    after = np.repeat(np.append(at[1:], total), np.diff(np.append(at, total)))  # where the rows of the next label begin
    within = key[2][first] == key[3][first]
    # Small groups: their pairs are numbered.
    row = np.flatnonzero(np.repeat(size < WIDE, size))
    group = np.repeat(np.arange(len(first)), size)[row]
    lo = np.where(within[group], after[row], middle[group])
    count = np.where(within[group] | (key[4][row] == 0), end[group] - lo, 0)
    done = np.cumsum(count)
    cut = np.flatnonzero(np.diff(done // AT_ONCE)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(row)]):
        if a < b:
            p = np.repeat(row[a:b], count[a:b])
            q = np.arange(len(p)) - np.repeat(done[a:b] - count[a:b] - (done[a] - count[a]) - lo[a:b], count[a:b])
            stay = _likely(v, p, q, percent)
            yield p[stay], q[stay]
    # Large ones: tables of some rows by all that they meet.
    for g in np.flatnonzero(size >= WIDE):
        a, b, c = (int(end[g]) if within[g] else int(middle[g])), int(middle[g]), int(end[g])
        at_row, last = int(first[g]), a
        while at_row < last:
            from_q = int(after[at_row]) if within[g] else b
            if from_q == c:
                break
            to = min(last, at_row + max(1, AT_ONCE // (c - from_q)))
            p, q = np.arange(at_row, to), np.arange(from_q, c)
            if not within[g] and label[at_row] == label[to - 1]:
                q = q[label[q] != label[at_row]]
            stay = _likely(v, p[:, None], q[None, :], percent)
            if within[g]:
                stay &= q[None, :] >= after[p][:, None]
            k, m = np.nonzero(stay)
            yield p[k], q[m]
            at_row = to


#: The numbers of a row that is compared, before its sketch.
_ROW = ("x", "y", "i", "j", "side", *ABOUT, "label")


def _compared(rows: DataFrame, sketch: Sketch, percent: int, n_rows: int, n_pairs: int) -> DataFrame:
    """Pairs (a, b) that the sketch leaves of rows (_ROW and the sketch's columns), as `_met` brings them together."""

    def compare(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        v = {c: batch.column(c).to_numpy() for c in _ROW} | {c: batch.column(c).to_numpy().view(np.uint64) for c in sketch.columns}
        found = [np.empty(0, v["sid"].dtype)] * 2
        for p, q in _met(v, percent):
            if sketch.near:
                stay = sketch.near(v, p, q, percent)
                p, q = p[stay], q[stay]
            # Sets meet in each tile that they share.
            s, t = v["sid"][p], v["sid"][q]
            found = [np.append(found[0], np.minimum(s, t)), np.append(found[1], np.maximum(s, t))]
            if len(found[0]) > AT_ONCE:
                found = list(np.unique(np.stack(found), axis=1))
                if len(found[0]) > AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])
                    found = [x[:0] for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.stack(found), axis=1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # The last group may go on in the next batch.
            at = int(np.flatnonzero(runs(*(batch.column(c).to_numpy() for c in _ROW[:4])))[-1])
            if at and sum(x.num_rows for x in held) >= ROWS_TOGETHER:
                yield from compare([*held[:-1], batch.slice(0, at)])
                held = [batch.slice(at)]
        if held:
            yield from compare(held)

    about = [F.col("s.sid").alias("sid"), F.col("s.n").alias("n"), F.col("s.alone").alias("alone"), F.coalesce("s.alone_2", F.lit(-1)).cast("long").alias("alone_2")]
    flat = rows.select(*[F.col(c).cast("long").alias(c) for c in _ROW[:5]], *about, "label", *sketch.columns)
    parts = min(PARTITIONS, int(1 + n_rows // TASK_ROWS + n_pairs // TASK_PAIRS))
    return flat.repartition(parts, *_ROW[:4]).sortWithinPartitions(*_ROW[:5], "label").mapInArrow(run, "a long, b long").distinct()


def _blocks(left: DataFrame) -> DataFrame:
    """left with the number of its tile's blocks (_of) and its own one (_own)."""
    of = left.groupBy("x", "y").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_of"))
    return left.join(of, ["x", "y"]).withColumn("_own", F.pmod(F.xxhash64(F.lit(2), "s.sid"), F.col("_of")))


def _with_centres(left: DataFrame, centres: int, turn: int) -> DataFrame:
    """The members of a block on side 0, and its tile's centres on side 1: the first in the turn's order."""
    rows = _blocks(left)
    order = Window.partitionBy("x", "y").orderBy(F.xxhash64(F.lit(turn), "s.sid"))
    few = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= centres)
    no = F.lit(-1).cast("long").alias("j")
    members = rows.select("x", "y", "s", "label", F.col("_own").alias("i"), no, F.lit(0).alias("side"))
    return members.union(few.select("x", "y", "s", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("i"), no, F.lit(1).alias("side")))


def _with_all(left: DataFrame) -> DataFrame:
    """Each two blocks of a tile, the second on side 1, and each block by itself."""
    rows = _blocks(left).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    i, j = F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")
    return rows.select("x", "y", "s", "label", i, j, (F.col("_own") > F.col("_other")).cast("int").alias("side"))


def settle(shared: DataFrame, open_sets: DataFrame, sketch: Sketch, scratch: Scratch, percent: int) -> DataFrame:
    """sid, label: components of the links within tiles. shared: x, y (a tile), s (a member's ABOUT), c (own, h and ABOUT of the tile's centre); open_sets: sid, n, grams and the sketch of every member."""
    star = shared.where("s.sid <> c.s.sid").where(_possible("s", "c.s", percent)).groupBy("s.sid").agg(F.min(F.struct("c.own", "c.h", F.col("c.s.sid").alias("with"))).alias("c")).select(*_pair("c.with", "sid")).distinct()
    tested = scratch.write(sketch.bounded(star, open_sets, percent), "star")
    links = scratch.write(_verified(tested, open_sets, percent), "links")
    labels = components(links, scratch)
    # Tiles with members in different components: only pairs across them are still open. While these are many, the
    # members outside a tile's largest component meet one member of it, another one in each round, first the one nearest to all;
    # or, with several centres, all members meet those of other components. Copies of copies, each near its neighbours only, need these.
    last = known = None
    for turn in range(ROUNDS + 1):
        left = scratch.write(_open(shared, labels), "left")
        best = F.struct(own_of("s") if turn == 0 else F.lit(0).alias("own"), F.xxhash64(F.lit(turn), "s.sid").alias("h"), "s")
        parts = left.groupBy("x", "y", "label").agg(F.count("*").alias("m"), F.min(best).alias("c"))
        tiles_left = parts.groupBy("x", "y").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max(F.struct("m", "label", "c")).alias("c"))
        size_left = tiles_left.agg(F.sum("rows").alias("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2).alias("pairs")).first()
        pairs = size_left["pairs"] or 0
        if turn == ROUNDS or pairs <= LINEAR * (size_left["rows"] or 0) or (sketch.centres == 1 and last is not None and pairs > 0.9 * last):
            break
        last = pairs
        if sketch.centres == 1:
            meet = left.join(tiles_left.select("x", "y", "c.label", "c.c").withColumnRenamed("label", "largest"), ["x", "y"]).where("label <> largest").where(_possible("s", "c.s", percent))
            meet = meet.groupBy("s.sid").agg(F.min(F.struct("c.own", "c.h", F.col("c.s.sid").alias("with"))).alias("c")).select(*_pair("c.with", "sid")).distinct()
            meet = sketch.bounded(meet, open_sets, percent)
        else:
            if known is None:
                known = scratch.write(sketch.of(open_sets, left.select("s.sid").distinct()), "known")
            dealt = _with_centres(left, sketch.centres, turn).withColumn("sid", F.col("s.sid"))
            meet = _compared(dealt.join(known, "sid"), sketch, percent, size_left["rows"], size_left["rows"] * sketch.centres)
        found = scratch.write(_verified(scratch.write(meet, "pairs"), open_sets, percent), "links")
        n_found = found.count()
        if n_found == 0:
            break
        labels = _joined(labels, found, scratch)
        if sketch.centres > 1 and n_found * FEW_LINKS < size_left["rows"]:
            left = scratch.write(_open(shared, labels), "left")
            break
        scratch.drop(left)
    if known is None:
        known = sketch.of(open_sets, left.select("s.sid").distinct())
    dealt = _with_all(left).withColumn("sid", F.col("s.sid")).join(known, "sid")
    rest = _compared(dealt, sketch, percent, size_left["rows"] or 0, pairs)
    more = scratch.write(_verified(scratch.write(sketch.bounded(rest, open_sets, percent), "pairs"), open_sets, percent), "links")
    return labels if more.isEmpty() else _joined(labels, more, scratch)


def classes(ids: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ids (doc_id, n, sid), from labels of sets."""
    own = ids.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("own"))
    named = own.join(labels, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "own")
    of_set = scratch.write(named.join(named.groupBy("label").agg(F.min("own").alias("component_id")), "label").select("sid", "component_id"), "classes")
    scratch.keep(ids, of_set)
    return ids.join(of_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join(docs: DataFrame, size: int = SIZE, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    scratch = Scratch(docs.sparkSession, "ngram")
    stored = scratch.write(sets(docs, size), "sets")
    ids = scratch.write(stored.select("doc_id", "n", "sid"), "ids")
    one = stored.where("grams is not null").select("sid", "n", "grams")
    rows = _prefixes(one, percent, scratch)
    # A member of a band is also offered to the next one where larger partners may be.
    bands = F.array_distinct(F.array(_band(F.col("n"), percent), _band(F.col("n") * (100.0 / percent), percent)))
    # The centre has the fewest shingles of its own: of a text and its edited copies that is the text.
    about = F.struct(*ABOUT)
    nearest = F.struct((F.col("alone") + F.coalesce("alone_2", F.col("alone") * 2)).alias("own"), F.xxhash64("sid").alias("h"), about.alias("s"))
    of_tile = Window.partitionBy("key", "tile")
    # Tiles with the same members count once: a tile's name is the exclusive or of its members' hashes.
    named = {"x": F.bit_xor(F.xxhash64("sid")).over(of_tile), "y": F.bit_xor(F.xxhash64(F.lit(1), "sid")).over(of_tile), "m": F.count("*").over(of_tile), "c": F.min(nearest).over(of_tile)}
    tiles = rows.select("key", *ABOUT, F.explode(bands).alias("tile")).withColumns(named).where("m > 1")
    shared = scratch.write(tiles.select("x", "y", about.alias("s"), "c").distinct(), "tiles")
    scratch.keep(stored, ids, shared)
    open_sets = scratch.write(_open_sets(one, shared.select("s.sid").distinct()), "open")
    scratch.drop(stored)
    return classes(ids, settle(shared, open_sets, Sketch(SHORT_COLUMNS, lambda found, _: found.select("sid", *SHORT_COLUMNS), None, _bounded), scratch, percent), scratch)
