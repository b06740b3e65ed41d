"""Substring deduplication by repeated-phrase automata.

A window of 50 words that occurs twice holds the same 25-word anchor both times: of the 26 anchors in it the one with the smallest
hash is kept by winnowing, so equal windows keep equal anchors. Anchors of more than one text are the recurring
phrases. Every text that holds one is streamed, in blocks, through Aho-Corasick automata (over word numbers) of its block's
phrases, sharded so that no automaton has more than `SHARD` of them. Windows whose own anchor lies where an automaton
found a phrase are hashed to 128 bits, and a window is removed where a smaller id has it too.

Equal texts are streamed once, for their smallest id; all words of the others are covered if there are 50. Anchors and
windows travel packed, by parts of their hashes. A task settles what it can by itself before: of an anchor or a window
that several of its texts hold only one row travels, so very frequent passages don't gather in one task. Texts are told
apart by 64-bit hashes.

Defined cases: null texts have no words; fewer than 50 words hold no window; a repeat within one document is
not removed; rows without an id count as the largest id; repeated rows of one id do not remove each other;
an empty table gives no rows; very long texts are taken whole. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTITIONS, Scratch, bounded_batches, byte_slices, grouped, packed_rows, runs, window_hashes, word_hashes

WINDOW, ANCHOR = 50, 25
#: Phrases of one automaton, and rows a task settles and packs at a time.
SHARD, TOGETHER = 20_000, 1 << 19
#: Slots of the filter that spares other texts a shuffle, and groups that many copies of a text are dealt to.
SLOTS, SALTS = 1 << 18, 16
_NO_ID = (1 << 63) - 1
_OTHER = np.uint64(0x5BF03635DCE5E5A5)


def _own_anchors(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window the position of its smallest anchor; and all anchors' hashes. `hashes` are the words'."""
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    values = window_hashes(hashes, anchor)
    span = window - anchor + 1
    return np.lib.stride_tricks.sliding_window_view(values, span).argmin(1) + np.arange(len(values) - span + 1), values


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _by_text(k: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """k, ats: positions gathered by text."""
    order = np.argsort(k, kind="stable")
    k, at = k[order], at[order]
    i = np.flatnonzero(runs(k))
    return pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array([at[x:y].tobytes() for x, y in zip(i, np.append(i[1:], len(k)))], pa.binary())], ["k", "ats"])


def _recurring(docs: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    """k, ats (packed, possibly in several rows): the anchors of each text that another text has too."""
    schema = "p long, a binary, k binary, at binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            a, k, at = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((at, k, a))
            a, k, at = a[order], k[order], at[order]
            begins = runs(a)
            group = np.cumsum(begins) - 1
            texts = np.bincount(group, runs(a, k)) > 1
            known = texts[group]
            # Settled here: recurring. One row of each tells the other tasks, by a text number nobody else has.
            local = (int(-1 - abs(int(a[0]) % parts)) if len(a) else -1, b"", k[known].tobytes(), at[known].tobytes())
            tell = begins & known
            send = ~known | tell
            rows = [local, *packed_rows((a[send] >> np.uint64(40)).astype(np.int64) % parts, [a[send], k[send], np.where(tell, -1, at)[send].astype(np.int32)])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["p", "a", "k", "at"])

        held, n = [], 0
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), byte_slices(batch.column(1))):
                own, values = _own_anchors(word_hashes(data.split()), window, anchor)
                own = np.unique(own)
                held.append((values[own], np.full(len(own), k, np.int64), own.astype(np.int32)))
                n += len(own)
                if n >= TOGETHER:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, (a, k, at) in grouped(batches, 3):
            a, k, at = np.frombuffer(a, np.uint64), np.frombuffer(k, np.int64), np.frombuffer(at, np.int32)
            if p >= 0:
                order = np.lexsort((k, a))
                a, k, at = a[order], k[order], at[order]
                group = np.cumsum(runs(a)) - 1
                more = (np.bincount(group, runs(a, k)) > 1) | (np.bincount(group, at < 0) > 0)
                stay = more[group] & (at >= 0)
                k, at = k[stay], at[stay]
            if len(k):
                yield _by_text(k, at)

    rows = _keyed(docs).select("k", "text").mapInArrow(packed, schema)
    return rows.repartition(min(parts, PARTITIONS), "p").sortWithinPartitions("p").mapInArrow(met, "k long, ats binary")


def _automata(phrases: set[tuple]) -> list:
    out, rows = [], sorted(phrases)
    for i in range(0, len(rows), SHARD):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for phrase in rows[i : i + SHARD]:
            machine.add_word(phrase, len(phrase))
        machine.make_automaton()
        out.append(machine)
    return out


def located(words: tuple[int, ...], automata: list) -> np.ndarray:
    """True at the positions where a phrase of the automata begins."""
    out = np.zeros(len(words), bool)
    for machine in automata:
        for end, length in machine.iter(words):
            out[end - length + 1] = True
    return out


def _removals(marked: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    """k, ps (packed, possibly in several rows): starts of windows that a smaller id has too, from rows (d, k, text, ats)."""
    schema = "p long, h1 binary, h2 binary, d binary, k binary, at binary"

    def windows(rows: list[tuple]) -> pa.RecordBatch:
        numbers = [tuple((h & np.uint64(0x7FFFFFFF)).tolist()) for _, _, h, _ in rows]
        automata = _automata({words[a : a + anchor] for words, (_, _, _, ats) in zip(numbers, rows) for a in ats.tolist()})
        out = [[np.empty(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32)]
        for words, (d, k, hashes, _) in zip(numbers, rows):
            own, _ = _own_anchors(hashes, window, anchor)
            p = np.flatnonzero(located(words, automata)[own])
            h1, h2 = window_hashes(hashes, window)[p], window_hashes(hashes ^ _OTHER, window)[p]
            for column, values in zip(out, (h1, h2, np.full(len(p), d, np.int64), np.full(len(p), k, np.int64), p.astype(np.int32))):
                column.append(values)
        h1, h2, d, k, at = (np.concatenate(c) for c in out)
        order = np.lexsort((d, h2, h1))
        h1, h2, d, k, at = h1[order], h2[order], d[order], k[order], at[order]
        begins = runs(h1, h2)
        gone = d > d[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(d) else np.empty(0, bool)
        # Settled here: a smaller id of this block has the window. Rows of the smallest id go on.
        local = (-1 - (int(k[0]) % parts) if len(k) else -1, b"", b"", b"", k[gone].tobytes(), at[gone].tobytes())
        send = ~gone
        rows = [local, *packed_rows((h1[send] >> np.uint64(40)).astype(np.int64) % parts, [x[send] for x in (h1, h2, d, k, at)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 5))], ["p", "h1", "h2", "d", "k", "at"])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for d, k, data, ats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_slices(batch.column(2)), batch.column(3).to_pylist()):
                ats = np.unique(np.frombuffer(b"".join(ats), np.int32))
                rows.append((d, k, word_hashes(data.split()), ats))
                n += len(ats)
                if n >= SHARD:
                    yield windows(rows)
                    rows, n = [], 0
        if rows:
            yield windows(rows)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, columns in grouped(batches, 5):
            h1, h2, d, k, at = (np.frombuffer(c, t) for c, t in zip(columns, (np.uint64, np.uint64, np.int64, np.int64, np.int32)))
            if p >= 0:
                order = np.lexsort((d, h2, h1))
                h1, h2, d, k, at = h1[order], h2[order], d[order], k[order], at[order]
                begins = runs(h1, h2)
                gone = d > d[np.flatnonzero(begins)][np.cumsum(begins) - 1]
                k, at = k[gone], at[gone]
            if len(k):
                yield _by_text(k, at).rename_columns(["k", "ps"])

    rows = marked.select("d", "k", "text", "ats").mapInArrow(streamed, schema)
    return rows.repartition(min(parts, PARTITIONS), "p").sortWithinPartitions("p").mapInArrow(met, "k long, ps binary")


def _split(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` that may be among `chosen` (by k and d), and those that can't be, by a filter of fixed size."""
    slot = F.pmod(F.xxhash64("k", "d"), F.lit(SLOTS))
    slots = F.broadcast(chosen.select(slot.alias("_slot")).distinct())  # at most SLOTS rows
    placed = rows.withColumn("_slot", slot)
    return placed.join(slots, "_slot", "left_semi").drop("_slot"), placed.join(slots, "_slot", "left_anti").drop("_slot")


def cuts(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """d, k, later (an equal text has a smaller id), ps: one row for each id and text that loses words."""
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs)
    texts = scratch.write(keyed.groupBy("k").agg(F.min("d").alias("d"), F.max("d").alias("hi"), F.max(F.length("text")).alias("n")), "texts")
    # About one anchor in fourteen words of six letters stays; a part has about as many rows as a task packs at a time.
    parts = max(32, (texts.agg(F.sum("n")).first()[0] or 0) // (80 * TOGETHER))
    held = scratch.write(_recurring(docs, window, anchor, parts).groupBy("k").agg(F.collect_list("ats").alias("ats")), "phrases")
    chosen = scratch.write(held.join(texts.select("k", "d"), "k"), "chosen")
    scratch.drop(held)
    marked = _split(keyed.drop("doc_id"), chosen)[0].join(chosen, ["k", "d"])
    gone = _removals(marked, window, anchor, 2 * parts).groupBy("k").agg(F.collect_list("ps").alias("ps"))
    first = gone.join(texts.select("k", "d"), "k").select("d", "k", F.lit(False).alias("later"), "ps")
    salt = F.pmod("d", F.lit(SALTS)).cast("int")
    several = texts.where("d < hi").select("k", F.col("d").alias("lo"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = keyed.select("d", "k", salt.alias("salt")).join(several, ["k", "salt"]).where("d > lo").select("d", "k").distinct()
    out = scratch.write(first.union(later.select("d", "k", F.lit(True), F.lit(None).cast("array<binary>"))), "cuts")
    scratch.keep(out)
    return out


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space; null without `with_text`), kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, data, later, ps in zip(batch.column(0).to_pylist(), byte_slices(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = data.split()
                n = len(words)
                if later and n >= window:
                    words = []
                elif ps:
                    steps = np.zeros(n + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(ps), np.int32))
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    words = [w for w, g in zip(words, (np.cumsum(steps)[:n] > 0).tolist()) if not g]
                text = b" ".join(words)
                out.append((doc_id, n, n - len(words), text.decode("utf-8", "replace") if with_text else None, hashlib.sha256(text).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    found = cuts(docs, Scratch(docs.sparkSession, "passages"), window, anchor)
    some, others = _split(_keyed(docs), found)
    # Only rows that may lose words meet the cuts; the others stay where they are.
    cut = some.join(found, ["k", "d"], "left").select("doc_id", "text", "later", "ps")
    whole = others.select("doc_id", "text", F.lit(False).alias("later"), F.lit(None).cast("array<binary>").alias("ps"))
    schema = "doc_id bigint, n_words long, n_removed long, kept string, kept_sha256 string"
    return cut.mapInArrow(run, schema).union(whole.mapInArrow(run, schema))
