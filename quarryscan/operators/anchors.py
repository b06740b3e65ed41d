"""Where texts stand in other texts: inverted indexes of short pieces, joined by equality, and an exact check of what meets.

Names (`holding`, `holders`): a name meets the files that have its rarest 4-gram. How often grams are is counted by slots of a fixed table, and only grams by
which some name is looked for are shuffled, by a filter of fixed size. Quotations (`located`): both
sides are winnowed, that is, of every `WINDOW` neighbouring hashes of `PIECE` characters the least is an anchor. A text of at least
PIECE + WINDOW - 1 characters has an anchor of its own wherever it stands, so one anchor of a quotation, the rarest, finds all its places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a gram: the least length of a name.
GRAM = 4
PIECE, WINDOW = 12, 9
#: Texts whose grams are made at once, and lists that the candidates of a text are dealt to.
LOT, LISTS = 256, 4
#: Slots in which grams are counted, and words of 64 bits in a filter of grams or rows.
COUNTED, WORDS = 1 << 16, 1 << 18
#: Names that every text of a group is asked for first, their greatest length, and groups that have such names: those with the most names.
FIRST, FIRST_LENGTH, GROUPS = 64, 32, 1024
LEAST = PIECE + WINDOW - 1
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(rows: DataFrame, row: Column, text: Column) -> DataFrame:
    """_id, gram, slot: a hash of the row, hashes of its group (_g) with each distinct 4-gram of its text, and the slot that counts it. What hashes bring together by chance is told apart by the check of the names."""

    def distinct(text: str) -> np.ndarray:
        points = _points(text)
        return np.unique(_hashes(points, GRAM)) if len(points) >= GRAM else np.empty(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in (batch.slice(i, LOT) for i in range(0, batch.num_rows, LOT)):
                ids, seeds = lot.column(0).to_numpy(), lot.column(1).to_numpy().view(np.uint64)
                found = [distinct(t.as_py() or "") for t in lot.column(2)]
                sizes = [len(h) for h in found]
                every = np.concatenate(found)
                grams = every ^ np.repeat(seeds, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(grams.view(np.int64)), pa.array((every % np.uint64(COUNTED)).astype(np.int64))], ["_id", "gram", "slot"])

    return rows.select(row.alias("_id"), F.xxhash64("_g").alias("_s"), text.alias("_t")).mapInArrow(run, "_id bigint, gram bigint, slot bigint")


def _often(texts: DataFrame, body: Column) -> DataFrame:
    """slot, n: how often the 4-grams of a slot stand in all texts; those over the borders of two texts may count too. At most COUNTED rows leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for lot in (batch.slice(i, LOT) for i in range(0, batch.num_rows, LOT)):
                points = _points("\n".join(t or "" for t in lot.column(0).to_pylist()))
                if len(points) >= GRAM:
                    total += np.bincount((_hashes(points, GRAM) % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    return texts.select(body.alias("_t")).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def _kept(rows: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """The rows whose `by` is in wanted, and some others: by a filter of fixed size (64 bits in each of WORDS slots), without a shuffle of the rows."""
    word, bit = F.pmod(F.xxhash64(by), F.lit(WORDS)), F.pmod(F.xxhash64(F.lit(1), by), F.lit(64)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    marks = wanted.select(word.alias("_word"), mark.alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))  # at most WORDS rows
    return rows.join(F.broadcast(marks), (word == F.col("_word")) & (F.col("_marks").bitwiseAND(mark) != 0), "left_semi")


def _rarest(names: DataFrame, texts: DataFrame, group: str, key: str, body: Column) -> tuple[DataFrame, DataFrame]:
    """Names with the hash of their rarest gram (_g, name, gram) and how often its slot is met (n), and the texts (_g, _k, _id, _t)."""
    wanted = names.where(F.length("name") >= GRAM).select(F.struct(group).alias("_g"), "name").distinct().withColumn("_id", F.xxhash64("_g", "name"))
    whole = texts.select(F.struct(group).alias("_g"), F.col(key).alias("_k"), F.xxhash64(F.struct(group), F.col(key)).alias("_id"), body.alias("_t"))
    # A name with a gram that no text has leaves here.
    counted = _grams(wanted, F.col("_id"), F.col("name")).join(F.broadcast(_often(texts, body)), "slot", "left")
    rarest = counted.groupBy("_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    return wanted.join(rarest, "_id").select("_g", "name", F.col("r.gram").alias("gram"), F.col("r.n").alias("n")), whole


def _candidates(texts: DataFrame, rarest: DataFrame) -> DataFrame:
    """_id, _g, name: the texts that have a name's rarest gram. Only grams that are some name's rarest one are shuffled."""
    named = rarest.select("gram", "_g", "name")
    return _kept(_grams(texts, F.col("_id"), F.col("_t")).select("_id", "gram"), "gram", named).join(named, "gram").drop("gram")


def _gathered(met: DataFrame, whole: DataFrame) -> DataFrame:
    """Texts (_g, _k, _t) with lists of their candidates (_names), so that a text is copied for each list and not for each name."""
    lists = met.groupBy("_id", F.pmod(F.xxhash64("name"), F.lit(LISTS)).alias("_part")).agg(F.collect_set(F.struct("_g", "name")).alias("_names"))
    return lists.join(_kept(whole, "_id", met), "_id")


#: Whether a text holds a candidate of its own group.
_holds = lambda c: F.contains("_t", c["name"]) & c["_g"].eqNullSafe(F.col("_g"))


def holding(names: DataFrame, texts: DataFrame, group: str, key: str, text: str = "content") -> DataFrame:
    """group, key, name: the texts of a name's group that contain it. names: group, name (four characters at least; shorter ones give no rows).

    A rarest gram is chosen by the number of texts that have it; a name with a gram that no text has leaves there. Candidates meet their text by
    key in a few lists, so neither names nor texts are gathered. Groups may be null.
    """
    rarest, whole = _rarest(names, texts, group, key, F.coalesce(F.col(text), F.lit("")))
    found = _gathered(_candidates(whole, rarest), whole).select("_g", "_k", F.explode(F.filter("_names", _holds)).alias("c"))
    return found.select(F.col(f"_g.{group}").alias(group), F.col("_k").alias(key), F.col("c.name").alias("name")).distinct()


def holders(names: DataFrame, texts: DataFrame, group: str, key: str, text: str = "content") -> DataFrame:
    """group, key: the texts that contain some name of their group, without the pairs: these grow with names and texts alike.

    A text is first asked for some names of its group, those whose rarest gram is met most often: names of four characters are their own grams, so these are
    nearly sure to be there. Only texts without them meet all their candidates, and only these are shuffled.
    """
    rarest, whole = _rarest(names, texts, group, key, F.coalesce(F.col(text), F.lit("")))
    short = rarest.where(F.length("name") <= FIRST_LENGTH)
    order = Window.partitionBy("_g").orderBy(F.desc("n"), F.length("name"), "name")
    first = short.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= FIRST).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_f"))
    first = short.groupBy("_g").agg(F.count("*").alias("_n")).join(first, "_g").orderBy(F.desc("_n"), "_g").limit(GROUPS).select(F.col("_g").alias("_h"), F.col("_f.name").alias("_first"))
    tried = whole.join(F.broadcast(first), F.col("_g").eqNullSafe(F.col("_h")), "left").withColumn("_sure", F.coalesce(F.exists("_first", lambda c: F.contains("_t", c)), F.lit(False)))
    left = tried.where(~F.col("_sure")).select("_g", "_k", "_id", "_t")
    later = _gathered(_candidates(left, rarest), left).where(F.exists("_names", _holds))
    both = tried.where("_sure").select("_g", "_k").unionByName(later.select("_g", "_k"))
    return both.select(F.col(f"_g.{group}").alias(group), F.col("_k").alias(key)).distinct()


def _hashes(points: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """A hash of each `piece` neighbouring characters."""
    n = len(points) - piece + 1
    out = np.zeros(n, np.uint64)
    for i in range(piece):
        out = (out ^ points[i : i + n].astype(np.uint64)) * _MUL
        out ^= out >> np.uint64(29)
    return out


def winnowed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text: hashes, and their places in characters. Of equal least hashes in a window the last is taken."""
    points = _points(text)
    if len(points) < LEAST:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _hashes(points)
    windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))
    return h[at], at


def _anchors(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, hash, place: the anchors of each row's text."""
    source = rows.select(*keys, text.alias("_t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnowed(t or "") for t in batch.column(len(keys)).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
            hashes, places = (np.concatenate(x) if x else np.empty(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(len(keys))), pa.array(hashes.view(np.int64)), pa.array(places)], [*keys, "hash", "place"])

    return source.mapInArrow(run, f"{kinds}, hash bigint, place bigint")


def located(quotes: DataFrame, texts: DataFrame, quote: str, key: str, quoted: Column, body: Column) -> DataFrame:
    """quote, key, start: every place (0-based, in characters) of a text at which a quotation of at least LEAST characters stands.

    `quote` and `key` name the columns that identify the rows of quotes and texts; `quoted` and `body` are their texts, compared as they are. Equal
    quotations are looked for once. Shorter and null ones give no rows.
    """
    asked = quotes.select(F.col(quote), quoted.alias("_q")).where(F.length("_q") >= LEAST)
    once = asked.groupBy("_q").agg(F.xxhash64("_q").alias("_id"))
    mine = _anchors(once, ["_id"], F.col("_q"))
    theirs = _anchors(texts, [key], body).join(mine.select("hash").distinct(), "hash", "left_semi")
    often = theirs.groupBy("hash").agg(F.count("*").alias("n"))
    # A quotation with an anchor that no text has stands nowhere.
    rarest = mine.join(often, "hash", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("r")).where("r.n > 0")
    met = theirs.join(rarest.select("_id", "r.hash", F.col("r.place").alias("_at")), "hash").select(key, "_id", (F.col("place") - F.col("_at")).alias("start")).where("start >= 0")
    checked = met.join(once, "_id").join(texts.select(key, body.alias("_t")), key)
    stands = checked.where(F.substring("_t", F.col("start").cast("int") + 1, F.length("_q")) == F.col("_q")).select("_q", key, "start")
    return asked.join(stands, "_q").select(quote, key, "start").distinct()
