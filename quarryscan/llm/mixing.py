"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to (their pattern). Each pattern offers its size
once at no cost and again at a rising cost per repetition; tokens are routed from patterns to the
quotas of their sources at least total cost. What a pattern gives is taken as whole rounds over all its
documents and one part round over documents in seeded hash order, up to the first that does not fit; the largest documents after it that still fit
(`FILL` of them are looked at) take up the rest, so that what is missing is less than the smallest of these.

The number of sources and patterns must be small enough for the driver (one row each); documents are never
collected. Defined cases: null text has size 0 and gives 0; a null source is a source of its own; repeated
rows are taken alike, other rows of one id or without an id each by their own hash; an empty table gives an empty mix; further columns
are carried along, but size, source_size, target and taken are the mix's; very long texts count whole.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SEP, Scratch, row_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240
#: Hash bits resolved by each refinement of the cut, and their number.
_BITS, _LEVELS = 12, 4
#: Documents of a pattern that may fill what is left at its cut: the largest that fit, in seeded order.
FILL = 512


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_SEP, -1), "")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Quota by source: shares of `share` times all sizes by weight, stopped at `most` times the source's size;
    the excess is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def route(patterns: list[tuple[frozenset, int]], quota: dict, most: int = MOST) -> dict[tuple[int, object], int]:
    """Successive shortest paths: tokens from pattern i to source s, with cost r for the (r+1)th repetition."""
    nodes = {"S": 0, "T": 1}
    at = lambda key: nodes.setdefault(key, len(nodes))
    arcs: list[list[int]] = []  # to, capacity, cost; the reverse of arc i is i ^ 1
    out: dict[int, list[int]] = {}

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for frm, to, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out.setdefault(frm, []).append(len(arcs))
            arcs.append([to, c, w])
        return len(arcs) - 2

    routes = {}
    for i, (members, size) in enumerate(patterns):
        for r in range(most):
            arc(0, at(("p", i)), size, r)
        for s in sorted(members, key=lambda s: (s is None, s or "")):
            routes[i, s] = arc(at(("p", i)), at(("s", s)), most * size, 0)
    for s, q in quota.items():
        arc(at(("s", s)), 1, int(round(q)), 0)
    while True:
        cost, via, queue, waiting = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for i in out.get(a, []):
                to, capacity, w = arcs[i]
                if capacity > 0 and cost[a] + w < cost.get(to, 1 << 60):
                    cost[to], via[to] = cost[a] + w, i
                    if to not in waiting:
                        queue.append(to)
                        waiting.add(to)
        if 1 not in cost:
            break
        path, node = [], 1
        while node:
            path.append(via[node])
            node = arcs[via[node] ^ 1][0]
        flow = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= flow
            arcs[i ^ 1][1] += flow
    return {k: arcs[i ^ 1][1] for k, i in routes.items() if arcs[i ^ 1][1]}


def mix(rows: DataFrame, members: Column, size: Column, key: Column, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The input's columns with size, source_size, target (of the first source), and taken; these four replace columns of their names.

    `members` is an array of source names (null for none), `key` identifies a document for the seeded order; rows of one key are
    told apart by `_tie`, a hash of all their columns. Sizes are measured once, into a narrow table that the cuts are found on.
    """
    spark = rows.sparkSession
    narrow = rows.select(size.alias("_size"), F.array_sort(F.array_distinct(members)).alias("_members"), F.xxhash64(F.lit(seed), key, row_hash(rows)).alias("_hash"), F.struct("*").alias("_row"))
    narrow = narrow.withColumn("_key", F.to_json(F.struct("_members")))
    plain = Scratch(spark, "mixing").write(narrow.drop("_row"), "sizes")
    sums = plain.groupBy("_key").agg(F.first("_members").alias("_members"), F.sum("_size").alias("n")).orderBy("_key").collect()  # a row per pattern
    patterns = [(frozenset(r["_members"]), r["n"]) for r in sums]
    sizes: dict = {}
    for group, n in patterns:
        for s in group:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, most)
    given: dict[int, int] = {}
    for (i, _), n in route(patterns, quota, most).items():
        given[i] = given.get(i, 0) + n
    rounds = {i: given.get(i, 0) // n if n else 0 for i, (_, n) in enumerate(patterns)}
    rest = {i: given.get(i, 0) - rounds[i] * n for i, (_, n) in enumerate(patterns)}
    where = spark.createDataFrame([(r["_key"], i) for i, r in enumerate(sums)], "_key string, _p int")
    known = plain.join(F.broadcast(where), "_key").select("_p", "_size", "_hash")
    found = _cuts(known, rest)
    cuts = {i: cut for i, (cut, _) in found.items()}
    extra = spark.createDataFrame([(sums[i]["_key"], at, True) for i, at in _fill(known, found)], "_key string, _at long, _fills boolean")  # at most FILL rows for each pattern
    table = spark.createDataFrame(
        [
            (r["_key"], int(rounds[i]), cuts.get(i, -1), int(sizes.get(_first(r["_members"]), 0)), float(quota.get(_first(r["_members"]), 0.0)))
            for i, r in enumerate(sums)
        ],
        "_key string, _rounds long, _cut long, source_size long, target double",
    )  # one row for each pattern
    again = ((F.col("_at") <= F.col("_cut")) | F.coalesce("_fills", F.lit(False))).cast("long")
    mixed = narrow.withColumn("_at", _order(_BITS * _LEVELS)).join(F.broadcast(table), "_key").join(F.broadcast(extra), ["_key", "_at"], "left").withColumns({"size": F.col("_size"), "taken": (F.col("_rounds") + again) * F.col("_size")})
    mine = ("size", "source_size", "target", "taken")
    return mixed.select(*[F.col("_row")[c].alias(c) for c in rows.columns if c not in mine], *mine)


def _first(members) -> object:
    return min(members, key=lambda s: (s is None, s or "")) if members else None


def _order(bits: int) -> Column:
    """The leading bits of the seeded hash."""
    return F.shiftrightunsigned(F.col("_hash"), 64 - bits)


def _fill(known: DataFrame, found: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(pattern, hash prefix) of documents after the cut that take up what is left there: always the largest that still fits."""
    open_ = [(i, cut, left) for i, (cut, left) in found.items() if left > 0]
    if not open_:
        return []
    state = known.sparkSession.createDataFrame(open_, "_p int, _cut long, _left long")
    units = known.select("_p", "_size", _order(_BITS * _LEVELS).alias("_at")).join(F.broadcast(state), "_p").where(F.col("_at") > F.col("_cut"))
    units = units.groupBy("_p", "_at", "_left").agg(F.sum("_size").alias("n")).where("n > 0 AND n <= _left")
    best = units.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("n"), "_at"))).where(F.col("_k") <= FILL)
    left, out = {i: n for i, _, n in open_}, []
    for r in sorted(best.collect(), key=lambda r: (r["_p"], r["_k"])):  # at most FILL rows for each pattern
        if r["n"] <= left[r["_p"]]:
            left[r["_p"]] -= r["n"]
            out.append((r["_p"], r["_at"]))
    return out


def _cuts(known: DataFrame, rest: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per pattern the last hash prefix to take so that sizes add up to at most `rest`, found digit by digit, and what is left."""
    spark = known.sparkSession
    state = {i: (0, n) for i, n in rest.items() if n > 0}  # prefix of the digit's bucket, still to take
    for level in range(1, _LEVELS + 1):
        if not state:
            return {}
        bits = _BITS * level
        inside = spark.createDataFrame([(i, p) for i, (p, _) in state.items()], "_p int, _prefix long")
        found = (
            known.withColumn("_prefix", _order(bits - _BITS) if level > 1 else F.lit(0).cast("long"))
            .join(F.broadcast(inside), ["_p", "_prefix"], "left_semi")
            .groupBy("_p", _order(bits).alias("_digit")).agg(F.sum("_size").alias("n")).collect()
        )  # at most 2**_BITS rows for each pattern
        for i in state:
            left, last = state[i][1], None
            for digit, n in sorted((r["_digit"], r["n"]) for r in found if r["_p"] == i):
                if n > left or last is not None and left == 0:
                    last = (digit, left, n)
                    break
                left -= n
                last = None
            if last is None:
                last = (1 << bits, 0, 1)
            state[i] = (last[0], last[1])
            if level == _LEVELS:
                state[i] = (last[0] - 1, last[1])
    return state


def documents_mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """The mix of a documents table whose sources don't overlap."""
    return mix(docs, F.array(F.col("source").cast("string")), word_count(F.col("text")) if size is None else size, F.col("doc_id"))
