"""Running sums, maxima and last values over groups of any size, and what is built on them: budgets, and progress that never goes back.

A running value over a group is a scan in two levels. The group is cut into slices of its order, as many as its rows ask for; every slice is summed up, the
sums of the slices before are carried on (one row for each slice), and a window then looks at the rows of one slice only. No task holds
a whole group, and only the columns that the scan needs are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group in a slice, about.
SLICE = 100_000
#: Values of progress, from 0.
FULL = 100


def sliced(rows: DataFrame, group: list[str], place: str, slice_rows: int = SLICE) -> DataFrame:
    """The rows with `_slice`: equal ranges of `place` (a whole number) between the group's least and greatest; rows without a place are in the first."""
    span = rows.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.min(place).alias("_from"), F.max(place).alias("_to"), F.ceil(F.count("*") / slice_rows).alias("_n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # Doubles are exact enough: a slice's number falls with its place, whatever the rounding.
    share = (F.col(place).cast("double") - F.col("_from").cast("double")) / (F.col("_to").cast("double") - F.col("_from").cast("double") + 1)
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("_n")), F.col("_n") - 1)
    return rows.join(span, same).withColumn("_slice", number).drop("_from", "_to", "_n", *[f"_g_{g}" for g in group])


def running(rows: DataFrame, group: list[str], place: str, tie: list[str], values: dict[str, tuple[str, Column]], slice_rows: int = SLICE) -> DataFrame:
    """The rows with one more column for each of `values`, a kind and what it runs over in the order of place, then tie (nulls first).

    sum, max: up to and with the row; last: the last value that is not null, up to and with the row; before: the last one before it.
    """
    order = [F.col(place).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in tie]]
    cut = sliced(rows.withColumns({f"_v_{n}": v for n, (_, v) in values.items()}), group, place, slice_rows)
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    upto, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    totals, carried, local, merged = {}, {}, {}, {}
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    for name, (kind, _) in values.items():
        v, t, c = F.col(f"_v_{name}"), F.col(f"_t_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            totals[name], carried[name], local[name] = F.sum(v), F.sum(t).over(earlier), F.sum(v).over(upto)
            merged[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind == "max":
            totals[name], carried[name], local[name] = F.max(v), F.max(t).over(earlier), F.max(v).over(upto)
            merged[name] = F.greatest(F.col(f"_l_{name}"), c)
        else:
            totals[name] = F.max(F.when(v.isNotNull(), F.struct(place, *tie, v.alias("v"))))["v"]
            carried[name], local[name] = F.last(t, ignorenulls=True).over(earlier), F.last(v, ignorenulls=True).over(above if kind == "before" else upto)
            merged[name] = F.coalesce(F.col(f"_l_{name}"), c)
    sums = cut.groupBy(*group, "_slice").agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    names = {g: f"_g_{g}" for g in (*group, "_slice")}
    start = sums.withColumns({f"_c_{n}": c for n, c in carried.items()}).select(*[F.col(g).alias(a) for g, a in names.items()], *[f"_c_{n}" for n in values])
    same = F.lit(True)
    for g, a in names.items():
        same = same & F.col(g).eqNullSafe(F.col(a))
    both = cut.withColumns({f"_l_{n}": c for n, c in local.items()}).join(start, same, "left")
    return both.select(*rows.columns, *[c.alias(n) for n, c in merged.items()])


def within_budget(rows: DataFrame, group: list[str], place: str, size: Column, most: int, whole: bool = False, slice_rows: int = SLICE) -> DataFrame:
    """The rows of each group, in the order of place, until their sizes pass `most`: the one that does still counts, unless `whole`.

    Places identify the rows of a group; rows of one place count together. Only group, place and size go through the scan.
    """
    sizes = rows.select(*group, place, F.coalesce(size, F.lit(0)).cast("long").alias("_size")).groupBy(*group, place).agg(F.sum("_size").alias("_size"))
    total = running(sizes, group, place, [], {"_total": ("sum", F.col("_size"))}, slice_rows)
    fits = F.col("_total") <= most if whole else F.col("_total") - F.col("_size") < most
    kept = total.where(fits).select(*[F.col(c).alias(f"_k_{c}") for c in (*group, place)])
    same = F.lit(True)
    for c in (*group, place):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(kept, same, "left_semi")


def progress(reports: DataFrame, looks: DataFrame, key: str, slice_rows: int = SLICE, unreported: Column | None = None) -> DataFrame:
    """key, look_id, shown, message: what to show at each look. reports: key, at (timestamp), report_id, share and start (0 to FULL), message; looks: key, at, look_id, paced (0 to FULL).

    shown is the lower of `paced` and the greatest share reported up to then (at the look's own time too), so it never goes back by what is reported. A report is an entry
    where its message differs from the report's before; it counts from the greatest start of the entries down to it. The message is that of the last
    entry up to then which counts from `shown` or less, the first one if none does. Before the first report there is 0, or `unreported` over the look's columns, and no message.
    Reports and looks without a time, and null messages (as the empty one), are reports and looks at the beginning and messages like any other; keys may be null.
    """
    told = reports.select(F.col(key).alias("_key"), F.unix_micros(F.col("at").cast("timestamp")).alias("_at"), F.col("report_id").alias("_id"), "share", "start", F.coalesce("message", F.lit("")).alias("message"))
    flagged = running(told, ["_key"], "_at", ["_id"], {"_previous": ("before", F.col("message"))}, slice_rows).withColumn("_entry", ~F.col("message").eqNullSafe(F.col("_previous")))
    entries = running(flagged.where("_entry"), ["_key"], "_at", ["_id"], {"_no": ("sum", F.lit(1)), "_counts_from": ("max", F.col("start"))}, slice_rows)
    # By time: an as-of join as a union, of every look with the reports down to it.
    asked = looks.select(F.col(key).alias("_key"), F.unix_micros(F.col("at").cast("timestamp")).alias("_at"), F.lit(1).alias("_look"), F.col("look_id").alias("_id"), "paced", F.lit(None).cast("int").alias("share"), F.lit(0).alias("_entry"))
    steps = flagged.select("_key", "_at", F.lit(0).alias("_look"), "_id", F.lit(None).cast("int").alias("paced"), F.col("share").cast("int").alias("share"), F.col("_entry").cast("int").alias("_entry"))
    timed = running(steps.union(asked), ["_key"], "_at", ["_look", "_id"], {"_furthest": ("max", F.col("share")), "_so_far": ("sum", F.col("_entry"))}, slice_rows).where("_look = 1")
    seen = timed.withColumn("shown", F.when(F.col("_furthest").isNotNull(), F.least(F.greatest(F.lit(0), F.least(F.lit(FULL), F.col("paced"))), "_furthest")).otherwise(F.lit(0) if unreported is None else unreported))
    # By value: a key has the last entry that counts from each start, at most FULL + 1 of them in one row, and each look reads its own off that row.
    latest = entries.groupBy("_key", "_counts_from").agg(F.max("_no").alias("_no"))
    values = latest.groupBy(F.col("_key").alias("_k")).agg(F.collect_list(F.struct("_counts_from", "_no")).alias("_by"))
    met = seen.join(values, F.col("_key").eqNullSafe(F.col("_k")), "left").withColumn("_last", F.array_max(F.transform("_by", lambda e: F.when(e["_counts_from"] <= F.col("shown"), e["_no"])))).drop("_k", "_by")
    chosen = met.withColumn("_no", F.when(F.col("_so_far") > 0, F.greatest(F.lit(1), F.least(F.col("_so_far"), F.coalesce("_last", F.lit(1))))))
    said = entries.select(F.col("_key").alias("_k"), F.col("_no").alias("_n"), "message").hint("merge")  # a row for each entry: never sent whole
    return chosen.join(said, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_no") == F.col("_n")), "left").select(F.col("_key").alias(key), F.col("_id").alias("look_id"), F.col("shown").cast("int").alias("shown"), "message")
