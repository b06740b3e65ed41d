"""Running values, budgets, progress, names and quotations against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quarryscan.operators import anchors, scans, triage

EPOCH = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_running_values_by_hand(spark, slice_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 90, 3)]), i, rng.randrange(-5, 9), rng.choice([None, "x", "y", "z"])) for i in range(150)]
    frame = spark.createDataFrame(rows, "g string, place long, tie int, n int, word string")
    got = scans.running(frame, ["g"], "place", ["tie"], {"total": ("sum", F.col("n")), "most": ("max", F.col("n")), "word_now": ("last", F.col("word")), "word_then": ("before", F.col("word"))}, slice_rows)
    want = []
    for g in {r[0] for r in rows}:
        total, most, now = 0, None, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            then, total, most, now = now, total + r[3], r[3] if most is None else max(most, r[3]), r[4] or now
            want.append((*r, total, most, now, then))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_budgets_by_hand(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), i // 2, rng.choice([None, *range(20)])) for i in range(100)]
    frame = spark.createDataFrame(rows, "g string, place long, n int")
    for whole in (False, True):
        want, total = [], {}
        for g in ("a", None):
            for place in range(50):
                mine = [r for r in rows if r[0] == g and r[1] == place]
                before = total.get(g, 0)
                total[g] = before + sum(r[2] or 0 for r in mine)
                if (total[g] <= 150) if whole else (before < 150):
                    want += mine
        got = scans.within_budget(frame, ["g"], "place", F.col("n"), 150, whole, slice_rows=7)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert scans.within_budget(frame.limit(0), ["g"], "place", F.col("n"), 150).count() == 0


def _shown(reports, looks):
    """The tracker as a loop, one report or look after another."""
    out = []
    for key in {r[0] for r in reports + looks}:
        furthest, entries = None, []
        steps = [(r[1], 0, r[2], r) for r in reports if r[0] == key] + [(x[1], 1, x[2], x) for x in looks if x[0] == key]
        for at, look, _, row in sorted(steps, key=lambda s: (s[0] is not None, s[0] or EPOCH, s[1], s[2])):
            if not look:
                _, _, _, share, start, message = row
                furthest = share if furthest is None else max(furthest, share)
                if not entries or entries[-1][1] != (message or ""):
                    entries.append((max(start, entries[-1][0]) if entries else start, message or ""))
                continue
            shown = min(max(0, min(100, row[3])), furthest) if furthest is not None else 0
            message = None
            if entries:
                message = ([entries[0][1]] + [m for f, m in entries if f <= shown])[-1]
            out.append((key, row[2], shown, message))
    return out


@pytest.mark.parametrize("slice_rows", [4, 1000])
def test_progress_by_a_loop(spark, slice_rows):
    rng = random.Random(slice_rows)
    moment = lambda: rng.choice([None, *[EPOCH + datetime.timedelta(seconds=s) for s in range(60)]])
    reports = [(rng.choice([1, 1, 2, None]), moment(), i, rng.randrange(101), rng.choice([0, 20, 50, 90]), rng.choice(["read", "scan", None])) for i in range(120)]
    looks = [(rng.choice([1, 1, 2, 3, None]), moment(), i, rng.randrange(-10, 140)) for i in range(120)]
    got = scans.progress(
        spark.createDataFrame(reports, "run long, at timestamp, report_id long, share int, start int, message string"), spark.createDataFrame(looks, "run long, at timestamp, look_id long, paced int"), "run", slice_rows
    ).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_shown(reports, looks), key=str)


def test_progress_before_the_first_report_and_without_a_row_for_each_value(spark):
    looks = spark.createDataFrame([(1, EPOCH, 7, 40), (2, EPOCH, 8, 30)], "run long, at timestamp, look_id long, paced int")
    reports = spark.createDataFrame([(1, EPOCH + datetime.timedelta(seconds=5), 1, 90, 0, "read"), (2, EPOCH, 2, 20, 50, "scan")], "run long, at timestamp, report_id long, share int, start int, message string")
    assert sorted(map(tuple, scans.progress(reports, looks, "run").collect())) == [(1, 7, 0, None), (2, 8, 20, "scan")]
    got = scans.progress(reports, looks, "run", unreported=F.col("paced"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 40, None), (2, 8, 20, "scan")]
    # A row for each key and value is a hundred times the keys, which Spark takes for small and sends whole.
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["progress_by_user", "progress_of_one"])
def test_progress_matches_its_sql_where_users_begin_with_views(spark, name):
    import duckdb

    from quarryscan.plans import search_queries

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    want = con.sql(search_queries.ORACLE_SQL[name]).select("run, look_id, shown, message").fetchall()
    got = search_queries.QUERIES[name](spark, "/root/testdata/sf0.01").select("run", "look_id", "shown", "message")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_names_by_contains(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(rng.choice(["p", "q", None]), i, rng.choice([None, "", word(300), word(40) + "\n" + word(40)])) for i in range(40)]
    names = [(rng.choice(["p", "q", None]), word(rng.randrange(2, 8))) for _ in range(60)] + [("p", None), ("p", "a.b*")]
    got = anchors.holding(spark.createDataFrame(names, "g string, name string"), spark.createDataFrame(texts, "g string, k int, content string"), "g", "k").collect()
    want = {(g, k, n) for g, k, t in texts for h, n in names if n and len(n) >= 4 and g == h and n in (t or "")}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 10


def test_holders_by_contains(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    texts = [(rng.choice(["p", "q", None]), i, rng.choice([None, "", word(300), word(30)])) for i in range(60)]
    names = [(rng.choice(["p", "q", None]), word(rng.randrange(2, 8))) for _ in range(80)] + [("p", None)]
    got = anchors.holders(spark.createDataFrame(names, "g string, name string"), spark.createDataFrame(texts, "g string, k int, content string"), "g", "k").collect()
    want = {(g, k) for g, k, t in texts for h, n in names if n and len(n) >= 4 and g == h and n in (t or "")}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and 5 < len(want) < 60


def test_texts_with_a_common_name_are_not_shuffled(spark, monkeypatch):
    """Names that many texts hold settle these where they are; the others are found by their rarest grams, and only grams of names leave a task."""
    monkeypatch.setattr(anchors, "FIRST", 1)
    monkeypatch.setattr(anchors, "GROUPS", 2)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [(rng.choice(["p", "q", "r", None]), i, word(120) + rng.choice(["", "", " than "]) + word(120)) for i in range(300)]
    names = [(g, "than") for g in ("p", "q", "r", None)] + [(rng.choice(["p", "q", None]), word(rng.randrange(4, 8))) for _ in range(120)]
    asked, grams = [], []
    real, kept = anchors._candidates, anchors._kept
    monkeypatch.setattr(anchors, "_candidates", lambda rows, rarest: (asked.append(rows.count()), real(rows, rarest))[1])
    monkeypatch.setattr(anchors, "_kept", lambda rows, by, wanted: (out := kept(rows, by, wanted), grams.append((rows.count(), out.count())))[0])
    got = anchors.holders(spark.createDataFrame(names, "g string, name string"), spark.createDataFrame(texts, "g string, k int, content string"), "g", "k").collect()
    want = {(g, k) for g, k, t in texts for h, n in names if g == h and n in t}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and 60 < len(want) < 300
    assert len(asked) == 1 and 200 < asked[0] < 290  # all but those of two groups that hold their group's first name
    assert grams[0][1] < grams[0][0] / 10


def test_advisories_are_looked_up_once_for_a_coordinate(spark):
    from quarryscan.plans import fixture_queries

    found, owners = fixture_queries._hits(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in found.select("artifact_id").distinct().collect()} == {"any"}
    assert owners.count() == owners.distinct().count()


def test_texts_go_to_python_in_small_batches(spark):
    from quarryscan.operators import prefilter, rules

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rules.matches(spark.createDataFrame([("a", 1, "x.py", "eval(x)", "Python", False)], "artifact_id string, file_ord int, path string, content string, language string, is_decompiled boolean"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == prefilter.BATCH_ROWS


def test_every_place_of_a_quotation(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab c😀") for _ in range(n))
    texts = [(i, word(400)) for i in range(12)] + [(50, None), (51, ""), (52, "ab" * 40)]
    cut = lambda: (lambda t, a, n: t[a : a + n])(texts[rng.randrange(12)][1], rng.randrange(370), rng.randrange(10, 60))
    quotes = [(i, cut()) for i in range(60)] + [(100, None), (101, "ab" * 12), (102, "b" * 30), (103, word(30))]
    frame = spark.createDataFrame(quotes, "q int, text string")
    got = anchors.located(frame, spark.createDataFrame(texts, "k int, content string"), "q", "k", F.col("text"), F.col("content")).collect()
    want = {(q, k, a) for q, s in quotes if s and len(s) >= anchors.LEAST for k, t in texts for a in range(len(t or "")) if (t or "").startswith(s, a)}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 40


def test_quotations_in_any_file(spark):
    files = spark.createDataFrame([("x", 1, "// The  Value is read\n// from the store.\nrun()"), ("x", 2, "nothing")], "artifact_id string, file_ord int, content string")
    quotes = spark.createDataFrame([(7, "the value is READ from the store."), (8, "too short")], "id int, text string")
    assert [tuple(r) for r in triage.quoted_from(quotes, files, "id").collect()] == [(7, 1, 0)]


def test_ranges_by_all_pairs(spark):
    from quarryscan.operators import advisories

    rng = random.Random(6)
    end = lambda: rng.choice([None, *range(0, 40)])
    points = [(rng.choice("ab"), rng.choice([None, *range(0, 45, 2)])) for _ in range(60)] + [("c", 1), ("c", 2)]
    ranges = [(rng.choice("abd"), i, end(), end()) for i in range(80)] + [("c", 100, 1, 2), ("c", 101, 2, 2), ("c", 102, None, None)]
    got = advisories.inside_ranges(spark.createDataFrame(points, "g string, at int"), spark.createDataFrame(ranges, "g string, range int, low int, high int"), ["g"]).collect()
    want = {(g, x, i) for g, x in points if x is not None for h, i, low, high in ranges if g == h and (low is None or x >= low) and (high is None or x < high)}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 80


def _statement(lines, index, most=3, near=3):
    """By a walk over the lines."""
    import re

    bare = lambda x: re.fullmatch(r"\s*[{}()\[\];,]+\s*", x)
    tag = lambda x: re.fullmatch(r"\s*(///|//|\*)\s*</?[A-Za-z][A-Za-z0-9]*(\s+[^<>]*)?/?>\s*", x)
    balance = lambda x: sum((c in "([") - (c in ")]") for c in x)
    if not lines[index].strip():
        return None
    for _ in range(near):
        if index > 0 and bare(lines[index]):
            index -= 1
    for _ in range(near):
        if index < len(lines) - 1 and tag(lines[index]):
            index += 1
    if not lines[index].strip() or bare(lines[index]) or tag(lines[index]):
        return None
    taken, depth = [lines[index]], balance(lines[index])
    for x in lines[index + 1 :]:
        if depth <= 0 or len(taken) == most:
            break
        taken.append(x)
        depth += balance(x)
    return "\n".join(taken).rstrip()


def test_statements_by_a_walk(spark):
    rng = random.Random(8)
    pieces = ["call(a,", "b[1", "]);", "{", "});", "/// <summary>", "* <p/>", "x = 1;", "", "  ", "f(g(", "))"]
    rows = []
    for i in range(150):
        lines = [rng.choice(pieces) for _ in range(rng.randrange(1, 9))]
        rows.append((i, lines, rng.randrange(len(lines))))
    frame = spark.createDataFrame(rows, "i int, lines array<string>, at int")
    got = {r["i"]: r["s"] for r in frame.select("i", triage.statement(F.col("lines"), F.col("at")).alias("s")).collect()}
    assert got == {i: _statement(lines, at) for i, lines, at in rows}


def test_properties_by_json(spark):
    import json

    from quarryscan.functions import variants

    texts = [None, "", "{", "7", "[]", "{}", '{"a": 1, "b": "x", "c": [1], "d": {"e": null}}', '{"a": null, "z": 1.5, "t": false}', '{"a": 1e300}']
    kinds = {int: "number", float: "number", str: "text", bool: "truth", type(None): "nothing", list: "list", dict: "object"}
    want = []
    for i, t in enumerate(texts):
        try:
            value = json.loads(t) if t is not None else {}
        except ValueError:
            want.append((i, None, None, variants.UNREADABLE))
            continue
        want += [(i, k, kinds[type(v)], None) for k, v in value.items()] if isinstance(value, dict) else [(i, None, None, variants.NO_OBJECT)]
    got = variants.properties(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), F.col("t")).select("i", "name", "kind", "note").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_scores_read_the_scan_once(spark):
    from quarryscan.plans import catalogue

    plan = catalogue.QUERIES["scan_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.split("\n")) == 1


def test_lines_of_an_artifact_within_budget(spark):
    from quarryscan.operators import redundancy

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, "\n" * rng.randrange(6)) for i in range(90)] + [("small", 1, "x"), ("small", None, "y\nz")]
    want, sums = set(), {}
    for a, i, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        if sums.get(a, 0) < 40:
            want.add((a, i))
        sums[a] = sums.get(a, 0) + text.count("\n") + 1
    frame = spark.createDataFrame(rows, "artifact_id string, file_ord long, content string")
    kept = redundancy.within_budget(frame, 40)
    assert {(r["artifact_id"], r["file_ord"]) for r in kept.collect()} == want and kept.columns == frame.columns
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
