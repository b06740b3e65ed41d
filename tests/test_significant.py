from quarryscan.operators import files

BODY = [f"x{i} = f({i});" for i in range(10)]


def _files(spark, rows, readable=None):
    return spark.createDataFrame([("a", i, t, t != "?") for i, t in enumerate(rows)], "artifact_id string, file_ord bigint, content string, readable boolean")


def test_files_equal_but_for_layout_are_identical(spark):
    plain = "\n".join(BODY)
    noisy = "import os\r\n\n// note\n{\n" + "\r\n".join(f"\t {x}  " for x in BODY) + "\n}\n};\nelse\n# end"
    short = "\n".join(BODY[:9])
    rows = files.identical(_files(spark, [plain, short, noisy, short, plain + "\nimportant();"])).collect()
    assert [(r["n_files"], r["first_file"], r["place"], r["n_groups"]) for r in rows] == [(2, 0, 1, 1)]


def test_the_ten_largest_groups_are_listed_and_all_counted(spark):
    texts = [f"k{k}\n" + "\n".join(BODY) for k in range(12) for _ in range(2 + (k == 11))]
    rows = sorted(files.identical(_files(spark, texts)).collect(), key=lambda r: r["place"])
    assert [r["first_file"] for r in rows] == [22, *range(0, 18, 2)]
    assert {r["n_groups"] for r in rows} == {12}


def test_shares_in_percent(spark):
    rows = _files(spark, ["m" * 300, "n\n" * 50, "", "?"])
    assert [tuple(r) for r in files.shares(files.shape(rows)).collect()] == [("a", 75, 75)]


def test_groups_by_sets_of_files(spark):
    """Blocks of the same files are one group, whatever their number of occurrences; sets are told apart as sets are in Python."""
    import random

    from quarryscan.operators import redundancy

    rng = random.Random(7)
    rows = [("a" if rng.random() < 0.8 else None, f"h{rng.randrange(25)}", rng.randrange(6), rng.randrange(1, 50)) for _ in range(220)]
    got = redundancy.block_groups(spark.createDataFrame(rows, "artifact_id string, block_sha256 string, file_ord int, line_no int")).collect()
    want = {}
    for a, h, f, line in rows:
        want.setdefault((a, h), []).append((f, line))
    assert {(r["artifact_id"], r["block_sha256"]): (r["n_occurrences"], r["n_files"], r["first_file"], r["first_line"]) for r in got} == {
        k: (len(v), len({f for f, _ in v}), *min(v)) for k, v in want.items() if len(v) > 1
    }
    of = {(r["artifact_id"], r["block_sha256"]): (r["n_files"], r["set_a"], r["set_b"]) for r in got}
    for k in of:
        for m in of:
            assert (of[k] == of[m]) == ({f for f, _ in want[k]} == {f for f, _ in want[m]})


def test_states_after_any_changes_are_those_of_what_is_left(spark):
    """Inserts and withdrawals in any order against scores over the findings that are left."""
    import random

    from quarryscan.operators import scoring

    rng = random.Random(9)
    rows = [(rng.choice("abc"), i, rng.randrange(5), rng.randrange(5), rng.choice(["Rule", "Rule", "Assisted"])) for i in range(120)]
    frame = spark.createDataFrame(rows, "artifact_id string, id int, severity int, user_severity int, source string")
    gone = {i for i in range(120) if rng.random() < 0.6 or rows[i][2] == 4 or rows[i][0] == "c"}
    stored = scoring.states(frame.where("id < 50"))
    for a, b in ((50, 80), (80, 120)):
        stored = scoring.merged(scoring.states(frame.where(f"id >= {a} AND id < {b}")), stored)
    left = scoring.merged(stored, scoring.states(frame.where(frame["id"].isin(*gone)), -1))
    got = {r["artifact_id"]: tuple(r)[1:] for r in scoring.scores_of(left).collect()}
    want = {r["artifact_id"]: (r["developer_score"], r["user_score"], r["score"]) for r in scoring.scores(frame.where(~frame["id"].isin(*gone))).collect()}
    assert got == {"c": (100, 100, 100)} | want
