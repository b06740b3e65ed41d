import random
from collections import Counter

from quarryscan.llm import html_extract

PAGES = "page_id bigint, url string, html string"


def _rows(spark, bodies):
    rows = [(i, f"http://h.example.org/{i}", b) for i, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in html_extract.pages_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_template_goes_inside_the_content_root_and_copies_stay(spark):
    stories = [f"Story {i} tells at some length of thing {i * i}." for i in range(5)]
    page = lambda i, extra="": f"<body><article><p>{stories[i]}</p><div><p>Send this to a friend</p></div>{extra}</article></body>"
    # The last three copy the first story with other text.
    got = _rows(spark, [page(i) for i in range(5)] + [page(0, f"<p>v{i}</p>") for i in range(3)])
    assert got == {i: s for i, s in enumerate(stories)} | {5 + i: f"{stories[0]}\nv{i}" for i in range(3)}


def test_template_at_any_depth_on_every_page_of_a_host(spark):
    page = lambda i: f"<body><div><div><div><div><p>Deep line</p></div><div><p>text {i}</p></div></div></div></div></body>"
    assert _rows(spark, [page(i) for i in range(4)]) == {i: f"text {i}" for i in range(4)}


def test_template_in_long_lists():
    page = lambda name, n: "<body><div>" + "".join(f"<p>{name} {i}</p>" + "<p>Line of all pages</p>" * (i % 40 == 7) for i in range(n)) + "</div></body>"
    text = html_extract.extract(page("a", 300), html_extract.parse(page("b", 170)))
    assert text.count("Line of all pages") == 8 - 5
    assert text.count("a ") == 300


def test_copies_of_a_page_are_no_evidence(spark):
    page = "<body><div><p>One</p><p>Two</p></div></body>"
    assert _rows(spark, [page, page]) == {0: "One\nTwo", 1: "One\nTwo"}


def test_alignment_is_the_best_of_all():
    import random
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(150):
        a, b = ([rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))] for _ in "xy")
        x, y = (html_extract.Page(html_extract.parse("".join(f"<p>{t}</p>" for t in v))) for v in (a, b))
        subs = lambda v: {c for n in range(len(v) + 1) for c in combinations(v, n)}
        assert sum(x.size[k] for k in html_extract._constant(x, y) if a != b) == (max(sum(map(len, c)) for c in subs(a) & subs(b)) if a != b else 0)


def test_deep_pages_end():
    deep = "<div>" * 3000 + "<p>{}</p><p>same</p>"
    assert html_extract.extract(deep.format("one"), html_extract.parse(deep.format("other words"))) == "one"


def test_sentences_that_some_pages_share_stay(spark):
    rng = random.Random(4)
    pool = [f"A sentence that {k} pages may have." for k in range(30)]
    page = lambda i: f"<html><head><title>Head {i % 9} - Site</title></head><body><div class='menu'>Home</div><article><h1>Head {i % 9}</h1>" + "".join(f"<p>{t}</p>" for t in want[i][1:]) + "</article></body></html>"
    want = [[f"Head {i % 9}", f"Only page {i} says this, at {'some ' * (i % 7)}length.", *rng.sample(pool, 6)] for i in range(40)]
    assert _rows(spark, [page(i) for i in range(40)]) == {i: "\n".join(w) for i, w in enumerate(want)}


def test_a_host_against_every_pairing_of_its_lines(spark):
    """Pages of plain lines without telling tags: template is what longest common subsequences of lines with most other pages hold."""
    rng = random.Random(6)
    fixed = ["Home and contents", "All rights kept by the house", "Read more of this", "Send it on"]
    pages = []
    for i in range(7):
        own = [f"Line {i}.{k} " + "word " * rng.randrange(1, 5) for k in range(rng.randrange(3, 9))]
        for f in rng.sample(fixed, 4 if i % 3 else 3):
            own.insert(rng.randrange(len(own) + 1), f)
        pages.append([x.strip() for x in own])

    def common(a, b):
        best = [[(0, ())] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                both = (best[i][j][0] + len(x), (*best[i][j][1], i)) if x == y else (-1, ())
                best[i + 1][j + 1] = max(both, best[i][j + 1], best[i + 1][j], key=lambda v: v[0])
        return best[-1][-1]

    trees = [html_extract.Page(html_extract.parse("<body>" + "".join(f"<p>{t}</p>" for t in p) + "</body>")) for p in pages]
    for i, a in enumerate(pages):
        for j, b in enumerate(pages):
            if i != j:
                assert sum(trees[i].size[k] for k in html_extract.evidence(trees[i], trees[j])) == common(a, b)[0]
    got = _rows(spark, ["<body>" + "".join(f"<p>{t}</p>" for t in p) + "</body>" for p in pages])
    for i, a in enumerate(pages):
        kept = got[i].split("\n")
        assert [t for t in a if t.startswith("Line")] == [t for t in kept if t.startswith("Line")]
        held = Counter(t for j, _ in enumerate(pages) if j != i for t in {trees[i].nodes[k].kids[0] for k in html_extract.evidence(trees[i], trees[j])})
        assert {t for t in a if t not in kept} == {t for t, n in held.items() if n >= 4}


def test_many_hosts_take_the_way_of_shuffles(spark, monkeypatch):
    body = lambda i: f"<body><div><p>Own {i}</p><p>Same on the host</p></div></body>"
    rows = [(i, f"http://h{i % 3}.example.org/{i}", body(i)) for i in range(12)] + [(None, None, None), (50, "", "")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS _group", "map('a', 1) AS _hash", "3 AS `x.y`")
    one = sorted(map(str, html_extract.pages_text(frame).collect()))
    monkeypatch.setattr(html_extract, "SENT", 0)
    assert sorted(map(str, html_extract.pages_text(frame).collect())) == one
    assert sum("text='Own" in r and "Same" not in r for r in one) == 12


def test_empty_tables_and_very_long_pages(spark):
    assert html_extract.pages_text(spark.createDataFrame([], PAGES)).collect() == []
    words = "<p>" + "word &amp; more " * 200_000 + "</p>"
    assert [r["n_chars"] for r in html_extract.pages_text(spark.createDataFrame([(1, "http://a/", words)], PAGES)).collect()] == [12 * 200_000 - 1]
