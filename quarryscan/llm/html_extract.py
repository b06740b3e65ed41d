"""Main text of web pages by wrapper induction.

Every page is parsed to a tree of blocks and aligned with up to `REFERENCES` reference pages of its host that differ in
content. The alignment is exact simple tree matching: the order-keeping pairing of equal tags with the most constant text,
at any depth and for lists of any length. Matched blocks with equal text are template, the rest are varying slots. Content is
the slots inside the page's content root: an `article` or `main` element where there is one, else the body. Boilerplate
elements, reader comments, adverts, notices and forms go by element, role or class before the alignment.

A page is no evidence about its copies: pages of which more than half of the content root (nine tenths of the body, without a
content root) is constant are copies. A block is template when it is constant against two references and more than half of those that are no copies
(without a second one, against that one). Inside a content root it takes three quarters of at least `LEAST` references, so that a sentence which some pages
of a host have in common stays. A heading that the page's title holds is never template.

Defined cases: null or empty html gives the empty text; a host with one page has no template; unclosed elements end where HTML
ends them; rows without an id are no reference; repeated rows are extracted alike; an empty table gives no rows; very long or deep pages are
pages like any other. Of clashing columns only `page_id`, `url` and `html` are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"head", "script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form", "button", "select", "iframe", "svg", "dialog"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
_ENDS_P = {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "header", "nav", "aside", "main", "form", "pre", "blockquote", "hr", "dl", "figure"}
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|banner|comments?|disqus|replies|respond|sidebar|menu|navbar|breadcrumbs?|share|social|related|newsletter|popup|modal)(?:$|[\s_-])", re.I)
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: HTML's white space; a no-break space is a character of the text.
_WHITE = re.compile(r"[\x20\x09\x0A\x0C\x0D]+")
#: Reference pages of one host at most: the distinct pages of the smallest hash.
REFERENCES = 8
#: References that can make something inside a content root template.
LEAST = 3
#: Rows of references that are sent to every task; more are joined by shuffles.
SENT = 100_000
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Pages of one host that are dealt together.
_GROUP = 512


class Node:
    __slots__ = ("tag", "bad", "kids")

    def __init__(self, tag: str, bad: bool = False):
        self.tag, self.bad, self.kids = tag, bad, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        open_tags = [n.tag for n in self.stack]
        if tag in _ENDS_P and "p" in open_tags:
            self._close("p")
        if tag == "li" and "li" in open_tags and "ul" not in open_tags[len(open_tags) - open_tags[::-1].index("li") :]:
            self._close("li")
        if tag in _ENDS_P and len(self.stack) > 1:
            # An inline element left open does not reach over the next block's text.
            while len(self.stack) > 1 and self.stack[-1].tag in _INLINE:
                self.stack.pop()
        a = dict(attrs)
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        bad = tag in _SKIP or (a.get("role") or "").lower() in _BAD_ROLES or "hidden" in a or (tag not in ("html", "body", "article", "main") and bool(_BAD.search(names)))
        node = Node(tag, bad)
        self.stack[-1].kids.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def _close(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.stack[-1].kids.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def _text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.kids))
    return _WHITE.sub(" ", "".join(out)).strip()


class Page:
    """A page's blocks in document order. Text beside blocks is a block of its own (`#run`); inline elements belong to their block."""

    def __init__(self, root: Node):
        self.root = root
        self.title = next((_text(n) for n in _walk(root) if n.tag == "title"), "")
        roots = [n for n in _walk(root) if n.tag in ("article", "main")]
        inner = [n for n in roots if n.tag == "article" and not n.bad] or roots
        # Nested roots are part of the outer one.
        nested = {id(k) for n in inner for k in _walk(n) if k is not n}
        self.tops = [n for n in inner if id(n) not in nested]
        keep, block = {id(n) for n in self.tops}, set()
        for n in reversed(list(_walk(root))):
            if any(id(k) in keep for k in n.kids):
                keep.add(id(n))
            n.kids = [k for k in n.kids if isinstance(k, str) or not k.bad or id(k) in keep]
            if (n.tag not in _INLINE and n.tag != "br") or any(id(k) in block for k in n.kids):
                block.add(id(n))
        self.nodes: list[Node] = []
        self.kids: list[list[int]] = []
        self.inside: list[bool] = []
        top = {id(n) for n in self.tops}
        todo = [(root, -1)]
        while todo:
            n, parent = todo.pop()
            at = len(self.nodes)
            self.nodes.append(n)
            self.kids.append([])
            self.inside.append(not top or id(n) in top or (parent >= 0 and self.inside[parent]))
            if parent >= 0:
                self.kids[parent].append(at)
            if any(id(k) in block for k in n.kids):
                kids, run = [], None
                for k in n.kids:
                    if id(k) in block:
                        kids.append(k)
                        run = None
                    else:
                        if run is None:
                            run = Node("#run")
                            kids.append(run)
                        run.kids.append(k)
                n.kids = kids
                todo.extend((k, at) for k in reversed(kids))
        count = len(self.nodes)
        self.end, self.size, self.sign = [0] * count, [0] * count, [0] * count
        self.where: dict[int, list[int]] = {}
        for i in range(count - 1, -1, -1):
            tag, kids = self.nodes[i].tag, self.kids[i]
            if kids:
                self.end[i], self.size[i] = self.end[kids[-1]], sum(self.size[k] for k in kids)
                self.sign[i] = hash((tag, tuple(self.sign[k] for k in kids if self.size[k])))
            else:
                text = _text(self.nodes[i])
                self.end[i], self.size[i], self.sign[i] = i + 1, len(text), hash((tag, text))
        for i in range(count):
            if self.size[i]:
                self.where.setdefault(self.sign[i], []).append(i)
        self.total = sum(self.size[i] for i in range(count) if self.inside[i] and not self.kids[i])


def _heaviest(pairs: list[tuple[int, int, int, list[int]]], width: int) -> tuple[int, list[int]]:
    """The heaviest chain of (row, column, weight, blocks) that rises in rows and columns; pairs come by row, columns falling."""
    tree: list[tuple[int, int]] = [(0, -1)] * (width + 1)
    back = []
    for at, (_, column, weight, _) in enumerate(pairs):
        best, j = (0, -1), column
        while j:
            best, j = max(best, tree[j]), j & (j - 1)
        back.append(best[1])
        mine, j = (best[0] + weight, at), column + 1
        while j <= width:
            if tree[j][0] < mine[0]:
                tree[j] = mine
            j += j & -j
    best, j = (0, -1), width
    while j:
        best, j = max(best, tree[j]), j & (j - 1)
    found, at = [], best[1]
    while at >= 0:
        found.extend(pairs[at][3])
        at = back[at]
    return best[0], found


def _constant(a: Page, b: Page) -> list[int]:
    """The blocks of `a`, outermost first found, that exact simple tree matching pairs with equal blocks of `b`."""
    common = [i for i in range(len(a.nodes)) if a.size[i] and a.sign[i] in b.where]

    def solve(i: int, j: int):
        x, y = [k for k in a.kids[i] if a.size[k]], [k for k in b.kids[j] if b.size[k]]
        total, found, lo, hi = 0, [], 0, 0
        # Equal ends belong to a best pairing: no other partner of either gives more.
        while lo < min(len(x), len(y)) and a.sign[x[lo]] == b.sign[y[lo]]:
            lo += 1
        while hi < min(len(x), len(y)) - lo and a.sign[x[-1 - hi]] == b.sign[y[-1 - hi]]:
            hi += 1
        for k in (*x[:lo], *x[len(x) - hi :]):
            total += a.size[k]
            found.append(k)
        x, y, pairs = x[lo : len(x) - hi], y[lo : len(y) - hi], []
        if not x or not y:
            return total, found
        for p, k in enumerate(x):
            # Only pairs that share some block have a weight.
            partners = set()
            for c in common[bisect_left(common, k) : bisect_left(common, a.end[k])]:
                places = b.where[a.sign[c]]
                for d in places[bisect_left(places, y[0]) : bisect_left(places, b.end[y[-1]])]:
                    partners.add(bisect_right(y, d) - 1)
            for q in sorted(partners, reverse=True):
                if a.sign[k] == b.sign[y[q]]:
                    pairs.append((p, q, a.size[k], [k]))
                elif a.nodes[k].tag == b.nodes[y[q]].tag:
                    weight, blocks = yield k, y[q]
                    if weight:
                        pairs.append((p, q, weight, blocks))
        weight, blocks = _heaviest(pairs, len(y))
        return total + weight, found + blocks

    # Own stack: pages nest deeper than Python's calls may.
    stack, value = [solve(0, 0)], None
    while stack:
        try:
            stack.append(solve(*stack[-1].send(value)))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value[1]


def evidence(page: Page, reference: Page) -> list[int] | None:
    """Innermost blocks of the page's content that the reference holds constant; None if one is a copy of the other."""
    if page.sign[0] == reference.sign[0]:
        return None
    found = [k for i in _constant(page, reference) for k in range(i, page.end[i]) if page.size[k] and page.inside[k] and not page.kids[k]]
    same = sum(page.size[k] for k in found)
    copy = 2 * same > min(page.total, reference.total) if page.tops else 10 * same > 9 * max(page.total, reference.total)
    return None if copy else found


def different(pages: Sequence[Page]) -> list[Page]:
    """The pages, without those that are copies of an earlier one."""
    out: list[Page] = []
    for page in pages:
        if all(evidence(page, other) is not None for other in out):
            out.append(page)
    return out


def template(page: Page, references: Sequence[Page]) -> set[int]:
    """Identities of the page's innermost blocks that the wrapper holds constant."""
    held = [e for r in references if (e := evidence(page, r)) is not None]
    if page.tops and len(held) < LEAST:
        return set()
    least = -(-3 * len(held) // 4) if page.tops else len(held) // 2 + 1
    found = [page.nodes[k] for k, n in Counter(k for e in held for k in e).items() if n >= least]
    return {id(n) for n in found if n.tag not in _HEADINGS or _text(n) not in page.title}


def extract(html: str | None, reference: Node | Sequence[Page] | None = None) -> str:
    """`reference`: one parsed page, or different pages of the host."""
    page = Page(parse(html or ""))
    references = [Page(reference)] if isinstance(reference, Node) else reference or []
    constant = template(page, references)
    blocks: list[list[str]] = [[]]
    todo: list = list(reversed(page.tops or [page.root]))
    while todo:
        x = todo.pop()
        if x is None or id(x) in constant:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append("\n")
        else:
            edge = [] if x.tag in _INLINE or x.tag == "#run" else [None]
            todo.extend(reversed([*edge, *x.kids, *edge]))
    return "\n".join(t for b in blocks if (t := _WHITE.sub(" ", "".join(b)).strip(" ")))


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    # Narrow rows choose the references: a fixed-size summary of a host, not its pages.
    distinct = rows.where("page_id is not null and html <> ''").groupBy("host", F.xxhash64("html").alias("_hash")).agg(F.min("page_id").alias("page_id"))
    chosen = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("_hash"))).where(F.col("_n") <= REFERENCES).select("host", "page_id", "_hash")
    # Large hosts are dealt in groups, each with its copy of the references. Few hosts are sent to every task, more meet their pages in shuffles.
    hosts = rows.groupBy("host").agg(F.ceil(F.count("*") / _GROUP).cast("int").alias("_groups"))
    if hosts.count() * REFERENCES <= SENT:
        hosts, chosen = F.broadcast(hosts), F.broadcast(chosen)
    own = rows.join(hosts, "host").select("host", F.pmod(F.xxhash64("page_id", "url"), "_groups").cast("int").alias("_group"), F.lit(True).alias("_page"), "page_id", "url", "html")
    reference = rows.withColumn("_hash", F.xxhash64("html")).join(chosen, ["host", "page_id", "_hash"]).groupBy("host", "page_id", "_hash").agg(F.min("html").alias("html"))
    copies = reference.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"), F.lit(False).alias("_page"), "page_id", F.lit(None).cast("string").alias("url"), "html")
    dealt = own.unionByName(copies).repartition("host", "_group").sortWithinPartitions("host", "_group", "_page", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, htmls, references = None, [], None
        for batch in batches:
            ids, urls, texts = [], [], []
            for page_id, url, html, host, part, page in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "host", "_group", "_page"))):
                if (host, part) != group:
                    # The references come before the pages of their group.
                    group, htmls, references = (host, part), [], None
                if not page:
                    htmls.append(html)
                    continue
                if references is None:
                    references = different([Page(parse(h)) for h in htmls])
                ids.append(page_id)
                urls.append(url)
                texts.append(extract(html, references))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return dealt.mapInArrow(run, "page_id bigint, url string, text string, n_chars long")
