"""Page trees against a plain recursive walk of the same pages, rule by rule."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from textloom.operators import page_tree as pt
from textloom.plans.catalog import registered
from textloom.sources import html, tree

FOLDER = "/root/testdata/sf0.001"
LONG = "A sentence of plain prose, with enough words in it to count as one. "
INVISIBLE = "\t\n\x0b\f\r \xa0     　﻿​‌‍⁠\xad" + "".join(map(chr, range(0x2000, 0x200B)))


class Element:
    def __init__(self, row: tuple):
        self.row = dict(zip([x.strip().split(" ")[0] for x in tree.TREE_SCHEMA.split(", ")], row, strict=True))
        self.id, self.tag, self.cls, self.dom_id, self.role = (self.row[k] for k in ("node_id", "tag", "class", "dom_id", "role"))
        self.up: Element | None = None
        self.children: list[Element] = []

    def all(self):
        for x in self.children:
            yield x
            yield from x.all()

    def above(self):
        x = self.up
        while x:
            yield x
            x = x.up

    def has_class(self, *names: str) -> bool:
        return bool(set(self.cls.split()) & set(names))


def document(html: str | None) -> list[Element]:
    found = [Element(r) for r in tree.tree_rows(html)]
    for e in found:
        if e.row["parent_id"] >= 0:
            e.up = found[e.row["parent_id"]]
            e.up.children.append(e)
    return found


def named(cls: str, names) -> bool:
    return any(t == n or t.startswith((n + "-", n + "_")) or t.endswith(("-" + n, "_" + n)) for t in cls.lower().split() for n in names)


def like_paragraph(e: Element) -> bool:
    return e.row["declared"] == "p" or "public-draftstyledefault-block" in e.cls.lower()


def is_block(e: Element) -> bool:
    return e.tag in tree.DIRECT or like_paragraph(e)


def valid(text: str | None) -> bool:
    t = (text or "").strip(INVISIBLE)
    shouted = len(t) < 25 and re.fullmatch(r"[A-Z0-9\s]+", t) and not re.fullmatch(r"[0-9\s]+", t)
    return 3 <= len(t) < 100000 and not shouted and not re.fullmatch(r"[A-Za-z0-9+/=_-]{200,}", t)


def content_aside(e: Element) -> bool:
    if e.tag != "aside" or any(a.tag in ("nav", "footer", "dialog") for a in e.above()):
        return False
    if re.search(pt.LOW_PRIORITY, e.cls.lower()) or re.search(pt.LOW_PRIORITY, e.dom_id.lower()):
        return False
    region = any(a.tag in ("article", "main") or a.role in ("main", "article") or re.search(pt.CONTENT_WORDS, a.cls.lower()) for a in e.above())
    flow = e.up is not None and any(s is not e and s.tag in pt.PROSE_FLOW for s in e.up.children)
    if not (region or flow):
        return False
    return e.row["trimmed_chars"] >= 200 or (flow and any(x.tag in ("p", "li", "blockquote", *pt.HEADINGS) for x in e.all()))


def judge(e: Element, tables: bool) -> tuple[str, str]:
    style, short = e.row["style"].lower(), e.row["text_chars"] <= 5000
    if e.tag in ("svg", "math"):
        return "reject", "namespace"
    nested = (e.tag == "body" and e.row["parent_id"] != 0) or (e.tag == "html" and e.row["parent_id"] > 0)
    if (e.tag in pt.SKIPPED and not nested and not (tables and e.tag in pt.TABLES)) or e.has_class("notranslate") or e.row["editable"] in ("true", ""):
        return "reject", "tag"
    if e.row["hidden"] or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style):
        return "reject", "hidden"
    for a in (e, *e.above()):
        if a.tag in ("body", "html"):
            break
        if re.search(pt.CONSENT_ID, a.dom_id.lower()) or re.search(pt.CONSENT_CLASS, a.cls.lower()):
            if a.row["text_chars"] <= 5000:
                return "reject", "consent"
            break
    if named(e.cls, pt.noise_classes()) and short:
        return ("skip" if e.tag in ("article", "main") else "reject"), "noise"
    if re.search(pt.META_WORDS, e.cls.lower()) and e.tag not in ("article", "main") and not (e.tag in ("section", "div") and re.search(pt.CONTENT_WORDS, e.cls.lower())):
        return "reject", "metadata"
    if e.tag == "header":
        return ("skip" if any(x.tag in pt.HEADINGS for x in e.all()) else "reject"), "header"
    if content_aside(e):
        return "skip", "aside"
    if e.tag in pt.MEANT_AS_NOISE:
        return "reject", "meaning"
    if e.tag in tree.DIRECT and any(x.tag in tree.DIRECT for x in e.all()):
        return "skip", "holds blocks"
    if is_block(e):
        return ("accept", "block") if valid(e.row["text"]) else ("skip", "text")
    if any(x.tag not in tree.DIRECT and x.tag not in tree.INLINE for x in e.children):
        return "skip", "container"
    if (e.row["direct_text"] or e.row["filled_child"]) and valid(e.row["text"]):
        return "accept", "lines"
    return "skip", "text"


def plain_walk(root: Element, tables: bool = False) -> tuple[dict[int, tuple[str, str]], list[tuple[int, str, str]]]:
    """Verdicts by element, and blocks as (id, text, outline)."""
    verdicts, blocks, seen, outline = {}, [], set(), []

    def inside_article(e):
        return any(a.tag == "article" or a.role in ("article", "main") or named(a.cls, pt.ARTICLE_CLASSES) for a in (e, *e.above()))

    def visit(e: Element, closed: bool) -> None:
        kind, reason = ("reject", "inherited") if closed else judge(e, tables)
        verdicts[e.id] = kind, reason
        if kind != "reject":
            if e.tag in pt.HEADINGS:
                level = int(e.tag[1])
                outline[:] = [o for o in outline if o[0] < level] + [(level, (e.row["text"] or "").strip(INVISIBLE))]
            if kind == "accept":
                grabbed = True if is_block(e) else (inside_article(e) and not any(is_block(a) for a in e.above())) if e.tag in tree.INLINE else e.row["direct_text"]
                text = (e.row["text"] or "").strip(INVISIBLE)
                if grabbed and text and text not in seen:
                    seen.add(text)
                    blocks.append((e.id, text, " > ".join(t for _, t in outline)))
        shut = kind == "reject" or (kind == "accept" and reason == "block")
        for x in e.children:
            visit(x, shut)

    for x in root.children:
        visit(x, False)
    return verdicts, blocks


def page(inner: str, top: str = "") -> str:
    return f"<html><head><title>t</title></head><body {top}>{inner}</body></html>"


PAGES = [
    page("<header>logo</header><header><h1>Site title here</h1></header><nav>menu</nav><main><p>One para.</p><p>One para.</p><div>Plain text <b>bold</b></div></main>"),
    page(f"<article class='post has-sidebar sidebar'><h1>Head line</h1><p>{LONG}</p><aside><p>Key point</p></aside><aside class='related'><p>Other</p></aside><h2>Sub</h2><li>a <p>nested para</p></li></article>"),
    page(f"<div class='cookie-banner'>{LONG * 3}</div><div id='cookiesModal'>{LONG * 90}<p>inside long</p></div><div id='consent'><div><p>no no</p></div></div>"),
    page("<div class='post-meta'>By Me</div><div class='post__content category-x'><p>kept text</p></div><p class='post-meta'>gone</p><section class='author'>gone too</section>"),
    page("<p>SUBSCRIBE</p><p>ok</p><p>  ​ hidden edge\xad </p><p>12 34</p><p hidden>hid</p><p style='Display : none'>hid</p><div aria-hidden='true'><p>hid</p></div><p>" + "QUJD" * 60 + "</p>"),
    page("<svg><text>no</text></svg><div contenteditable><p>edit</p></div><div contenteditable='false'><p>shown para</p></div><div class='notranslate'><p>x yz</p></div>"),
    page("<article><span>Loose line in article</span><div><span data-as='p'>Declared <a>para</a></span><a>Loose link here</a></div><blockquote>Quoted words</blockquote></article><span>Loose outside</span>"),
    page("<section><html><body><p>nested document para</p></body></html></section><table><tr><td>cell text here</td></tr></table>"),
    page("<table><tr><td>Layout cell <b>text</b></td><td><p>para in cell</p></td></tr></table>"),
    page("<div class='public-DraftStyleDefault-block'><div><span>Draft</span> block</div></div><h3>Deep</h3><p>under deep</p><h2>Up</h2><p>under up</p><h4>Low</h4><p>under low</p>"),
    page("<aside>left</aside><div class='share-bar fixed'>s</div><div style='position:fixed; bottom: 0'>x</div><div role='dialog'>d</div><article><aside>kept</aside></article><div class='sticky bottom-0'>y</div>"),
    page("<div>text<p>block in text div</p></div><dialog><p>dialog para</p></dialog><address>addr</address><ul><li>one item</li><li></li></ul><pre>code</pre>"),
    "", None, "<p>no body at all", "<html><body></body></html>", page("<p>a" * 400),
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(11)
    bits = ["<div class='{}'>", "<p>", "<article>", "<aside>", "<header>", "<h2>", "<li>", "<span>", "<section id='{}'>", "<blockquote>", "<nav>"]
    words = "post meta sidebar content ad-box cookie related hero author story-body text".split()
    made = []
    for _ in range(60):
        out, open_ = [], []
        for _ in range(40):
            if open_ and rng.random() < 0.45:
                out.append(f"</{open_.pop()}>")
            elif rng.random() < 0.5:
                out.append(rng.choice(["word ", LONG, "CAPS", " ", "é some text", "tiny words here"]))
            else:
                bit = rng.choice(bits).format(rng.choice(words))
                out.append(bit)
                open_.append(re.match(r"<(\w+)", bit)[1])
        made.append(page("".join(out)))
    given = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").limit(40).collect()]
    rows = list(enumerate([*PAGES, *made, *given]))
    nodes = tree.tree(spark.createDataFrame(rows, "page_id long, html string")).localCheckpoint()
    return rows, nodes


def body_of(found: list[Element]) -> Element | None:
    return next((e for e in found if e.tag == "body"), None)


def bodies(nodes):
    return nodes.where("tag = 'body'").groupBy("page_id").min("node_id").withColumnRenamed("min(node_id)", "node_id")


@pytest.mark.parametrize("tables", [False, True])
def test_verdicts_of_the_walk(pages, tables):
    rows, nodes = pages
    got = {}
    for r in pt.walk(nodes, bodies(nodes), tables).select("page_id", "node_id", "verdict.kind", "verdict.reason").collect():
        got.setdefault(r.page_id, {})[r.node_id] = (r.kind, r.reason)
    reasons = set()
    for i, html in rows:
        root = body_of(document(html))
        want = plain_walk(root, tables)[0] if root else {}
        assert got.get(i, {}) == want, html
        reasons |= set(want.values())
    assert {r for _, r in reasons} == {"namespace", "tag", "hidden", "consent", "noise", "metadata", "header", "aside", "meaning", "holds blocks", "block", "text", "container", "lines", "inherited"}


def test_blocks_and_outlines(pages):
    rows, nodes = pages
    got = {}
    for r in pt.blocks(nodes, bodies(nodes)).collect():
        got.setdefault(r.page_id, []).append((r.node_id, r.text, " > ".join(r.outline)))
    for i, html in rows:
        root = body_of(document(html))
        assert sorted(got.get(i, [])) == (sorted(plain_walk(root)[1]) if root else []), html


def test_pages_without_blocks_are_walked_through_tables(pages):
    rows, nodes = pages
    found = {}
    for r in pt.page_blocks(nodes, bodies(nodes)).collect():
        found.setdefault(r.page_id, set()).add((r.text, r.by_tables))
    assert found[8] == {("Layout cell text", True), ("para in cell", True)}
    assert all(not t for _, t in found[7])


def test_marks(pages):
    rows, nodes = pages
    got = {(r.page_id, r.node_id): r for r in pt.marks(nodes).collect()}
    some = {"overlay": 0, "low_priority": 0, "removed": 0}
    for i, html in rows:
        for e in document(html):
            r = got.pop((i, e.id))
            cls, ident, style = e.cls.lower(), e.dom_id.lower(), e.row["style"].lower()
            over = bool(re.search(pt.OVERLAY_CLASS, cls) or re.search(pt.OVERLAY_ID, ident)) or e.role in ("dialog", "alertdialog")
            over = over or (e.tag == "div" and ("position:fixed" in style or "position: sticky" in style) and bool(re.search("banner|bar|toast|notice|alert", f"{cls} {ident}")))
            low = e.tag in ("nav", "footer", "aside") or (not any(x.tag in pt.HEADINGS for x in e.all()) if e.tag == "header" else bool(re.search(pt.LOW_PRIORITY, cls) or re.search(pt.LOW_PRIORITY, ident)))
            assert (r.overlay, r.low_priority) == (over, not over and low), (html, e.id)
            in_body = any(a.tag == "body" for a in e.above())
            stuck = bool(re.search(r"\b(fixed|sticky)\b", cls))
            gone = e.tag in ("aside", "dialog") and not any(a.tag == "article" for a in e.above())
            gone = gone or ((stuck or "position:fixed" in style or "position: sticky" in style) and bool(re.search(r"\bbottom-0\b|\binset-x-0\s+bottom", cls) or re.search(r"bottom\s*:\s*0", style)))
            gone = gone or (bool(re.search(pt.SHARE, f"{cls} {ident}")) and (stuck or bool(re.search(r"\b(fixed|sticky)\b", style))))
            assert r.removed == (in_body and gone), (html, e.id)
            for k in some:
                some[k] += r[k]
    assert not got and all(some.values())


def score(e: Element) -> float:
    inside = list(e.all())
    n = lambda test: sum(map(test, inside))
    h1, nav = n(lambda x: x.tag == "h1"), n(lambda x: x.tag in ("nav", "footer", "header") or x.has_class("menu", "sidebar"))
    total = 20 if h1 == 1 else -10 if h1 else 0
    total += 10 * (n(lambda x: x.tag == "h2") >= 2) + min(30, e.row["trimmed_chars"] / 800) + min(20, n(lambda x: x.tag == "p")) + min(5, n(lambda x: x.tag in ("img", "figure")))
    total += 8 * (n(lambda x: x.row["rel"] == "author" or x.has_class("author", "byline") or "author" in x.cls) > 0) + 6 * (n(lambda x: x.tag == "time" or "date" in x.cls or "publish" in x.cls) > 0)
    total -= 8 * nav + 15 * (n(lambda x: x.tag == "button" or (x.tag == "a" and x.has_class("btn"))) > 10) + 8 * (n(lambda x: "related" in x.cls or "recommend" in x.cls) > 0) + 10 * (n(lambda x: x.tag == "li") > 80)
    return total


def headline(e: Element) -> bool:
    h1 = next((x for x in e.all() if x.tag == "h1"), None)
    return h1 is not None and 5 <= h1.row["trimmed_chars"] <= 199


def refine(e: Element) -> Element:
    heading = lambda inner, outer: any(x.tag in ("h1", "h2") and x.row["trimmed_chars"] >= 4 and x is not inner and x not in list(inner.all()) for x in outer.all())
    if e.has_class(*pt.BODY_CLASSES):
        article = next((a for a in e.above() if a.tag == "article"), None)
        return article if article and heading(e, article) else e
    for name in pt.BODY_CLASSES:
        inner = next((x for x in e.all() if x.has_class(name)), None)
        if inner:
            return e if e.tag == "article" and heading(inner, e) else inner
    return e


def unwrap(e: Element) -> Element:
    if e.has_class(*pt.BODY_CLASSES):
        return e
    for _ in range(pt.WRAPPERS):
        p = e.up
        if p is None or p.tag in ("body", "html") or re.search(pt.NO_WRAPPER, f"{p.cls} {p.dom_id}", re.I) or p.row["trimmed_chars"] > e.row["trimmed_chars"]:
            break
        e = p
    return e


def choose(e: Element) -> Element:
    if headline(e):
        return e
    line = []
    for a in (e, *e.above()):
        if a.tag in ("body", "html"):
            break
        line.append(a)
        if headline(a):
            break
    return max(line, key=score, default=e)


def grow(e: Element) -> Element:
    if any(x.tag == "h1" for x in e.all()) or e.up is None:
        return e
    before = [s for s in e.up.children if s.id < e.id and (s.tag == "header" or re.search(pt.HEADER_LIKE, s.cls, re.I))]
    return e.up if any(x.tag in pt.HEADINGS for s in before for x in s.all()) else e


ROOTS = [
    page(f"<article><header class='article_header'><h1>The headline</h1></header><div class='article-body'><p>{LONG * 4}</p></div></article>"),
    page(f"<article><h1>x</h1><div><div class='post-content'><p>{LONG}</p></div></div></article>"),
    page(f"<div class='w1'><div class='w2'><div class='w3'><main><div><p>{LONG * 3}</p><p>b</p></div></main></div></div></div>"),
    page(f"<div class='sidebar-wrap'><main><p>{LONG}</p></main></div>"),
    page(f"<div><section class='hero'><h1>Hero headline</h1><img><time>now</time></section><section class='rich-text'><h2>a</h2><h2>b</h2><p>{LONG * 5}</p></section></div>"),
    page("".join("<div>" for _ in range(9)) + f"<article><p>{LONG}</p></article>"),
    page(f"<main><div class='post-header'><h2>Two words</h2></div><div class='entry-content'><p>{LONG * 2}</p></div></main>"),
    page(f"<div role='main'><p>{LONG}</p><p class='byline'>me</p></div><div role='article'>short</div>"),
    page("<p>nothing chosen</p>"),
]


def test_roots_step_by_step(spark, pages):
    rows = [*enumerate(ROOTS), *((100 + i, h) for i, h in pages[0])]
    nodes = tree.tree(spark.createDataFrame(rows, "page_id long, html string")).localCheckpoint()
    named_rows = lambda df: {r.page_id: r.node_id for r in df.collect()}
    step = pt.selected_roots(nodes).localCheckpoint()
    now = named_rows(step)
    docs = {i: document(h) for i, h in rows}
    moved = {}
    for name, run, plain in (("refine", pt.refined_roots, refine), ("unwrap", pt.unwrapped_roots, unwrap), ("best", pt.best_roots, choose), ("header", pt.with_headers, grow)):
        step = run(nodes, step).localCheckpoint()
        after = named_rows(step)
        want = {i: plain(docs[i][n]).id for i, n in now.items()}
        assert after == want, name
        moved[name] = sum(after[i] != now[i] for i in now)
        now = after
    assert all(moved.values())
    assert 8 not in now and docs[8]


def test_selected_roots(spark):
    rows = [(1, page("<main>aa</main><article>b</article><article>ccc</article>")), (2, page("<div class='post-content'>x</div><article>longer one</article>")), (3, page("<div class='blog-content__x'>x</div>")), (4, page("<article> </article><main>m</main>"))]
    nodes = tree.tree(spark.createDataFrame(rows, "page_id long, html string"))
    tags = {(r.page_id, r.tag) for r in pt.selected_roots(nodes).join(nodes, ["page_id", "node_id"]).collect()}
    assert tags == {(1, "article"), (2, "div"), (4, "main")}


def test_risen_scores(spark):
    html = page(f"<div class='article'><div id='in'><p>{LONG}</p><p>{LONG}, and, more</p></div></div><div class='comment'><p>{LONG}</p><a>{LONG}</a></div>")
    nodes = tree.tree(spark.createDataFrame([(1, html), (2, page("short"))], "page_id long, html string"))
    by = {r.node_id: r.score for r in pt.risen_scores(nodes).collect()}
    doc = document(html)
    points = lambda p: 1 + len(re.findall("[,，、]", p.row["text"])) + min(3, p.row["trimmed_chars"] // 100)
    p = [e for e in doc if e.tag == "p"]
    inner, outer, other = p[0].up, p[0].up.up, p[2].up
    assert by[inner.id] == points(p[0]) + points(p[1]) + 5
    assert by[outer.id] == (points(p[0]) + points(p[1])) / 2 + 5 + 25
    link = next(e for e in doc if e.tag == "a").row["text_chars"]
    assert by[other.id] == pytest.approx((points(p[2]) + 5 - 25) * (1 - link / other.row["text_chars"]), abs=1e-6)
    best = pt.readability_roots(nodes).collect()
    assert [(r.page_id, r.node_id) for r in best] == [(1, outer.id)]


def test_intervals_and_stretches():
    doc = document(page("<div> <p>one <b>two</b></p>tail</div><p> </p>"))
    for e in doc:
        assert e.row["last"] == max([e.id, *(x.id for x in e.all())])
    div, p, b, blank = (e for e in doc if e.tag in ("div", "p", "b"))
    assert (p.row["text"], b.row["text"], div.row["text_chars"], div.row["trimmed_chars"]) == ("one two", "two", 12, 11)
    assert blank.row["trimmed_chars"] == 0 and not blank.row["direct_text"] and div.row["direct_text"]


@pytest.mark.parametrize("name", ["htm14_walk_verdicts", "htm16_walk_blocks"])
def test_queries_equal_the_plain_walk(spark, name):
    rows = registered()[name][0](spark, FOLDER).collect()
    want = set()
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        verdicts, blocks = plain_walk(body_of(document(r.html)))
        want |= {(r.page_id, i, *v) for i, v in verdicts.items()} if name.startswith("htm14") else {(r.page_id, *b) for b in blocks}
    got = {(r.page_id, r.node_id, r.kind, r.reason) if name.startswith("htm14") else (r.page_id, r.node_id, r.text, r.outline) for r in rows}
    assert got == want and len(rows) == len(want)


@pytest.mark.parametrize("name", ["ext28_refined_roots", "ext29_walk_facts", "flt16_node_marks", "htm06_readability_roots", "htm11_provider_union", "htm14_walk_verdicts", "htm16_walk_blocks"])
def test_pages_are_parsed_once(spark, name):
    plan = registered()[name][0](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # those that read the elements more than once read them from a table
    assert plan.count("MapIn") == (1 if name in ("ext29_walk_facts", "flt16_node_marks") else 0)


def test_counts_of_the_parser():
    doc = document(page(f"<header><h1>a</h1></header><div><p>{LONG}<a>in <a>nested</a></a></p><blockquote><p>x</p></blockquote><ul><li>y</li></ul></div><aside></aside>"))
    for e in doc:
        below = [x.tag for x in e.all()]
        assert e.row["headings"] == sum(t in pt.HEADINGS for t in below)
        assert e.row["direct_inside"] == sum(t in tree.DIRECT for t in below)
        assert e.row["structure_inside"] == sum(t in ("p", "li", "blockquote", *pt.HEADINGS) for t in below)
        assert e.row["link_chars"] == sum(x.row["text_chars"] for x in e.all() if x.tag == "a")


def test_small_pages_share_a_batch():
    frames = [pa.RecordBatch.from_arrays([pa.array([7] * 100), pa.array(["<p>x</p>"] * 100)], ["page_id", "html"])] * 3
    schema = pa.schema([("page_id", pa.int64()), ("tag", pa.string())])
    found = list(html.batched(iter(frames), lambda text: [("p",), ("b",)], schema))
    assert [b.num_rows for b in found] == [600]
    many = list(html.batched(iter(frames[:1]), lambda text: [("p",)] * 120, schema))
    assert max(b.num_rows for b in many) <= html.BATCH_ROWS and sum(b.num_rows for b in many) == 12000
