"""Pages as trees in tables: elements numbered in document order, each with the number of its last descendant.

An element's descendants are those whose number lies behind its own and not behind
``last``; so what holds for a subtree is a difference of two running sums, and what holds
for an ancestor is a running maximum (``operators/page_tree``).  What only the tags below
decide is counted here, since it comes back from there in a join of all elements.  Texts
are one stream a page, of which an element has a stretch.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from textloom.sources.html import _exploded, _Tree

# fixed values: elements that are blocks of their own, and those within a line
DIRECT = "h1 h2 h3 h4 h5 h6 p li dd blockquote figcaption".split()
INLINE = "a abbr b bdi bdo br cite code data dfn em i kbd mark q s samp small span strong sub sup time u var wbr ruby rb rt rp del ins font tt big strike img".split()
TREE_SCHEMA = (
    "node_id int, parent_id int, last int, depth int, path string, tag string, class string, dom_id string, role string, style string, rel string, hidden boolean, editable string, declared string, "
    "direct_text boolean, filled_child boolean, wide_child boolean, text_chars int, trimmed_chars int, text string, headings int, direct_inside int, structure_inside int, link_chars long"
)
#: Of an element's descendants: headings, blocks, and what an aside of prose is made of.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = HEADINGS | {"p", "li", "blockquote"}
_SOLID = re.compile(r"\S+")
_BLOCKS = frozenset(DIRECT)
_LINE = _BLOCKS | frozenset(INLINE)


class _Stream(_Tree):
    """Elements with their stretch of the page's text."""

    def __init__(self) -> None:
        super().__init__()
        self.stream: list[str] = []
        self.length = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        self.nodes[-1].update(start=self.length, end=self.length, direct=False, last=len(self.nodes) - 1, filled=False, wide=False, headings=0, blocks=0, structure=0, links=0)

    def handle_data(self, data: str) -> None:
        if self.stack:
            top = self.nodes[self.stack[-1]]
            self.stream.append(data)
            self.length += len(data)
            top["end"] = self.length
            top["direct"] = top["direct"] or not data.isspace()


def tree_rows(html: str | None) -> list[tuple]:
    """The page's elements (``TREE_SCHEMA``); ``text`` stands where only lines and blocks are inside."""
    page = _Stream()
    page.feed(html or "")
    page.close()
    stream = "".join(page.stream)
    spans = [m.span() for m in _SOLID.finditer(stream)]
    begins, ends = [s for s, _ in spans], [e for _, e in spans]
    nodes = page.nodes
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        # the first and the last character in the stretch that is no space
        a, b = bisect_right(ends, n["start"]), bisect_left(begins, n["end"]) - 1
        n["trimmed"] = max(0, min(ends[b], n["end"]) - max(begins[a], n["start"])) if a <= b else 0
        if n["parent"] >= 0:
            p = nodes[n["parent"]]
            p["end"], p["last"] = max(p["end"], n["end"]), max(p["last"], n["last"])
            p["filled"] = p["filled"] or n["trimmed"] > 0
            p["wide"] = p["wide"] or n["tag"] not in _LINE
            p["headings"] += n["headings"] + (n["tag"] in HEADINGS)
            p["blocks"] += n["blocks"] + (n["tag"] in _BLOCKS)
            p["structure"] += n["structure"] + (n["tag"] in STRUCTURE)
            p["links"] += n["links"] + (n["end"] - n["start"] if n["tag"] == "a" else 0)
    rows = []
    for i, n in enumerate(nodes):
        at = n["attrs"]
        hidden = "hidden" in at or at.get("aria-hidden") == "true"
        text = None if n["wide"] and n["tag"] not in DIRECT and at.get("data-as") != "p" else stream[n["start"] : n["end"]]
        rows.append((
            i, n["parent"], n["last"], n["depth"], n["path"], n["tag"], at.get("class", ""), at.get("id", ""), at.get("role", ""), at.get("style", ""), at.get("rel", ""), hidden, at.get("contenteditable"), at.get("data-as"),
            n["direct"], n["filled"], n["wide"], n["end"] - n["start"], n["trimmed"], text, n["headings"], n["blocks"], n["structure"], n["links"],
        ))
    return rows


def tree(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per element of every page; a null or empty page has none."""
    return _exploded(pages, id_col, html_col, tree_rows, TREE_SCHEMA)
