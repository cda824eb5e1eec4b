"""HTML pages as node and block tables.

One tolerant pass of the standard library's parser per page, in Arrow batches; what
comes out is flat, so scoring and ranking are column expressions and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# fixed values: HTML's void elements, elements whose text is no prose, blocks, and those a block start closes
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("script style noscript template svg math head".split())
NOISE = set("nav footer aside header".split())
BLOCKS = set("h1 h2 h3 h4 h5 h6 p blockquote li pre dt dd figcaption td th caption".split())
CLOSES_P = BLOCKS | set("div section article main ul ol table form header footer nav aside".split()) - set("td th caption figcaption".split())
NODE_SCHEMA = (
    "node_id int, parent_id int, position int, depth int, path string, tag string, class string, dom_id string, role string, children int, "
    "own_text string, text_len int, readable_len int, link_count int, link_len int, paragraphs int, h1 int, h2 int, noise_len int"
)


class _Tree(HTMLParser):
    """Elements as a list of dicts in document order; unclosed paragraphs end where a block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and self.stack and self.nodes[self.stack[-1]]["tag"] == "p":
            self.stack.pop()
        if tag == "li" and self.stack and self.nodes[self.stack[-1]]["tag"] == "li":
            self.stack.pop()
        named = {k: v or "" for k, v in attrs}
        parent = self.stack[-1] if self.stack else -1
        same = 0
        if parent >= 0:
            counts = self.nodes[parent]["tags"]
            counts[tag] = same = counts.get(tag, 0) + 1
            self.nodes[parent]["children"] += 1
        path = (self.nodes[parent]["path"] if parent >= 0 else "") + f"/{tag}[{max(same, 1)}]"
        self.nodes.append({"tag": tag, "parent": parent, "path": path, "attrs": named, "tags": {}, "children": 0, "parts": [], "depth": len(self.stack)})
        if tag not in VOID:
            self.stack.append(len(self.nodes) - 1)
        elif tag == "br" and parent >= 0:
            self.nodes[parent]["parts"].append("\n")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.nodes[self.stack[-1]]["tag"] == tag:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[i]]["tag"] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack:
            self.nodes[self.stack[-1]]["parts"].append(data)


def parse_nodes(html: str) -> list[dict]:
    """The page's elements with their texts and counts summed up from below."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    for n in nodes:
        n["text"] = "".join(n["parts"])
        silent = n["tag"] in SILENT
        n["own"] = 0 if silent else len(n["text"])
        n.update(text_len=n["own"], noise_len=0, link_count=0, link_len=0, paragraphs=0, h1=0, h2=0)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        n["readable"] = n["text_len"] - n["noise_len"]
        p = nodes[n["parent"]] if n["parent"] >= 0 else None
        if p is None:
            continue
        gone = n["tag"] in SILENT
        p["text_len"] += 0 if gone else n["text_len"]
        p["noise_len"] += 0 if gone else n["text_len"] if n["tag"] in NOISE else n["noise_len"]
        p["link_count"] += n["link_count"] + (n["tag"] == "a")
        p["link_len"] += n["own"] if n["tag"] == "a" else n["link_len"]
        for k in ("h1", "h2"):
            p[k] += n[k] + (n["tag"] == k)
        p["paragraphs"] += n["paragraphs"] + (n["tag"] == "p")
    return nodes


def node_rows(html: str) -> list[tuple]:
    return [
        (
            i, n["parent"], i, n["depth"], n["path"], n["tag"], n["attrs"].get("class", ""), n["attrs"].get("id", ""), n["attrs"].get("role", ""), n["children"], n["text"],
            n["text_len"], n["readable"], n["link_count"], n["link_len"], n["paragraphs"], n["h1"], n["h2"], n["noise_len"],
        )
        for i, n in enumerate(parse_nodes(html))
    ]


def block_rows(html: str) -> list[tuple]:
    """(position, tag, text, heading path, list context) of the page's blocks outside noise; a text stands once."""
    nodes = parse_nodes(html)
    shut = [False] * len(nodes)
    inside: dict[int, int] = {}
    texts: dict[int, list[str]] = {}
    order: list[int] = []
    for i, n in enumerate(nodes):
        p = n["parent"]
        shut[i] = n["tag"] in SILENT or n["tag"] in NOISE or (p >= 0 and shut[p])
        if n["tag"] in BLOCKS:
            inside[i] = i
            order.append(i)
            texts[i] = []
        elif p >= 0 and p in inside:
            inside[i] = inside[p]
        if i in inside and not shut[i]:
            texts[inside[i]].append(n["text"])
    found: list[tuple] = []
    outline: list[tuple[int, str]] = []
    seen: set[str] = set()
    for i in order:
        text = " ".join(" ".join(texts[i]).split())
        if shut[i] or not text:
            continue
        tag = nodes[i]["tag"]
        if tag[0] == "h" and tag[1:].isdigit():
            outline = [o for o in outline if o[0] < int(tag[1])]
        path = " > ".join(t for _, t in outline)
        if tag[0] == "h" and tag[1:].isdigit():
            outline.append((int(tag[1]), text))
        if text not in seen:
            seen.add(text)
            found.append((len(found) + 1, tag, text, path, tag == "li"))
    return found


#: Rows and characters of an output batch: a batch a page costs more than parsing it does, and large pages are not held many at once.
BATCH_ROWS, BATCH_CHARS = 5000, 1 << 20


def _exploded(pages: DataFrame, id_col: str, html_col: str, rows_of, schema: str) -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    whole = f"{id_col} {kind}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(whole))
    return pages.select(id_col, html_col).mapInArrow(lambda frames: batched(frames, rows_of, arrow), whole)


def batched(frames: Iterator[pa.RecordBatch], rows_of: Callable[[str | None], list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars = 0
    for frame in frames:
        for page, html in zip(frame.column(0), frame.column(1), strict=True):
            own, text = page.as_py(), html.as_py()
            rows += [(own, *row) for row in rows_of(text)]
            chars += len(text or "")
            if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield from _cut(rows, schema)
                rows, chars = [], 0
    yield from _cut(rows, schema)


def _cut(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), BATCH_ROWS):
        columns = zip(*rows[at : at + BATCH_ROWS], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per element of every page."""
    return _exploded(pages, id_col, html_col, node_rows, NODE_SCHEMA)


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per text block of every page, in document order."""
    return _exploded(pages, id_col, html_col, block_rows, "position int, tag string, text string, heading_path string, in_list boolean")
