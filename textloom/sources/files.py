"""Document files as segments: decoding, guarded archives, word-processor and e-book formats.

Files come through Spark's binaryFile source; each is parsed in the task that read it.
"""

from __future__ import annotations

import html as entities
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

from textloom.functions.splitting import split_for_import
from textloom.sources.html import block_rows

MAX_EXPANDED = 200 * 1024 * 1024
CHAPTER = re.compile(r"^(第.{1,40}[章节回卷部篇幕]\s*.*|(chapter|chap\.?|part|book|prologue|epilogue|interlude|appendix)\s+[\w-]*\s*[:.-]?\s*.{0,100})$", re.I)
CAPITALS = re.compile(r"^[A-Z0-9][A-Z0-9 .:'’-]{1,54}$")
SCHEMA = "path string, ordinal long, segment_id string, kind string, chapter string, text string, error string"


def decode(data: bytes) -> str:
    """Text of bytes with a UTF-16 or UTF-8 mark, else strict UTF-8."""
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:2] == b"\xfe\xff":
        return data[2 : len(data) - len(data) % 2].decode("utf-16-be", "replace")
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8")


class Archive:
    """A ZIP file with its guards: no encryption, no paths that lead out, a bound on what it expands to."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise ValueError("no ZIP file") from None
        self.names: dict[str, str] = {}
        for info in self.zip.infolist():
            name = posixpath.normpath(info.filename.replace("\\", "/"))
            if info.flag_bits & 1:
                raise ValueError("encrypted archive")
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError("unknown compression")
            if name.startswith(("../", "/")) or name == "..":
                raise ValueError("unsafe path in archive")
            if not info.is_dir():
                self.names[name] = info.filename
        if sum(i.file_size for i in self.zip.infolist()) > MAX_EXPANDED:
            raise ValueError("archive expands beyond its limit")

    def read(self, name: str) -> str:
        own = self.names.get(posixpath.normpath(name))
        if own is None:
            raise ValueError(f"archive lacks {name}")
        return self.zip.read(own).decode("utf-8", "replace")


def text_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of paragraphs; headings are marked, chapter-like or in capitals."""
    found = []
    for part in re.split(r"\n[^\S\n]*\n", text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")):
        line = " ".join(part.split())
        if line:
            head = bool(re.match(r"^#{1,6}\s+", line) or CHAPTER.match(line) or (2 < len(line) < 56 and CAPITALS.match(line)))
            found.append(("heading" if head else "paragraph", re.sub(r"^#{1,6}\s+", "", line)))
    return found


def docx_blocks(data: bytes) -> list[tuple[str, str]]:
    xml = Archive(data).read("word/document.xml")
    found = []
    for p in re.findall(r"(?s)<w:p(?:\s[^>]*)?>(.*?)</w:p\s*>", xml):
        text = " ".join("".join(entities.unescape(t) for t in re.findall(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t\s*>", p)).split())
        style = re.search(r"<w:pStyle\s[^>]*w:val=[\"']([^\"']+)", p)
        if text:
            head = bool(style and re.fullmatch(r"(?i)heading[1-6]|title", style[1])) or bool(CHAPTER.match(text))
            found.append(("heading" if head else "paragraph", text))
    return found


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v) for k, v in re.findall(r"([\w:-]+)\s*=\s*[\"']([^\"']*)[\"']", tag)}


def epub_blocks(data: bytes) -> list[tuple[str, str, str]]:
    """(kind, text, chapter) in the order of the spine; the title leads if it does not stand in the text."""
    archive = Archive(data)
    root = re.search(r"(?i)<rootfile\s([^>]*)>", archive.read("META-INF/container.xml"))
    opf_path = _attributes(root[1]).get("full-path", "") if root else ""
    opf = archive.read(opf_path)
    items = {a["id"]: a for a in map(_attributes, re.findall(r"(?i)<item\s([^>]*)>", opf)) if "id" in a and "href" in a}
    found: list[tuple[str, str, str]] = []
    parts = 0
    for ref in re.findall(r"(?i)<itemref\s([^>]*)>", opf):
        item = items.get(_attributes(ref).get("idref", ""))
        name = posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), unquote(item["href"].split("#")[0]))) if item else ""
        if name not in archive.names or not re.search(r"(?i)html", item.get("media-type", "") + name):
            continue
        blocks = [(tag, text) for _, tag, text, _, _ in block_rows(archive.read(name))]
        if blocks:
            parts += 1
            chapter = next((t for tag, t in blocks if tag[0] == "h" and tag[1:].isdigit()), f"Section {parts}")[:160]
            found += [("heading" if re.fullmatch("h[1-6]", tag) else "paragraph", t, chapter) for tag, t in blocks]
    title = re.search(r"(?is)<dc:title[^>]*>(.*?)</dc:title\s*>", opf)
    name = " ".join(entities.unescape(re.sub("<[^>]+>", "", title[1])).split())[:160] if title else ""
    if name and not any(kind == "heading" and text == name for kind, text, _ in found):
        found.insert(0, ("heading", name, name))
    return found


def file_segments(path: str, data: bytes) -> list[tuple]:
    """Rows of SCHEMA for one file; one that cannot be read gives a row with its error."""
    name = posixpath.basename(path)
    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if ending == "epub":
            blocks = epub_blocks(data)
        elif ending == "docx":
            blocks = chaptered(docx_blocks(data), name.rsplit(".", 1)[0])
        elif ending in ("html", "htm", "xhtml"):
            blocks = chaptered([("heading" if re.fullmatch("h[1-6]", t) else "paragraph", x) for _, t, x, _, _ in block_rows(decode(data))], name)
        elif ending in ("txt", "text", "md", "markdown"):
            blocks = chaptered(text_blocks(decode(data)), name)
        else:
            raise ValueError(f"no reader for .{ending}")
        if not blocks:
            raise ValueError("no text found")
    except (ValueError, KeyError) as e:
        return [(path, 0, None, None, None, None, str(e))]
    rows = []
    prefix = re.sub(r"^-+|-+$", "", re.sub(r"[^A-Za-z0-9_-]+", "-", name))[:70] or "section"
    for kind, text, chapter in blocks:
        for i, piece in enumerate(split_for_import(text)):
            rows.append((path, len(rows), f"{prefix}-{len(rows) + 1:05d}", kind if i == 0 else "paragraph", chapter, piece, None))
    return rows


def chaptered(blocks: list[tuple[str, str]], first: str, most_blocks: int = 40, most_chars: int = 20_000) -> list[tuple[str, str, str]]:
    """Blocks with the heading before them; long texts without one fall into numbered sections."""
    if any(kind == "heading" for kind, _ in blocks):
        out, chapter = [], first
        for kind, text in blocks:
            chapter = text[:160] if kind == "heading" else chapter
            out.append((kind, text, chapter))
        return out
    if len(blocks) <= 20 and sum(len(t) for _, t in blocks) <= most_chars:
        return [(k, t, first) for k, t in blocks]
    out, section, n, chars = [], 1, 0, 0
    for kind, text in blocks:
        if n and (n >= most_blocks or chars + len(text) > most_chars):
            section, n, chars = section + 1, 0, 0
        n, chars = n + 1, chars + len(text)
        out.append((kind, text, f"Part {section:02d}"))
    return out


def segments(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) to ordered segments."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split(" ")[0] for p in SCHEMA.split(", ")]
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(file_segments(path, bytes(data)), columns=names)

    return files.select("path", "content").mapInPandas(batches, SCHEMA)
