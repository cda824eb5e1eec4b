"""Text formats as ordered rows: plain text, Markdown lines, SRT and VTT cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, strip

# fixed values: file name endings, then media type parts in the order they are tried
EXTENSIONS = {
    "txt": "txt", "text": "txt", "md": "md", "markdown": "md", "mdx": "md", "html": "html", "htm": "html", "xhtml": "html",
    "srt": "srt", "vtt": "vtt", "json": "json", "pdf": "pdf", "docx": "docx", "epub": "epub",
}
MEDIA = [("pdf", "pdf"), ("epub", "epub"), ("wordprocessingml", "docx"), ("html", "html"), ("markdown", "md"), ("text/plain", "txt")]
# fixed values: the time line of a subtitle
TIME = r"(\d{1,3}:\d{2}:\d{2}[,.]\d{1,3}|\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,3}:\d{2}:\d{2}[,.]\d{1,3}|\d{2}:\d{2}[,.]\d{1,3})"


def detect_format(file_name: Column, media_type: Column) -> Column:
    """Format by the ending, else by the media type; null if neither is known."""
    ending = F.lower(F.element_at(F.split(file_name, r"\."), -1))
    by_ending = F.lit(None).cast("string")
    for end, kind in EXTENSIONS.items():
        by_ending = F.when(ending == end, kind).otherwise(by_ending)
    media = F.lower(F.coalesce(media_type, F.lit("")))
    by_media = F.lit(None).cast("string")
    for part, kind in reversed(MEDIA):
        by_media = F.when(media.contains(part), kind).otherwise(by_media)
    return F.coalesce(by_ending, by_media)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def paragraphs(text: Column) -> Column:
    """Array of paragraphs: lines between blank ones, each stripped, joined by line breaks."""
    lines = F.transform(F.split(unix_lines(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: strip(x))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")
    return F.filter(F.split(joined, "\n{2,}", -1), lambda p: p != "")


def paragraph_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment_index, text) of the paragraphs of every text."""
    return docs.select(id_col, F.posexplode(paragraphs(F.col(text_col))).alias("segment_index", "text"))


def classify_markdown(line: Column) -> tuple[Column, Column, Column, Column]:
    """Kind, level, marker and text of a line: heading, quote, list item, else paragraph."""
    heading, quote, item = line.rlike(r"^#{1,6}\s+.*$"), line.startswith(">"), line.rlike(r"^\s*([-*+]|\d+[.)、])\s+.*$")
    marker = F.regexp_extract(line, r"^\s*([-*+]|\d+[.)、])\s+(.*)$", 1)
    kind = F.when(heading, "heading").when(quote, "quote").when(item, "list-item").otherwise("paragraph")
    level = F.when(heading, F.char_length(F.regexp_extract(line, r"^(#{1,6})\s+(.*)$", 1)).cast("long"))
    mark = F.when(kind == "list-item", F.when(marker.rlike(r"^\d"), marker).otherwise("-"))
    body = (
        F.when(heading, F.regexp_extract(line, r"^(#{1,6})\s+(.*)$", 2))
        .when(quote, F.regexp_replace(line, r"^>\s?", ""))
        .when(item, F.regexp_extract(line, r"^\s*([-*+]|\d+[.)、])\s+(.*)$", 2))
        .otherwise(line)
    )
    return kind, level, mark, strip(body)


def srt_cues(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id, cue, number, start_at, end_at, text): blocks with a time line and text; a missing number is the cue's place."""
    blocks = files.select(id_col, F.posexplode(F.split(unix_lines(F.col(text_col)), "\n{2,}", -1)).alias("block", "body"))
    lines = blocks.withColumn("lines", F.filter(F.transform(F.split("body", "\n", -1), lambda x: strip(x)), lambda x: x != "")).where(F.size("lines") >= 2)
    numbered = F.get("lines", F.lit(0)).rlike(r"^\d+$")
    at = F.when(numbered, 1).otherwise(0)
    timed = lines.withColumn("at", at).withColumn("time", F.coalesce(F.get("lines", F.col("at")), F.lit("")))
    text = F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "\n")
    return timed.where(F.col("time").rlike(TIME)).withColumn("text", text).where(F.col("text") != "").select(
        id_col,
        "block",
        F.when(F.col("at") == 1, F.get("lines", F.lit(0)).cast("long")).alias("own_number"),
        F.replace(F.regexp_extract("time", TIME, 1), F.lit(","), F.lit(".")).alias("start_at"),
        F.replace(F.regexp_extract("time", TIME, 2), F.lit(","), F.lit(".")).alias("end_at"),
        "text",
    )


def vtt_cues(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id, block, start_at, end_at, text): the header and note, style and region blocks left out."""
    body = F.regexp_replace(unix_lines(F.col(text_col)), r"^\x{feff}?WEBVTT[^\n]*\n", "")
    blocks = files.select(id_col, F.posexplode(F.split(body, "\n{2,}", -1)).alias("block", "body")).withColumn("body", strip(F.col("body")))
    used = blocks.where((F.col("body") != "") & ~F.col("body").rlike(r"^(NOTE|STYLE|REGION)($|[^A-Za-z0-9_])"))
    lines = used.withColumn("lines", F.transform(F.split("body", "\n", -1), lambda x: strip(x)))
    place = F.array_position(F.transform("lines", lambda x: x.rlike(TIME)), F.lit(True)).cast("int")
    timed = lines.withColumn("place", place).where(F.col("place") > 0)
    time = F.get("lines", F.col("place") - 1)
    text = F.array_join(F.slice("lines", F.col("place") + 1, F.size("lines")), "\n")
    return timed.withColumn("text", text).where(F.col("text") != "").select(
        id_col,
        "block",
        F.replace(F.regexp_extract(time, TIME, 1), F.lit(","), F.lit(".")).alias("start_at"),
        F.replace(F.regexp_extract(time, TIME, 2), F.lit(","), F.lit(".")).alias("end_at"),
        "text",
    )


def json_leaves(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, text) of the string values of a flat JSON object."""
    parsed = F.from_json(F.col(json_col), "map<string,string>")
    return rows.select(id_col, F.explode(parsed).alias("key", "text")).select(id_col, F.concat(F.lit("$."), "key").alias("path"), "text")
