"""Ordered segments and their translations as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(title: Column, ending: Column) -> Column:
    """A name without the characters that file systems refuse."""
    return F.concat(F.regexp_replace(title, r'[\\/:*?"<>|]', "_"), F.lit("."), ending)


def rendered(rows: DataFrame, group: str, order: str, text: Column, translated: Column, bilingual: bool, separator: str = "\n\n") -> DataFrame:
    """(group, body): each segment with its translation below it, or the translation alone."""
    has = F.btrim(F.coalesce(translated, F.lit(""))) != ""
    line = F.when(has, F.concat(text, F.lit("\n"), translated) if bilingual else translated).otherwise(text)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), line.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["line"]), separator).alias("body"))


def srt_body(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, body) of cues (order, start_at, end_at, text, translated)."""
    both = F.when(F.col("translated").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "translated"))
    comma = lambda c: F.replace(F.col(c), F.lit("."), F.lit(","))
    cue = F.concat(F.col(order).cast("string"), F.lit("\n"), comma("start_at"), F.lit(" --> "), comma("end_at"), F.lit("\n"), both)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), cue.alias("line"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("body"))


def shown(text: Column, translated: Column, bilingual: bool) -> Column:
    """A segment with its translation below it, or the translation alone; a segment without one stands for itself."""
    text, has = F.coalesce(text, F.lit("")), F.btrim(F.coalesce(translated, F.lit(""))) != ""
    return F.when(has, F.concat(text, F.lit("\n"), translated) if bilingual else translated).otherwise(text)


def markdown_piece(kind: Column, level: Column, marker: Column, text: Column, translated: Column, bilingual: bool) -> Column:
    """A segment in Markdown, with the blank line that ends it; items of a list follow each other without one, code is not translated.

    Null kinds are paragraphs, headings without a level are of the second, items without a marker have a dash."""
    line = shown(text, translated, bilingual)
    hashes = F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(level, F.lit(2)))).cast("int"))
    item = F.concat(F.coalesce(marker, F.lit("-")), F.lit(" "), F.replace(line, F.lit("\n"), F.lit(" ")), F.lit("\n"))
    code = F.concat(F.lit("```\n"), F.coalesce(text, F.lit("")), F.lit("\n```\n\n"))
    return F.when(kind == "heading", F.concat(hashes, F.lit(" "), line, F.lit("\n\n"))).when(kind == "list-item", item).when(kind == "code", code).otherwise(F.concat(line, F.lit("\n\n")))


def html_text(text: Column) -> Column:
    """A text with the signs of HTML escaped and its line breaks as breaks."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_piece(kind: Column, level: Column, text: Column, translated: Column, bilingual: bool) -> Column:
    """A segment as an HTML block, with its original and its translation in elements of their own."""
    original, other = html_text(F.coalesce(text, F.lit(""))), html_text(translated)
    box = lambda name, x: F.concat(F.lit(f'<div class="{name}">'), x, F.lit("</div>"))
    has = F.btrim(F.coalesce(translated, F.lit(""))) != ""
    pair = F.when(has, F.concat(box("original", original), box("translation", other)) if bilingual else box("translation", other)).otherwise(box("original" if bilingual else "translation", original))
    heading = F.concat(F.lit("h"), F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(level, F.lit(2)))).cast("string"))
    tag = F.when(kind == "heading", heading).when(kind == "quote", "blockquote").when(kind == "list-item", "li").otherwise("p")
    wrapped = F.concat(F.lit("<"), tag, F.lit(">"), pair, F.lit("</"), tag, F.lit(">"))
    return F.when(kind == "code", F.concat(F.lit("<pre><code>"), original, F.lit("</code></pre>"))).otherwise(wrapped)


def cue_piece(place: Column, start_at: Column, end_at: Column, text: Column, translated: Column, bilingual: bool, vtt: bool) -> Column:
    """A cue with the blank line that ends it; times are kept but for the sign before their fraction.  Null times are zero."""
    time = lambda x: F.translate(F.coalesce(x, F.lit("00:00:00.000")), ".,", ".." if vtt else ",,")
    return F.concat(place.cast("string"), F.lit("\n"), time(start_at), F.lit(" --> "), time(end_at), F.lit("\n"), shown(text, translated, bilingual), F.lit("\n\n"))


def json_piece(key: Column, text: Column, translated: Column, bilingual: bool) -> Column:
    """A member of the exported object, without the comma after it."""
    pair = F.struct(F.coalesce(text, F.lit("")).alias("original"), F.coalesce(translated, F.lit("")).alias("translation"))
    value = F.to_json(F.struct(pair.alias("v") if bilingual else shown(text, translated, False).alias("v")))
    name = F.to_json(F.struct(key.alias("k")))
    inner = lambda x: F.substr(x, F.lit(6), F.char_length(x) - 6)
    return F.concat(inner(name), F.lit(":"), inner(value))
