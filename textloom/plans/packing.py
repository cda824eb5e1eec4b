"""Queries over packing, splitting, files and exports."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import splitting
from textloom.operators import export, packing
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.sources import files, html

ITEMS = "(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, length(text) AS n, role FROM conversations)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", p.alias("p"), F.char_length("text").cast("long").alias("n"), "role")


def greedy(most: int, count: int, more: str = "", isolate: bool = False) -> str:
    alone = f" OR r.n > {most}" if isolate else ""
    return f"""WITH RECURSIVE i AS {ITEMS}, r AS (SELECT conv_id, p, n, role, CAST(1 AS BIGINT) AS batch, n AS total, CAST(1 AS BIGINT) AS held FROM i WHERE p = 1 UNION ALL
SELECT i.conv_id, i.p, i.n, i.role, CASE WHEN {{new}} THEN r.batch + 1 ELSE r.batch END, CASE WHEN {{new}} THEN i.n ELSE r.total + i.n END, CASE WHEN {{new}} THEN 1 ELSE r.held + 1 END FROM r JOIN i ON i.conv_id = r.conv_id AND i.p = r.p + 1)
SELECT conv_id, p, batch FROM r""".format(new=f"(r.held >= {count} OR r.total + i.n > {most}{alone}{more})")


@query("win06_segment_batches", greedy(1200, 4))
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(items(spark, sf_dir), ["conv_id"], ["p"], "n", 1200, 4).select("conv_id", "p", "batch")


@query("win07_run_batches", greedy(900, 16, " OR i.role <> r.role", True))
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(items(spark, sf_dir), ["conv_id"], ["p"], "n", 900, 16, "role", True).select("conv_id", "p", "batch")


@query("win05_token_chunks")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html.blocks(table(spark, sf_dir, "pages"))
    return packing.chunk(blocks, ["page_id"], ["position"], "text", "tag", target=400).select("page_id", "position", "tag", "tokens", "chunk")


@query("scl18_expanded_blocks")
def scl18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.expand_long(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("jon17_pieces_round_trip", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def jon17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pieces and put together again with their separators."""
    p = packing.expand_long(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    parts = F.array_sort(F.collect_list(F.struct("piece", F.concat("separator", "text").alias("t"))))
    whole = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return p.groupBy("doc_id").agg(F.md5(whole.cast("binary")).alias("text_md5"))


@query("scl17_soft_splits")
def scl17(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.pieces_udf(splitting.split_at_stops)
    return table(spark, sf_dir, "documents").withColumn("p", cut("text")).select("doc_id", F.posexplode("p").alias("piece", "x")).select("doc_id", "piece", F.char_length("x.text").alias("n_chars"))


NUMBERS = Literal("number_id long, text string", ((1, "三百二十一"), (2, "十五"), (3, "两万零五"), (4, "一亿二千万"), (5, "two hundred and five"), (6, "twenty one thousand and three, then seven"), (7, "none")))


@query("scl14_number_words", f"SELECT number_id, value FROM (VALUES (1, '321'), (2, '15'), (3, '20005'), (4, '1000020000000'), (5, '205'), (6, '21003,7'), (7, '')) v(number_id, value)")
def scl14(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: str(splitting.chinese_number(t)) if any(c in splitting.CHINESE or c in splitting.SCALES for c in t) else ",".join(map(str, splitting.english_numbers(t))))

    return NUMBERS.df(spark, sf_dir).select("number_id", value("text").alias("value"))


def sample_files() -> list[tuple[str, bytes]]:
    """Small files of every format, made here."""

    def zipped(parts: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
        return out.getvalue()

    word = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Opening</w:t></w:r></w:p><w:p><w:r><w:t>First &amp; </w:t></w:r><w:r><w:t>second</w:t></w:r></w:p>'
    opf = '<package><dc:title>The Book</dc:title><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><itemref idref="a"/><itemref idref="b"/></package>'
    book = {"META-INF/container.xml": '<rootfile full-path="OEBPS/book.opf"/>', "OEBPS/book.opf": opf, "OEBPS/two.xhtml": "<h1>Second</h1><p>Later text.</p>", "OEBPS/one.xhtml": "<body><p>Early text.</p></body>"}
    return [
        ("a/plain.txt", b"CHAPTER ONE\n\nSome text.\n\nMore text."), ("a/wide.txt", "﻿para".encode("utf-16-le")), ("a/bad.txt", b"\xff\xffbroken\xfe"), ("a/page.html", b"<h2>Head</h2><p>Body text.</p><nav>no</nav>"),
        ("a/word.docx", zipped({"word/document.xml": word})), ("a/book.epub", zipped(book)), ("a/evil.docx", zipped({"../out": "x"})), ("a/none.xyz", b"x"),
    ]


@query("src17_file_segments")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p, bytearray(d)) for p, d in sample_files()], "path string, content binary")
    return files.segments(rows)


CUES = Literal("file_id long, cue long, start_at string, end_at string, text string, translated string", ((1, 1, "00:00:01.000", "00:00:02.000", "one", "eins"), (1, 2, "00:00:03.000", "00:00:04.000", "two", None), (2, 1, "00:00:09.500", "00:00:10.000", "x\ny", "z")), more=derived.CUES)


@query("snk01_srt_export", f"SELECT file_id, string_agg(CAST(cue AS VARCHAR) || chr(10) || replace(start_at, '.', ',') || ' --> ' || replace(end_at, '.', ',') || chr(10) || text || coalesce(chr(10) || translated, ''), chr(10) || chr(10) ORDER BY cue) AS body FROM {CUES.sql()} c GROUP BY file_id")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.srt_body(CUES.df(spark, sf_dir), "file_id", "cue")


@query("snk01_text_export", "SELECT conv_id, md5(string_agg(CASE WHEN role = 'user' THEN text || chr(10) || upper(role) ELSE text END, chr(10) || chr(10) ORDER BY p)) AS body_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations) GROUP BY conv_id")
def snk01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("p", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    body = export.rendered(c, "conv_id", "p", F.col("text"), F.when(F.col("role") == "user", F.upper("role")), True)
    return body.select("conv_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


TITLES = Literal("title string, ending string", (("a/b:c*?", "txt"), ('q"<x>|y', "srt"), ("plain", "md"), ("back\\slash", "html")), more=derived.TITLES)


@query("snk10_file_names", f"SELECT regexp_replace(title, '[\\\\/:*?\"<>|]', '_', 'g') || '.' || ending AS name FROM {TITLES.sql()} t")
def snk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TITLES.df(spark, sf_dir).select(export.file_name(F.col("title"), F.col("ending")).alias("name"))


@query("snk08_feature_index", "SELECT doc_id, '{\"chars\":' || CAST(n_chars AS VARCHAR) || ',\"lang\":\"' || lang || '\",\"lines\":' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || '}' AS features FROM documents")
def snk08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("n_chars").alias("chars"), "lang", F.size(F.split("text", "\n", -1)).alias("lines"))).alias("features"))


@query("snk05_session_merge", "SELECT conv_id, string_agg(k || '=' || v, ';' ORDER BY k) AS translations FROM (SELECT conv_id, role AS k, arg_max(text, (turn, role, text)) AS v FROM conversations GROUP BY 1, 2) WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 30) GROUP BY conv_id")
def snk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    newest = c.groupBy("conv_id").agg(F.max("turn").alias("t")).orderBy(F.col("t").desc(), "conv_id").limit(30).select("conv_id")
    last = c.join(newest, "conv_id", "left_semi").groupBy("conv_id", F.col("role").alias("k")).agg(F.max_by("text", F.struct("turn", "role", "text")).alias("v"))
    return last.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), ";").alias("translations"))


@query("snk11_inline_rule", "SELECT doc_id, n_chars <= 40 AND len(string_split(text, ' ')) <= 12 AND doc_id % 2 = 0 AS inline_display FROM documents")
def snk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") <= 40) & (F.size(F.split("text", " ", -1)) <= 12) & (F.col("doc_id") % 2 == 0)).alias("inline_display"))
