"""Queries over formats and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import SPACE
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.sources import formats


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


FILES = Literal(
    "name string, media string",
    (
        ("a.txt", None), ("b.MD", "text/plain"), ("c.tar.gz", "application/gzip"), ("noext", "application/pdf"), ("d.srt", "text/plain"), ("e.vtt", None),
        ("f", "text/html; charset=utf-8"), ("g.docm", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("h.xhtml", None),
        ("i.epub", ""), ("j.unknown", "text/markdown"), ("k.json", "application/json"), ("l", "image/png"), ("m.", "text/plain"), ("epub", None),
    ),
    more=derived.FILES,
)
ENDINGS = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in formats.EXTENSIONS.items())
MEDIA = " ".join(f"WHEN contains(lower(coalesce(media, '')), '{p}') THEN '{k}'" for p, k in formats.MEDIA)


@query("src01_detect_format", f"SELECT name, media, coalesce(CASE lower(string_split(name, '.')[-1]) {ENDINGS} END, CASE {MEDIA} END) AS format FROM {FILES.sql()} f")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FILES.df(spark, sf_dir).withColumn("format", formats.detect_format(F.col("name"), F.col("media")))


PARAGRAPHS = f"""
SELECT doc_id, generate_subscripts(ps, 1) - 1 AS segment_index, unnest(ps) AS text FROM (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(array_to_string(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {strip_sql("x")}), chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n{{2,}}'), lambda p: p <> '') AS ps
  FROM documents)"""


@query("src02_plain_text_paragraphs", f"SELECT doc_id, segment_index, length(text) AS n_chars, md5(text) AS text_md5 FROM ({PARAGRAPHS})")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.paragraph_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("segment_index").cast("long").alias("segment_index"), F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


MD_LINES = Literal(
    "line_no long, line string",
    tuple(enumerate(["# Title here", "####### seven", "## ", "> quoted text", ">bare", "- item one", "* star", "  + plus  ", "1. first", "12) twelfth", "3、third", "-no space", "plain line", "  indented", "", "#hash", "1.5 litres"])),
)
MD_KIND = "CASE WHEN regexp_matches(line, '^#{1,6}\\s+.*$') THEN 'heading' WHEN starts_with(line, '>') THEN 'quote' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)、])\\s+.*$') THEN 'list-item' ELSE 'paragraph' END"


@query(
    "src03_markdown_lines",
    f"""WITH k AS (SELECT *, {MD_KIND} AS kind FROM (SELECT * FROM {MD_LINES.sql()} m UNION ALL SELECT 1000 + item_id AS line_no, text AS line FROM benchmark) l)
SELECT line_no, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) END AS level,
CASE WHEN kind = 'list-item' THEN CASE WHEN regexp_matches(regexp_extract(line, '^\\s*([-*+]|\\d+[.)、])\\s+(.*)$', 1), '^\\d') THEN regexp_extract(line, '^\\s*([-*+]|\\d+[.)、])\\s+(.*)$', 1) ELSE '-' END END AS marker,
{strip_sql("CASE kind WHEN 'heading' THEN regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2) WHEN 'quote' THEN regexp_replace(line, '^>\\s?', '') WHEN 'list-item' THEN regexp_extract(line, '^\\s*([-*+]|\\d+[.)、])\\s+(.*)$', 2) ELSE line END")} AS text FROM k""",
)
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = MD_LINES.df(spark, sf_dir).unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("line_no"), F.col("text").alias("line")))
    kind, level, marker, text = formats.classify_markdown(F.col("line"))
    return lines.select("line_no", kind.alias("kind"), level.alias("level"), marker.alias("marker"), text.alias("text"))


SRT = Literal(
    "file_id long, text string",
    (
        (1, "1\n00:00:01,000 --> 00:00:02,500\nHello there.\n\n2\n00:00:03,000 --> 00:00:04,000\nTwo\nlines\n\n\nno time\nhere\n\n00:10:00,1 --> 00:10:09,25\nunnumbered"),
        (2, "7\r\n01:02.5 --> 01:03.5\r\nshort form\r\n\r\n8\r\n00:00:09,000 --> 00:00:10,000\r\n\r\n9\r\n100:00:00.000 --> 100:00:01.000\r\nlast  "),
        (3, ""),
    ),
    more=derived.SRT,
)
TIME_SQL = formats.TIME


@query(
    "src04_srt_cues",
    f"""WITH b AS (SELECT file_id, generate_subscripts(bs, 1) - 1 AS block, unnest(bs) AS body FROM (SELECT file_id, string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{{2,}}') AS bs FROM {SRT.sql()} s)),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS ls FROM b),
t AS (SELECT *, CASE WHEN regexp_matches(ls[1], '^\\d+$') THEN 1 ELSE 0 END AS skip FROM l WHERE len(ls) >= 2),
u AS (SELECT *, coalesce(ls[skip + 1], '') AS line, array_to_string(ls[skip + 2:], chr(10)) AS words FROM t)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY block) AS cue,
CASE WHEN skip = 1 THEN CAST(ls[1] AS BIGINT) ELSE row_number() OVER (PARTITION BY file_id ORDER BY block) END AS number,
replace(regexp_extract(line, '{TIME_SQL}', 1), ',', '.') AS start_at, replace(regexp_extract(line, '{TIME_SQL}', 2), ',', '.') AS end_at, words AS text
FROM u WHERE regexp_matches(line, '{TIME_SQL}') AND words <> ''""",
)
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("file_id").orderBy("block")).cast("long")
    return formats.srt_cues(SRT.df(spark, sf_dir)).select("file_id", place.alias("cue"), F.coalesce("own_number", place).alias("number"), "start_at", "end_at", "text")


VTT = Literal(
    "file_id long, text string",
    (
        (1, "WEBVTT - title\n\nNOTE a comment\nspanning\n\nintro\n00:01.000 --> 00:02.000\nFirst cue\n\nSTYLE\n::cue {}\n\n00:00:03.000 --> 00:00:04.000 align:start\nSecond\ncue"),
        (2, "﻿WEBVTT\n\n00:05.000 --> 00:06.000\n\nNOTES are fine\n00:07.000 --> 00:08.000\nkept"),
    ),
    more=derived.VTT,
)


@query(
    "src05_vtt_cues",
    f"""WITH b AS (SELECT file_id, generate_subscripts(bs, 1) - 1 AS block, unnest(bs) AS body FROM (SELECT file_id, string_split_regex(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\x{{feff}}?WEBVTT[^\\n]*\\n', ''), '\\n{{2,}}') AS bs FROM {VTT.sql()} s)),
s AS (SELECT file_id, block, {strip_sql("body")} AS body FROM b),
l AS (SELECT *, list_transform(string_split(body, chr(10)), lambda x: {strip_sql("x")}) AS ls FROM s WHERE body <> '' AND NOT regexp_matches(body, '^(NOTE|STYLE|REGION)($|[^A-Za-z0-9_])')),
t AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '{TIME_SQL}')), true) AS place FROM l),
u AS (SELECT *, ls[place] AS line, array_to_string(ls[place + 1:], chr(10)) AS words FROM t WHERE place > 0)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY block) AS cue, replace(regexp_extract(line, '{TIME_SQL}', 1), ',', '.') AS start_at,
replace(regexp_extract(line, '{TIME_SQL}', 2), ',', '.') AS end_at, words AS text FROM u WHERE words <> ''""",
)
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("file_id").orderBy("block")).cast("long")
    return formats.vtt_cues(VTT.df(spark, sf_dir)).select("file_id", place.alias("cue"), "start_at", "end_at", "text")


@query("src07_json_leaves", "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.json_leaves(table(spark, sf_dir, "events"), "event_id", "props")


@query(
    "src08_segment_contract",
    "SELECT count(*) AS n_segments, count(*) FILTER (WHERE length(text) = 0 OR text IS NULL) AS n_blank, sum(length(text)) AS n_chars, count(*) - count(DISTINCT doc_id) AS n_repeated, "
    "count(*) <= 20000 AND sum(length(text)) <= 1500000 AS within_limits, count(DISTINCT CASE WHEN source IN ('heading', 'paragraph', 'quote', 'list-item', 'code', 'caption', 'other') THEN source ELSE 'paragraph' END) AS n_kinds FROM documents",
)
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source").isin("heading", "paragraph", "quote", "list-item", "code", "caption", "other"), F.col("source")).otherwise("paragraph")
    return d.agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("text").isNull() | (F.char_length("text") == 0)).alias("n_blank"),
        F.sum(F.char_length("text")).alias("n_chars"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_repeated"),
        ((F.count(F.lit(1)) <= 20000) & (F.sum(F.char_length("text")) <= 1500000)).alias("within_limits"),
        F.count_distinct(kind).alias("n_kinds"),
    )


BLOCKS_RE = r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>|<p[^>]*>(.*?)</p>|<blockquote[^>]*>(.*?)</blockquote>|<li[^>]*>(.*?)</li>|<pre[^>]*>(.*?)</pre>"
PAGES_CLEAN = "(?is)<(script|style|svg|head|nav)[^>]*>.*?</(script|style|svg|head|nav)>"


@query(
    "src15_html_regex_blocks",
    f"""WITH c AS (SELECT page_id, regexp_replace(html, '{PAGES_CLEAN}', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, generate_subscripts(bs, 1) AS position, unnest(bs) AS block FROM (SELECT page_id, regexp_extract_all(h, '{BLOCKS_RE}') AS bs FROM c))
SELECT page_id, position, lower(regexp_extract(block, '^<([a-z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(block, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM b""",
)
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace("html", PAGES_CLEAN, " ")
    blocks = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(BLOCKS_RE), F.lit(0))).alias("position", "block"))
    text = F.btrim(F.regexp_replace(F.regexp_replace("block", "<[^>]+>", " "), "[ \\t\\n\\r]+", " "))
    return blocks.select("page_id", (F.col("position") + 1).cast("long").alias("position"), F.lower(F.regexp_extract("block", "^<([a-z0-9]+)", 1)).alias("tag"), text.alias("text"))


HEADED = "regexp_matches(text, '^[A-Z][^ ]* ?[^ ]*$')"


@query(
    "src16_chapter_fill",
    """WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN left(text, 40) END AS heading FROM conversations)
SELECT conv_id, turn, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS chapter,
'c' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS VARCHAR), 5, '0') AS segment_id FROM t""",
)
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("heading", F.when(F.col("role") == "user", F.substring("text", 1, 40)))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    filled = F.last("heading", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return t.select("conv_id", "turn", F.coalesce(filled, F.lit("body")).alias("chapter"), F.concat(F.lit("c"), F.lpad(F.row_number().over(w).cast("string"), 5, "0")).alias("segment_id"))


@query("src19_point_and_range_scan", "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' AND n_chars BETWEEN 500 AND 5000 ORDER BY doc_id")
def src19(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.where((F.col("source") == "src3") & F.col("n_chars").between(500, 5000)).select("doc_id", "source", "n_chars").orderBy("doc_id")


SSE = Literal(
    "stream_id long, body string",
    (
        (1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}\n\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\n: ping\n\ndata: {"usage":{"total_tokens":7}}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n'),
        (2, 'event: x\ndata: {"choices":[{"delta":{}}]}\ndata: {"choices":[{"delta":{"content":" one line"}}]}\n'),
    ),
)


@query(
    "src21_sse_deltas",
    f"""WITH l AS (SELECT stream_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS line FROM (SELECT stream_id, string_split(body, chr(10)) AS ls FROM {SSE.sql()} s)),
d AS (SELECT stream_id, n, trim(line[7:]) AS payload FROM l WHERE starts_with(line, 'data: ')),
e AS (SELECT stream_id, min(n) AS stop FROM d WHERE payload = '[DONE]' GROUP BY stream_id)
SELECT d.stream_id, coalesce(string_agg(json_extract_string(payload, '$.choices[0].delta.content'), '' ORDER BY n), '') AS text, max(CAST(json_extract_string(payload, '$.usage.total_tokens') AS BIGINT)) AS total_tokens
FROM d LEFT JOIN e ON d.stream_id = e.stream_id WHERE payload <> '[DONE]' AND (stop IS NULL OR n < stop) GROUP BY d.stream_id""",
)
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = SSE.df(spark, sf_dir).select("stream_id", F.posexplode(F.split("body", "\n", -1)).alias("n", "line")).where(F.col("line").startswith("data: "))
    data = lines.select("stream_id", "n", F.btrim(F.substring("line", 7, 1_000_000_000)).alias("payload"))
    done = F.min(F.when(F.col("payload") == "[DONE]", F.col("n"))).over(W.partitionBy("stream_id"))
    live = data.withColumn("stop", done).where((F.col("payload") != "[DONE]") & (F.col("stop").isNull() | (F.col("n") < F.col("stop"))))
    parts = live.select("stream_id", "n", F.get_json_object("payload", "$.choices[0].delta.content").alias("part"), F.get_json_object("payload", "$.usage.total_tokens").cast("long").alias("tokens"))
    return parts.groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("n", "part")))), lambda x: x["part"]), "").alias("text"), F.max("tokens").alias("total_tokens")
    )


@query("src22_event_cursor", "SELECT event_id, ts, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_id > 500").select("event_id", "ts", "user_id", "event_type").orderBy("event_id").limit(100)


CATALOG = Literal(
    "layer long, model string, credits double, label string",
    ((1, "alpha", 1.0, "env"), (1, "beta", None, "env"), (2, "alpha", 0.5, "user"), (2, "gamma", 2.0, None), (3, "beta", 0.25, "project"), (3, "gamma", None, "project"), (3, "delta", None, None)),
    more=derived.CATALOG,
)


@query(
    "src23_catalog_overlay",
    f"""SELECT model, arg_max(credits, layer) FILTER (WHERE credits IS NOT NULL) AS credits, arg_max(label, layer) FILTER (WHERE label IS NOT NULL) AS label, max(layer) AS layer FROM {CATALOG.sql()} c GROUP BY model""",
)
def src23(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("layer"))).alias(c)
    return CATALOG.df(spark, sf_dir).groupBy("model").agg(newest("credits"), newest("label"), F.max("layer").alias("layer"))


@query(
    "src25_positional_match",
    """WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p, role FROM conversations),
b AS (SELECT conv_id, turn, p, CASE WHEN conv_id % 5 = 0 AND p = 2 THEN 'changed' ELSE role END AS role FROM a WHERE NOT (conv_id % 7 = 0 AND p = 1)),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.role IS NOT NULL AND b.role IS NOT NULL AND a.role = b.role AS same FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.p = b.p)
SELECT conv_id, count(*) AS n_positions, bool_and(same) AS accepted FROM j GROUP BY conv_id""",
)
def src25(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    a = table(spark, sf_dir, "conversations").select("conv_id", p.alias("p"), "role")
    changed = F.when((F.col("conv_id") % 5 == 0) & (F.col("p") == 2), "changed").otherwise(F.col("role"))
    b = a.where(~((F.col("conv_id") % 7 == 0) & (F.col("p") == 1))).select("conv_id", "p", changed.alias("theirs"))
    return a.join(b, ["conv_id", "p"], "full").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_positions"), F.every(F.coalesce(F.col("role") == F.col("theirs"), F.lit(False))).alias("accepted"))
