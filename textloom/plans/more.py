"""Queries over sampling, configuration, deltas, guards and caches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import repair, text as T
from textloom.operators import book, graph, ledger, sampling
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.plans.corpus import BOOK, ENTITIES, NAME_ROWS, segments
from textloom.plans.scalars import PAD, strip_sql

JSONS = Literal(
    "row_id long, raw string",
    ((1, 'Sure: {"a":[1,2,{"b":"x"}]} done'), (2, '{"t":[{"id":"b1","v":"cut of'), (3, "[1,2,]"), (4, "none"), (5, '{"q":"say \\"hi\\" {"}'), (6, '{"deep":{"it\'s":["a",{"k":"v"}]},"n":3}')),
    more=derived.JSONS,
)

PLAIN = derived.PLAIN
#: What the rows of the driver's tables come to, computed from the text they were made of.
READ_BACK = (
    f" UNION ALL SELECT conv_id * 100 + turn + 1000, chr(123) || '\"t\":\"' || {PLAIN} || '\"' || chr(125) FROM conversations"
    f" UNION ALL SELECT conv_id * 100 + turn + 1000000, chr(123) || '\"t\":[\"' || {PLAIN} || '\"]' || chr(125) FROM conversations"
)


@query("scl23_repaired_json", "SELECT row_id, json FROM (VALUES (1, '{\"a\":[1,2,{\"b\":\"x\"}]}'), (2, '{\"t\":[{\"id\":\"b1\",\"v\":\"cut of\"}]}'), (3, '[1,2]'), (4, NULL), (5, '{\"q\":\"say \\\"hi\\\" {\"}'), (6, '{\"deep\":{\"it''s\":[\"a\",{\"k\":\"v\"}]},\"n\":3}')) v(row_id, json)" + READ_BACK)
def scl23(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def fixed(raw: pd.Series) -> pd.Series:
        return raw.map(repair.repaired)

    return JSONS.df(spark, sf_dir).select("row_id", fixed("raw").alias("json"))


@query("agg17_capped_features", f"WITH n AS (SELECT segment, name FROM {NAME_ROWS}) SELECT segment, name, (SELECT count(*) > 5000 FROM n) AS truncated FROM n ORDER BY segment, name LIMIT 5000")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(book.name_mentions(segments(spark, sf_dir)).select("segment", "name"), ["segment", "name"], 5000)


@query("top06_planned_sample")
def top06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    ch = book.chapters(s)
    anchors = ch.select(F.explode(F.array(F.struct(F.col("first").alias("segment"), F.lit(0).alias("r")), F.struct(F.col("middle").alias("segment"), F.lit(1).alias("r")))).alias("x")).select("x.segment", F.lit("chapter").alias("phase"), F.col("x.segment").alias("rank"))
    phrases = book.repeated_passages(s, 12)
    said = phrases.select(F.explode(F.array("first", "last")).alias("segment"), F.lit("passage").alias("phase"), (-F.col("n")).alias("rank"))
    spread = s.select("segment", F.lit("uniform").alias("phase"), F.pmod(F.xxhash64("segment"), F.lit(1000003)).alias("rank"))
    return sampling.planned_sample(anchors.unionByName(said).unionByName(spread), "segment", {"chapter": 34, "passage": 48, "uniform": 72})


@query("top08_stable_sides")
def top08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable_sides(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("top10_diverse_examples")
def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws("/", F.lpad(F.col("turn").cast("string"), 6, "0"), "role").alias("place"), F.array_distinct(F.split(F.lower("text"), " ")).alias("words"))
    return sampling.diverse(rows, "conv_id", "place", "words", 6).select("conv_id", "place")


PAYLOADS = Literal(
    "event_id long, payload string",
    ((1, '{"batchIndex":2,"duplicateCount":2,"duplicateSegmentIds":["s1","s2"],"unexpectedCount":0,"malformedRowCount":1}'), (2, '{"duplicateCount":0,"unexpectedCount":3,"malformedRowCount":0}'), (3, "broken"), (4, '{"batchIndex":5}')),
    more=derived.PAYLOADS,
)


@query(
    "gen07_output_findings",
    f"""WITH p AS (SELECT event_id, TRY_CAST(payload AS JSON) AS j FROM {PAYLOADS.sql()} e), f AS (SELECT event_id, CAST(json_extract(j, '$.batchIndex') AS BIGINT) AS batch, unnest(['duplicate', 'unexpected', 'malformed']) AS type, unnest([CAST(json_extract(j, '$.duplicateCount') AS BIGINT), CAST(json_extract(j, '$.unexpectedCount') AS BIGINT), CAST(json_extract(j, '$.malformedRowCount') AS BIGINT)]) AS n FROM p) SELECT * FROM f WHERE n > 0""",
)
def gen07(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda k: F.get_json_object("payload", f"$.{k}").try_cast("long")
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), get(k).alias("n")) for t, k in (("duplicate", "duplicateCount"), ("unexpected", "unexpectedCount"), ("malformed", "malformedRowCount"))])
    return PAYLOADS.df(spark, sf_dir).select("event_id", get("batchIndex").alias("batch"), F.inline(kinds)).where("n > 0")


USAGES = Literal("turn_id long, raw string", ((1, '{"input":10.4,"output":5,"cost":0.1}'), (2, '{"input":0,"output":0}'), (3, "bad"), (4, '{"input":-3,"output":2.5}')), more=derived.USAGES)


@query("ext14_turn_usage", f"WITH u AS (SELECT turn_id, greatest(0, CAST(floor(coalesce(TRY_CAST(json_extract_string(TRY_CAST(raw AS JSON), '$.input') AS DOUBLE), 0) + 0.5) AS BIGINT)) AS input, greatest(0, CAST(floor(coalesce(TRY_CAST(json_extract_string(TRY_CAST(raw AS JSON), '$.output') AS DOUBLE), 0) + 0.5) AS BIGINT)) AS output FROM {USAGES.sql()} s) SELECT turn_id, CASE WHEN input + output > 0 THEN input END AS input, CASE WHEN input + output > 0 THEN output END AS output FROM u")
def ext14(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda k: F.greatest(F.lit(0), F.floor(F.coalesce(F.get_json_object("raw", f"$.{k}").try_cast("double"), F.lit(0.0)) + 0.5)).cast("long")
    u = USAGES.df(spark, sf_dir).select("turn_id", whole("input").alias("i"), whole("output").alias("o"))
    some = F.col("i") + F.col("o") > 0
    return u.select("turn_id", F.when(some, F.col("i")).alias("input"), F.when(some, F.col("o")).alias("output"))


SETTINGS = Literal("name string, segs string, chars string", (("a", "12.6", "8000"), ("b", None, "100"), ("c", "x", "999999"), ("d", "0", "-5")), more=derived.SETTINGS)


@query("ext15_strategy_limits", f"SELECT name, CAST(greatest(1, least(64, floor(coalesce(TRY_CAST(segs AS DOUBLE), 16) + 0.5))) AS BIGINT) AS segs, CAST(greatest(500, least(20000, floor(coalesce(TRY_CAST(chars AS DOUBLE), 8000) + 0.5))) AS BIGINT) AS chars FROM {SETTINGS.sql()} s")
def ext15(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamp = lambda c, low, high, default: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.coalesce(F.col(c).try_cast("double"), F.lit(float(default))) + 0.5))).cast("long")
    return SETTINGS.df(spark, sf_dir).select("name", clamp("segs", 1, 64, 16).alias("segs"), clamp("chars", 500, 20000, 8000).alias("chars"))


CONFIGS = Literal("file string, raw string", (("a", '[{"id":"m1","credits":"x0.5 credits"},{"id":"m2"}]'), ("b", "[]"), ("c", '[{"id":"m3","credits":"free"}]')), more=derived.CONFIGS)


@query("ext16_models_of_config", f"SELECT file, json_extract_string(m, '$.id') AS id, json_extract_string(m, '$.credits') AS credits FROM (SELECT file, unnest(CAST(raw AS JSON[])) AS m FROM {CONFIGS.sql()} c)")
def ext16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CONFIGS.df(spark, sf_dir).select("file", F.inline(F.from_json("raw", "array<struct<id:string,credits:string>>")))


WINDOWS = Literal("model string, sizes array<long>, default_size long", (("a", [8000, 200000, 8000, 64000], 64000), ("b", [1000], 1000), ("c", [0, 5, 10], 5), ("d", [4000, 8000], 1)), more=derived.WINDOWS)


@query("ext17_context_windows", f"SELECT model, array_to_string(list_sort(list_distinct(sizes)), ',') AS sizes, list_min(sizes) > 0 AND len(list_distinct(sizes)) >= 2 AND list_contains(sizes, default_size) AS valid FROM {WINDOWS.sql()} w")
def ext17(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = F.array_sort(F.array_distinct("sizes"))
    valid = F.forall("sizes", lambda x: x > 0) & (F.size(distinct) >= 2) & F.array_contains("sizes", F.col("default_size"))
    return WINDOWS.df(spark, sf_dir).select("model", F.array_join(F.transform(distinct, lambda x: x.cast("string")), ",").alias("sizes"), valid.alias("valid"))


GATES = Literal("graph string, status string, revision long, version string, source string, target string", (("g1", "completed", 3, "v2", "en", "zh"), ("g2", "running", 3, "v2", "en", "zh"), ("g3", "completed", 2, "v2", "en", "zh"), ("g4", "completed", 3, "v2", "ja", "zh")), more=derived.GATES)


@query("flt21_graph_ready", f"SELECT graph, status = 'completed' AND revision = 3 AND version = 'v2' AND source = 'en' AND target = 'zh' AS ready FROM {GATES.sql()} g")
def flt21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return GATES.df(spark, sf_dir).select("graph", ((c("status") == "completed") & (c("revision") == 3) & (c("version") == "v2") & (c("source") == "en") & (c("target") == "zh")).alias("ready"))


@query("ext19_chapter_map", "SELECT source AS chapter, row_number() OVER (ORDER BY min(doc_id)) AS position, min(doc_id) AS first, array_to_string(list_sort(list(doc_id))[1:16], ',') AS ids FROM documents GROUP BY source")
def ext19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    few = book.smallest(s.select("chapter", "segment"), ["chapter"], "segment", 16)
    by = few.groupBy("chapter").agg(F.min("segment").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("segment")), lambda x: x.cast("string")), ",").alias("ids"))
    return by.select("chapter", F.row_number().over(W.orderBy("first")).alias("position"), "first", "ids")  # a row per chapter


@query("ext20_index_is_current", "SELECT source, count(*) AS segments, count(*) FILTER (WHERE n_chars > 50) AS indexed, count(*) = count(*) FILTER (WHERE n_chars > 50) AS is_current FROM documents GROUP BY source")
def ext20(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(F.col("n_chars") > 50)
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("segments"), k.alias("indexed"), (n == k).alias("is_current"))


@query("ext11_cache_reads", "WITH k AS (SELECT user_id, max(ts) AS ts, count(*) AS hits, arg_max(props, event_id) AS props FROM events GROUP BY 1) SELECT user_id, hits + 1 AS hits FROM k WHERE ts >= (SELECT max(ts) - INTERVAL 12 HOUR FROM events) AND json_type(props) = 'OBJECT'")
def ext11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 12 HOURS")).alias("since"))
    k = e.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("hits"), F.max_by("props", "event_id").alias("props"))
    live = k.join(F.broadcast(now), F.col("ts") >= F.col("since"))  # a single row
    return live.where(F.expr("schema_of_variant(try_parse_json(props)) LIKE 'OBJECT%'")).select("user_id", (F.col("hits") + 1).alias("hits"))


@query("ext12_valid_segments", f"SELECT doc_id, left(source, 200) AS source, {strip_sql('text')} <> '' AND length(text) <= 100000 AS valid, count(*) OVER (PARTITION BY doc_id) > 1 AS repeated FROM documents")
def ext12(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = (T.strip(F.col("text")) != "") & (F.char_length("text") <= 100000)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring("source", 1, 200).alias("source"), valid.alias("valid"))
    return rows.withColumn("repeated", F.count(F.lit(1)).over(W.partitionBy("doc_id")) > 1)


@query("ext37_store_stats", "SELECT event_type AS prefix, count(*) AS entries, sum(length(props)) AS size FROM events GROUP BY event_type")
def ext37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("prefix")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.char_length("props")).alias("size"))


@query("ext39_latest_report", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def ext39(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("ext04_target_language", "SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 'run-' || o_orderpriority END), arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 'zh') AS language FROM orders GROUP BY o_custkey")
def ext04(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.max(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("run-"), "o_orderpriority")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(run, F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")), F.lit("zh")).alias("language"))


@query("ext06_graph_fingerprint", f"SELECT sha256(string_agg(node || ':' || coalesce(target, '') || ':' || status, '|' ORDER BY node)) AS fingerprint FROM {ENTITIES.sql()} e")
def ext06(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("node", F.concat_ws(":", "node", F.coalesce("target", F.lit("")), "status").alias("r"))
    return ENTITIES.df(spark, sf_dir).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]), "|"), 256).alias("fingerprint"))


@query("ext07_revision_guard", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 409 ELSE 200 END AS status, count(*) + 1 AS next_revision FROM orders GROUP BY o_custkey")
def ext07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, 409).otherwise(200).alias("status"), (F.count(F.lit(1)) + 1).alias("next_revision"))


@query("ext08_snapshot_upserts", "SELECT l_orderkey, l_linenumber, max(l_shipdate) AS at, count(*) AS writes FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1, 2")
def ext08(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(live, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at"), F.count(F.lit(1)).alias("writes"))


GLOSSARY = Literal("entry long, term string, source string, target string, state string", ((1, "Anna", None, "安娜二", None), (2, None, "Zed", "泽德", None), (3, "Rust", None, "铁锈", "rejected"), (4, "karenina ", None, "卡列尼娜", None)), more=derived.GLOSSARY)


@query("ext02_memory_with_glossary", f"WITH m AS (SELECT lower(trim(unnest(names))) AS k FROM {ENTITIES.sql()} e), g AS (SELECT entry, trim(coalesce(term, source)) AS name, target FROM {GLOSSARY.sql()} g WHERE coalesce(state, '') NOT IN ('candidate', 'suggested', 'rejected')) SELECT name, target FROM g WHERE lower(name) NOT IN (SELECT k FROM m)")
def ext02(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ENTITIES.df(spark, sf_dir).select(F.explode("names").alias("n")).select(F.lower(F.btrim("n")).alias("k"))
    g = GLOSSARY.df(spark, sf_dir).where(~F.coalesce("state", F.lit("")).isin("candidate", "suggested", "rejected")).select(F.btrim(F.coalesce("term", "source")).alias("name"), "target")
    return g.withColumn("k", F.lower("name")).join(m, "k", "left_anti").drop("k")


@query("ext03_strong_mappings", f"WITH t AS (SELECT lower(unnest(names)) AS name, target, status FROM {ENTITIES.sql()} e WHERE target IS NOT NULL), s AS (SELECT name, count(DISTINCT target) FILTER (WHERE status = 'confirmed') AS strong, min(target) FILTER (WHERE status = 'confirmed') AS only_target FROM t GROUP BY name) SELECT DISTINCT t.name, t.target FROM t JOIN s USING (name) WHERE strong <= 1 AND (t.status = 'confirmed' OR only_target IS NULL OR t.target = only_target)")
def ext03(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ENTITIES.df(spark, sf_dir).where("target IS NOT NULL").select(F.explode("names").alias("name"), "target", "status").withColumn("name", F.lower("name"))
    confirmed = F.when(F.col("status") == "confirmed", F.col("target"))
    w = t.withColumn("strong", F.collect_set(confirmed).over(W.partitionBy("name")))
    return w.where((F.size("strong") <= 1) & ((F.col("status") == "confirmed") | (F.size("strong") == 0) | F.array_contains("strong", F.col("target")))).select("name", "target").distinct()


DELTAS = Literal(
    "batch long, first_ordinal long, name string, target string, segments array<string>",
    ((1, 1, "Anna", "安娜", ["s1"]), (2, 4, "anna", "安妮", ["s4", "s5"]), (2, 4, "Bob", "鲍勃", ["s4"]), (3, 7, "Bob", "鲍勃", ["s8", "s8"])),
    more=derived.DELTAS,
)


@query("gra07_merged_deltas", f"WITH d AS (SELECT lower(name) AS name, target, first_ordinal, unnest(segments) AS seg FROM {DELTAS.sql()} d) SELECT name, arg_min(target, first_ordinal) AS target, count(DISTINCT seg) >= 2 AS corroborated, count(DISTINCT target) > 1 AS conflict FROM d GROUP BY name")
def gra07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DELTAS.df(spark, sf_dir).select(F.lower("name").alias("name"), "target", "first_ordinal", F.explode("segments").alias("seg"))
    return d.groupBy("name").agg(F.min_by("target", F.struct("first_ordinal", "target")).alias("target"), (F.count_distinct("seg") >= 2).alias("corroborated"), (F.count_distinct("target") > 1).alias("conflict"))


#: The literal segments alone: a batch's quotes are looked for in the one small text of its own samples.
FEW = Literal(BOOK.schema, BOOK.rows)
RAW_DELTAS = Literal(
    "batch long, raw string",
    ((1, '{"entities":[{"id":"e1","source":"Anna","quote":"Anna met"},{"id":"e2","source":"","quote":"x"}],"mentions":[{"segment":"s1","quote":"King Rat"}]}'), (2, '{"entities":[{"id":"e3","source":"Bob","quote":"not in text"}],"mentions":[{"segment":"s99","quote":"zzz"}]}')),
)


@query(
    "gra06_delta_validation",
    f"""WITH b AS (SELECT lower(string_agg(text, ' ' ORDER BY ordinal)) AS whole FROM {FEW.sql()} k), e AS (SELECT batch, unnest(CAST(json_extract(raw, '$.entities') AS JSON[])) AS j FROM {RAW_DELTAS.sql()} r), m AS (SELECT batch, unnest(CAST(json_extract(raw, '$.mentions') AS JSON[])) AS j FROM {RAW_DELTAS.sql()} r)
SELECT 'entity' AS kind, batch, count(*) FILTER (WHERE json_extract_string(j, '$.source') <> '' AND contains((SELECT whole FROM b), lower(json_extract_string(j, '$.quote')))) AS accepted, count(*) AS n FROM e GROUP BY batch UNION ALL
SELECT 'mention', batch, count(*) FILTER (WHERE json_extract_string(j, '$.segment') IN (SELECT segment FROM {FEW.sql()} k)), count(*) FROM m GROUP BY batch""",
)
def gra06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = RAW_DELTAS.df(spark, sf_dir).withColumn("d", F.from_json("raw", "struct<entities:array<struct<id:string,source:string,quote:string>>,mentions:array<struct<segment:string,quote:string>>>"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    whole = FEW.df(spark, sf_dir).agg(F.lower(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("whole"))
    e = d.select("batch", F.inline("d.entities")).join(F.broadcast(whole))  # one small text
    ok = (F.col("source") != "") & F.col("whole").contains(F.lower("quote"))
    ents = e.groupBy("batch").agg(F.count_if(ok).alias("accepted"), F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "batch", "accepted", "n")
    known = FEW.df(spark, sf_dir).select("segment", F.lit(True).alias("known"))
    m = d.select("batch", F.inline("d.mentions")).join(known, "segment", "left")
    ments = m.groupBy("batch").agg(F.count_if(F.coalesce("known", F.lit(False))).alias("accepted"), F.count(F.lit(1)).alias("n")).select(F.lit("mention").alias("kind"), "batch", "accepted", "n")
    return ents.unionByName(ments)


@query("gra02_merged_records", f"WITH n AS (SELECT node, lower(unnest(names)) AS name, target, status FROM {ENTITIES.sql()} e) SELECT name, count(DISTINCT node) AS nodes, arg_min(target, node) FILTER (WHERE target IS NOT NULL) AS target, bool_or(status = 'confirmed') AS confirmed FROM n GROUP BY name")
def gra02(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ENTITIES.df(spark, sf_dir).select("node", F.explode("names").alias("name"), "target", "status").withColumn("name", F.lower("name"))
    first = F.min_by("target", F.when(F.col("target").isNotNull(), F.col("node")))
    return n.groupBy("name").agg(F.count_distinct("node").alias("nodes"), first.alias("target"), F.some(F.col("status") == "confirmed").alias("confirmed"))


@query("gra08_batch_context", "WITH b AS (SELECT i AS batch, max(l_orderkey) * i // 4 AS boundary FROM lineitem, (VALUES (1), (2), (3)) v(i) GROUP BY i) SELECT batch, l_partkey, count(*) AS n FROM lineitem JOIN b ON l_orderkey < boundary GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY count(*) DESC, l_partkey) <= 8")
def gra08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of most evidence before each of three batches, which begin at the quarters of the orders."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    top = F.broadcast(rows.agg(F.max("l_orderkey").alias("top")))  # a single row
    quarters = F.filter(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda i: F.col("l_orderkey") < F.floor(F.col("top") * i / 4))
    f = rows.join(top).select("l_partkey", F.explode(quarters).alias("batch")).groupBy("batch", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    # the best of each hashed part first, then the best of those
    part = W.partitionBy("batch", F.pmod(F.xxhash64("l_partkey"), F.lit(32))).orderBy(F.col("n").desc(), "l_partkey")
    few = f.withColumn("r", F.row_number().over(part)).where("r <= 8")
    return few.withColumn("r", F.row_number().over(W.partitionBy("batch").orderBy(F.col("n").desc(), "l_partkey"))).where("r <= 8").select("batch", "l_partkey", "n")


@query("gra14_recent_or_matching", f"WITH e AS (SELECT node, names[1] AS name FROM {ENTITIES.sql()} e) SELECT b.segment, string_agg(e.name, ',' ORDER BY e.node) AS context FROM {BOOK.sql()} b JOIN e ON contains({PAD.format('b.text')}, {PAD.format('e.name')}) GROUP BY b.segment")
def gra14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ENTITIES.df(spark, sf_dir).select("node", F.get("names", F.lit(0)).alias("name"))
    hit = graph.mentions(BOOK.df(spark, sf_dir).select("segment", "text"), "text", e, "name")
    return hit.groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "name"))), lambda x: x["name"]), ",").alias("context"))


@query("jon20_glossary_for_batch", f"WITH o AS (SELECT lower(n.name) AS name, n.node, min(b.ordinal) AS first FROM (SELECT node, unnest(names) AS name FROM {ENTITIES.sql()} e) n LEFT JOIN {BOOK.sql()} b ON contains({PAD.format('b.text')}, {PAD.format('n.name')}) GROUP BY 1, 2) SELECT node, bool_and(first IS NULL OR first <= 3) AND bool_or(first IS NOT NULL) AS usable FROM o GROUP BY node")
def jon20(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ENTITIES.df(spark, sf_dir).select("node", F.explode("names").alias("name"))
    seen = graph.mentions(BOOK.df(spark, sf_dir).select("ordinal", "text"), "text", n, "name").groupBy("node", "name").agg(F.min("ordinal").alias("first"))
    o = n.join(seen, ["node", "name"], "left")
    return o.groupBy("node").agg((F.every(F.col("first").isNull() | (F.col("first") <= 3)) & F.some(F.col("first").isNotNull())).alias("usable"))


ASKED = Literal("check_id string, kind string, segment string, expected string", (("t1", "term", "s1", "鼠王"), ("t2", "term", "s2", "安娜"), ("n1", "number", "s4", "5"), ("r1", "required", "s5", None), ("f1", "forbidden", "s6", "story")), more=derived.ASKED)


@query("jon22_evaluator_checks", f"SELECT a.check_id, a.kind, CASE a.kind WHEN 'required' THEN coalesce(trim(b.translation), '') <> '' WHEN 'forbidden' THEN NOT contains(coalesce(b.translation, ''), a.expected) ELSE contains(coalesce(b.translation, ''), a.expected) END AS passed FROM {ASKED.sql()} a LEFT JOIN {BOOK.sql()} b USING (segment)")
def jon22(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("translation", F.lit(""))
    passed = F.when(F.col("kind") == "required", F.btrim(t) != "").when(F.col("kind") == "forbidden", ~t.contains(F.col("expected"))).otherwise(t.contains(F.col("expected")))
    return ASKED.df(spark, sf_dir).join(BOOK.df(spark, sf_dir), "segment", "left").select("check_id", "kind", passed.alias("passed"))


MENTIONS = Literal("segment string, entity string, surface string", (("s1", "anna", "安娜"), ("s2", "anna", "安妮"), ("s3", "bob", "鲍勃"), ("s9", "bob", "鲍勃")), more=derived.MENTIONS)


@query("aud07_mention_drift", f"SELECT entity, count(DISTINCT segment) AS segments, count(DISTINCT surface) AS surfaces FROM {MENTIONS.sql()} m GROUP BY entity HAVING count(DISTINCT surface) > 1 AND count(DISTINCT segment) > 1")
def aud07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MENTIONS.df(spark, sf_dir).groupBy("entity").agg(F.count_distinct("segment").alias("segments"), F.count_distinct("surface").alias("surfaces")).where("surfaces > 1 AND segments > 1")


FINDINGS = Literal("finding string, repairable boolean, segments array<string>, chosen boolean", (("f1", True, ["s1", "s2"], True), ("f2", False, ["s3"], True), ("f3", True, ["s2", "s77"], True), ("f4", True, ["s4"], False)), more=derived.FINDINGS)


@query("aud08_repair_scope", f"SELECT DISTINCT s AS segment FROM (SELECT unnest(segments) AS s FROM {FINDINGS.sql()} f WHERE chosen AND repairable) WHERE s IN (SELECT segment FROM {BOOK.sql()} b)")
def aud08(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = FINDINGS.df(spark, sf_dir).where("chosen AND repairable").select(F.explode("segments").alias("segment")).distinct()
    return ids.join(BOOK.df(spark, sf_dir), "segment", "left_semi")


@query("sta06_disposition", "SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'kept' WHEN l.toxic = 1 THEN 'rejected' WHEN d.n_chars > 3000 THEN 'stale' ELSE 'pending' END AS disposition FROM labels l JOIN documents d USING (doc_id)")
def sta06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("quality") == 1, "kept").when(F.col("toxic") == 1, "rejected").when(F.col("n_chars") > 3000, "stale").otherwise("pending")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", d.alias("disposition"))


@query("sta08_memory_downgrade", f"SELECT e.node, CASE WHEN e.status = 'confirmed' AND count(b.segment) = 0 THEN 'candidate' ELSE e.status END AS status FROM {ENTITIES.sql()} e LEFT JOIN {BOOK.sql()} b ON contains({PAD.format('b.text')}, {PAD.format('e.names[1]')}) GROUP BY e.node, e.status")
def sta08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ENTITIES.df(spark, sf_dir).select("node", "status", F.get("names", F.lit(0)).alias("name"))
    hit = graph.mentions(BOOK.df(spark, sf_dir).select("text"), "text", e.select("node", "name"), "name").select("node").distinct().withColumn("hit", F.lit(True))
    status = F.when((F.col("status") == "confirmed") & F.col("hit").isNull(), "candidate").otherwise(F.col("status"))
    return e.join(hit, "node", "left").select("node", status.alias("status"))


@query("sta09_cache_aware_run", "SELECT doc_id, CASE WHEN first < doc_id THEN 'cache' ELSE 'provider' END AS origin, CASE WHEN first < doc_id THEN first END AS first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)")
def sta09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    # a text is sent once, by the first document that holds it; the others read it from the cache
    cache = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    held = F.col("first") < F.col("doc_id")
    return d.join(cache, "k").select("doc_id", F.when(held, "cache").otherwise("provider").alias("origin"), F.when(held, F.col("first")).alias("first"))


@query("sta10_retry_pass", "WITH a AS (SELECT doc_id, doc_id % 7 <> 0 AS ok FROM documents), b AS (SELECT doc_id, doc_id % 14 <> 0 AS ok FROM a WHERE NOT ok) SELECT a.doc_id, CASE WHEN a.ok THEN 1 WHEN b.ok THEN 2 END AS pass FROM a LEFT JOIN b USING (doc_id)")
def sta10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7 != 0).alias("ok"))
    second = a.where("NOT ok").select("doc_id", (F.col("doc_id") % 14 != 0).alias("again"))
    return a.join(second, "doc_id", "left").select("doc_id", F.when(F.col("ok"), 1).when(F.col("again"), 2).alias("pass"))


@query("ext23_voice_participants", "SELECT conv_id, role, max(CASE WHEN turn = 0 THEN 3 WHEN length(text) > 200 THEN 2 ELSE 1 END) AS score, count(*) AS turns FROM conversations GROUP BY 1, 2")
def ext23(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("turn") == 0, 3).when(F.char_length("text") > 200, 2).otherwise(1)
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max(score).alias("score"), F.count(F.lit(1)).alias("turns"))


@query("ext32_client_labels", "SELECT user_id, coalesce(CASE WHEN user_id % 3 = 0 THEN 'custom' END, event_type) || ' / ' || CAST(count(*) AS VARCHAR) AS label FROM events GROUP BY user_id, event_type")
def ext32(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.concat_ws(" / ", F.coalesce(F.when(F.col("user_id") % 3 == 0, "custom"), F.col("event_type")), F.col("n").cast("string")).alias("label"))


@query("snk07_revision_rows", "SELECT source AS revision, doc_id AS segment, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, sha256(text) AS source_hash FROM documents")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("source_hash"))
    return ledger.ranked(d, ["source"], ["doc_id"]).select(F.col("source").alias("revision"), F.col("doc_id").alias("segment"), (F.col("rank") - 1).alias("ordinal"), "source_hash")


@query("scl19_decoded_entities", "SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS title FROM pages")
def scl19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("title"))


SPACED = Literal("row_id long, text string", ((1, "H E L L O world"), (2, "a b c"), (3, "T 1 0 0 units")), more=derived.SPACED)


@query("htm20_collapsed_spacing", "SELECT row_id, text FROM (VALUES (1, 'HELLO world'), (2, 'a b c'), (3, 'T100 units')) v(row_id, text) UNION ALL SELECT p_partkey + 100, 'ABCD ' || p_name FROM part")
def htm20(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = re.compile(r"(?<!\w)(?:[A-Za-z0-9]\s+){3,}[A-Za-z0-9](?!\w)")

    @F.pandas_udf("string")
    def collapsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spaced.sub(lambda m: "".join(m[0].split()), t))

    return SPACED.df(spark, sf_dir).select("row_id", collapsed("text").alias("text"))
