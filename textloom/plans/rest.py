"""Queries over page regions, providers, memory and guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import article, graph, ledger, page_tree
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.plans.corpus import BOOK, ENTITIES, EVIDENCE
from textloom.plans.scalars import PAD
from textloom.sources import formats, html, tree

PATHS = Literal("page long, anchor long, path array<string>", ((1, 1, ["html", "body", "main", "article", "p1"]), (1, 2, ["html", "body", "main", "article", "div", "p2"]), (1, 3, ["html", "body", "main", "article", "div", "p3"]), (2, 1, ["html", "body", "div", "p"]), (2, 2, ["html", "body", "aside", "p"])), more=derived.PATHS)


@query(
    "htm07_common_ancestor",
    f"""WITH d AS (SELECT page, anchor, generate_subscripts(path, 1) AS depth, unnest(path) AS step, (SELECT count(*) FROM {PATHS.sql()} q WHERE q.page = p.page) AS n FROM {PATHS.sql()} p),
s AS (SELECT page, depth, any_value(step) AS step, count(DISTINCT step) = 1 AND count(*) = max(n) AS same FROM d GROUP BY page, depth), f AS (SELECT *, min(CASE WHEN same THEN NULL ELSE depth END) OVER (PARTITION BY page) AS stop FROM s)
SELECT page, string_agg(step, '/' ORDER BY depth) AS ancestor FROM f WHERE stop IS NULL OR depth < stop GROUP BY page""",
)
def htm07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common prefix of the anchors' paths: of the least and the greatest of them."""
    ends = PATHS.df(spark, sf_dir).groupBy("page").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, F.lit(False))
    return ends.select("page", F.array_join(F.when(stop == 0, F.col("a")).otherwise(F.slice("a", F.lit(1), (stop - 1).cast("int"))), "/").alias("ancestor"))


@query("htm08_selector_roots")
def htm08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first selector in order that matches, its longest node: article, main, role, then class names."""
    return selector_roots(html.nodes(table(spark, sf_dir, "pages")))


def selector_roots(n: DataFrame) -> DataFrame:
    low = F.lower("class")
    rank = F.when(low.rlike("article-(body|content)|post-content|entry-content"), 0).when(F.col("tag") == "article", 1).when(F.col("tag") == "main", 2).when(F.col("role") == "main", 3).when(low.rlike(article.GOOD), 4)
    ranked = n.withColumn("selector", rank).where(F.col("selector").isNotNull())
    return ledger.latest(ranked, ["page_id"], [F.col("selector"), F.col("text_len").desc(), F.col("node_id")]).select("page_id", "selector", "node_id", "tag", "text_len")


@query("htm11_provider_union")
def htm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per provider and page, the best by confidence first."""
    pages = table(spark, sf_dir, "pages")
    n = ledger.saved(html.nodes(pages))
    density = article.article_roots(n).select("page_id", "node_id", F.lit("density").alias("provider"))
    selector = selector_roots(n).select("page_id", "node_id", F.lit("selector").alias("provider"))
    body = n.where("tag = 'body'").groupBy("page_id").agg(F.min("node_id").alias("node_id")).withColumn("provider", F.lit("body"))
    risen = page_tree.readability_roots(ledger.saved(tree.tree(pages))).select("page_id", "node_id", F.lit("readability").alias("provider"))
    both = density.unionByName(selector).unionByName(body).unionByName(risen).join(n, ["page_id", "node_id"])
    c = F.col
    quality = article.quality_score({"text_len": c("text_len"), "readable": F.greatest(c("readable_len"), F.lit(1)), "link_len": c("link_len"), "noise_len": c("noise_len"), "h1": c("h1"), "h2": c("h2"), "paragraphs": c("paragraphs"), "named": F.lower("class").rlike("article-(body|content)|post-content|entry-content"), "prior": F.lit(0.0)})
    return both.select("page_id", "provider", "node_id", F.round(quality, 6).alias("confidence"), F.row_number().over(W.partitionBy("page_id").orderBy(quality.desc(), "provider")).alias("rank"))


REGIONS = Literal("page long, region long, n_chars long", ((1, 1, 900), (1, 2, 800), (2, 1, 3000), (2, 2, 200), (3, 1, 500), (3, 2, 500), (3, 3, 400)), more=derived.REGIONS)


@query("htm13_many_regions", f"SELECT page, count(*) >= 2 AND sum(n_chars) >= 1.3 * max(n_chars) AND sum(n_chars) >= 0.35 * 4000 AS many FROM {REGIONS.sql()} r GROUP BY page")
def htm13(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, total, most = F.count(F.lit(1)), F.sum("n_chars"), F.max("n_chars")
    return REGIONS.df(spark, sf_dir).groupBy("page").agg(((n >= 2) & (total >= 1.3 * most) & (total >= 0.35 * 4000)).alias("many"))


INLINE = Literal("page long, position long, parent string, is_inline boolean, text string", ((1, 1, "/a", True, "one"), (1, 2, "/a", True, "two"), (1, 3, "/a", False, "block"), (1, 4, "/a", True, "x"), (1, 5, "/b", True, "y"), (1, 6, "/b", True, "z" * 499), (2, 1, "/c", True, "alone")))


@query("htm19_merged_inline_blocks", "SELECT page, position, text FROM (VALUES (1, 1, 'one two'), (1, 3, 'block'), (1, 4, 'x'), (1, 5, 'y'), (1, 6, repeat('z', 499)), (2, 1, 'alone')) v(page, position, text)")
def htm19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring inline blocks of one parent joined by spaces, up to 500 characters."""
    import pandas as pd

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in frame.sort_values("position").itertuples():
            joins = out and r.is_inline and out[-1][3] and out[-1][4] == r.parent and len(out[-1][2]) + 1 + len(r.text) <= 500
            if joins:
                out[-1][2] += " " + r.text
            else:
                out.append([r.page, r.position, r.text, r.is_inline, r.parent])
        return pd.DataFrame([o[:3] for o in out], columns=["page", "position", "text"])

    return INLINE.df(spark, sf_dir).groupBy("page").applyInPandas(merged, "page long, position long, text string")


FOUND = Literal("page long, block string, path string", ((1, "b1", "/html/p[1]"), (1, "b2", "/html/p[2]"), (1, "b9", "/html/p[3]")), more=derived.FOUND)
LIVE = Literal("page long, dom_id string, path string, node long", ((1, "b1", "/html/p[7]", 11), (1, None, "/html/p[2]", 12), (1, None, "/html/p[3]", 13)), more=derived.LIVE)


@query("jon21_block_lookup", f"SELECT f.block, coalesce(a.node, b.node) AS node, a.node IS NOT NULL AS by_id FROM {FOUND.sql()} f LEFT JOIN {LIVE.sql()} a ON a.page = f.page AND a.dom_id = f.block LEFT JOIN {LIVE.sql()} b ON b.page = f.page AND b.path = f.path")
def jon21(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_id = LIVE.df(spark, sf_dir).where("dom_id IS NOT NULL").select("page", F.col("dom_id").alias("block"), F.col("node").alias("a"))
    by_path = LIVE.df(spark, sf_dir).select("page", "path", F.col("node").alias("b"))
    return FOUND.df(spark, sf_dir).join(by_id, ["page", "block"], "left").join(by_path, ["page", "path"], "left").select("block", F.coalesce("a", "b").alias("node"), F.col("a").isNotNull().alias("by_id"))


@query("set06_union_of_findings", "SELECT 'short' AS type, doc_id, CAST(n_chars AS VARCHAR) AS detail FROM documents WHERE n_chars < 60 UNION ALL SELECT 'toxic', doc_id, NULL FROM labels WHERE toxic = 1 UNION ALL SELECT 'digits', doc_id, regexp_extract(text, '[0-9]{6,}') FROM documents WHERE regexp_matches(text, '[0-9]{6,}')")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    short = d.where("n_chars < 60").select(F.lit("short").alias("type"), "doc_id", F.col("n_chars").cast("string").alias("detail"))
    digits = d.where(F.col("text").rlike("[0-9]{6,}")).select(F.lit("digits").alias("type"), "doc_id", F.regexp_extract("text", "[0-9]{6,}", 0).alias("detail"))
    return short.unionByName(labels.where("toxic = 1").select(F.lit("toxic").alias("type"), "doc_id"), allowMissingColumns=True).unionByName(digits)


@query("gra03_merged_memory", f"WITH u AS (SELECT node, target, 1 AS layer FROM {ENTITIES.sql()} e UNION ALL SELECT 'e' || i, 'later', 2 FROM range(6, 10) t(i)) SELECT node, arg_min(target, layer) FILTER (WHERE target IS NOT NULL) AS earlier_wins, arg_max(target, layer) AS later_wins FROM u GROUP BY node ORDER BY node LIMIT 8")
def gra03(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.range(6, 10).select(F.concat(F.lit("e"), "id").alias("node"), F.lit("later").alias("target"), F.lit(2).alias("layer"))
    u = ENTITIES.df(spark, sf_dir).select("node", "target", F.lit(1).alias("layer")).unionByName(new)
    first, last = F.min_by("target", F.when(F.col("target").isNotNull(), F.col("layer"))), F.max_by("target", F.when(F.col("target").isNotNull(), F.col("layer")))
    return u.groupBy("node").agg(first.alias("earlier_wins"), last.alias("later_wins")).orderBy("node").limit(8)


@query("gra11_reviewed_items", f"WITH e AS (SELECT fact, count(*) FILTER (WHERE item_id < 40) AS evidence FROM {EVIDENCE.sql()} v GROUP BY fact) SELECT fact, CASE WHEN evidence > 0 THEN 'confirmed' ELSE 'pending' END AS status FROM e")
def gra11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EVIDENCE.df(spark, sf_dir).groupBy("fact").agg(F.when(F.count_if(F.col("item_id") < 40) > 0, "confirmed").otherwise("pending").alias("status"))


@query("ext10_manual_edits", "SELECT o_custkey, o_orderkey, 'run' AS origin FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, max(o_orderkey) + 1000000, 'manual' FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def ext10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    manual = o.groupBy("o_custkey").agg((F.max("o_orderkey") + 1000000).alias("o_orderkey"), F.count(F.lit(1)).alias("n")).where("n > 12").select("o_custkey", "o_orderkey", F.lit("manual").alias("origin"))
    return o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.lit("run").alias("origin")).unionByName(manual)


@query("ext25_review_retry_groups", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS grp FROM (SELECT item_id AS doc_id FROM benchmark WHERE item_id % 3 = 1)")
def ext25(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = table(spark, sf_dir, "benchmark").where("item_id % 3 = 1").select(F.col("item_id").alias("doc_id"))
    return ledger.ranked(missing, [], ["doc_id"]).select("doc_id", F.floor((F.col("rank") - 1) / 4).alias("grp"))


@query("ext33_terms_of_site", "SELECT page_id, list_transform([1, 2], lambda i: 'term' || CAST(i AS VARCHAR)) || CASE WHEN page_id % 2 = 0 THEN ['site'] ELSE [] END AS terms FROM pages")
def ext33(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("site"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.array(F.lit("term1"), F.lit("term2")), own).alias("terms"))


MEMORY = Literal("doc long, raw string", ((1, '{"entities":[{"source":"Anna","target":"a","kind":"person","junk":1},{"source":"","target":"x"}],"notes":"n"}'), (2, "{}"), (3, "broken"), (4, '{"entities":[{"source":"B","target":null}]}')), more=derived.MEMORY)


@query("ext21_sanitized_memory", f"SELECT doc, left(json_extract_string(e, '$.source'), 64) AS source, json_extract_string(e, '$.target') AS target FROM (SELECT doc, unnest(CAST(json_extract(TRY_CAST(raw AS JSON), '$.entities') AS JSON[])) AS e FROM {MEMORY.sql()} m) WHERE json_extract_string(e, '$.source') <> ''")
def ext21(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MEMORY.df(spark, sf_dir).select("doc", F.inline(F.from_json("raw", "struct<entities:array<struct<source:string,target:string>>>")["entities"]))
    return m.where("source != ''").select("doc", F.substring("source", 1, 64).alias("source"), "target")


@query("ext24_grounded_profiles", f"SELECT e.node, lower(e.names[1]) AS name, count(b.segment) AS evidence FROM {ENTITIES.sql()} e LEFT JOIN {BOOK.sql()} b ON contains({PAD.format('b.text')}, {PAD.format('e.names[1]')}) GROUP BY 1, 2")
def ext24(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ENTITIES.df(spark, sf_dir).select("node", F.lower(F.get("names", F.lit(0))).alias("name"))
    hit = graph.mentions(BOOK.df(spark, sf_dir).select("text"), "text", e, "name").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return e.join(hit, "node", "left").select("node", "name", F.coalesce("n", F.lit(0)).alias("evidence"))


@query("src09_dispatch", "SELECT format, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'json' ELSE NULL END AS format FROM documents) GROUP BY format")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(F.lit("txt"), F.lit("markdown"), F.lit("json"), F.lit("bin")), (F.col("doc_id") % 4 + 1).cast("int"))
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("d."), ending).alias("name"))
    return named.groupBy(formats.detect_format(F.col("name"), F.lit(None).cast("string")).alias("format")).agg(F.count(F.lit(1)).alias("n"))
