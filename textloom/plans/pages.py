"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators import article
from textloom.plans import derived
from textloom.plans.base import Literal, query, table
from textloom.sources import html

N = Literal(
    "node long, text_len long, readable long, links long, link_len long, tag string, role string, class string, children long, depth long, body_len long, sibling_max long, sibling_sum long, siblings long",
    (
        (1, 5000, 4800, 10, 300, "article", "", "post-content", 30, 4, 6000, 5000, 5600, 3), (2, 800, 800, 60, 780, "div", "", "nav menu", 60, 4, 6000, 5000, 5600, 3), (3, 40, 40, 0, 0, "div", "", "", 1, 5, 6000, 40, 80, 2),
        (4, 1500, 600, 3, 50, "section", "", "", 25, 8, 6000, 1500, 6000, 4), (5, 5900, 5500, 70, 1100, "body", "", "", 4, 1, 6000, 5900, 5900, 1), (6, 2000, 1900, 4, 90, "div", "main", "author-box", 8, 2, 6000, 2100, 8000, 4),
    ),
    more=derived.N,
)
SCORE_SQL = """CASE WHEN text_len < 50 THEN 0.0 ELSE (readable - link_len) / (links + 1) * ln(readable + 1)
* CASE WHEN readable / text_len > 0.7 THEN 1.1 WHEN readable / text_len < 0.4 THEN 0.7 ELSE 1.0 END
* CASE WHEN tag = 'article' OR role = 'article' THEN 1.3 WHEN tag = 'main' OR role = 'main' THEN 1.2 WHEN tag = 'section' THEN 1.02 ELSE 1.0 END
* CASE WHEN regexp_matches(lower(class), '{good}') THEN 1.2 ELSE 1.0 END * CASE WHEN regexp_matches(lower(class), '{bad}') THEN 0.5 ELSE 1.0 END * CASE WHEN regexp_matches(lower(class), '{meta}') THEN 0.92 ELSE 1.0 END
/ (1 + 2.0 * link_len / greatest(readable, 1)) * CASE WHEN children > 20 AND readable / greatest(children, 1) < 25 THEN 0.85 ELSE 1.0 END
* CASE WHEN sibling_max > 0 AND readable < sibling_max * 0.7 THEN 0.85 ELSE 1.0 END * CASE WHEN siblings > 3 AND abs(readable - sibling_sum / siblings) / (sibling_sum / siblings) < 0.25 THEN 0.9 ELSE 1.0 END
* CASE WHEN depth < 3 THEN 0.95 ELSE 1.0 END * CASE WHEN depth > 7 THEN 0.9 ELSE 1.0 END
* CASE WHEN tag = 'body' THEN 1.0 WHEN readable / body_len >= 0.4 THEN 1.3 WHEN readable / body_len >= 0.25 THEN 1.15 WHEN readable / body_len < 0.05 THEN greatest(0.1, readable / body_len / 0.05) ELSE 1.0 END END""".format(good=article.GOOD, bad=article.BAD, meta=article.META)


@query("htm03_density_scores", f"SELECT node, round({SCORE_SQL}, 6) AS score FROM {N.sql()} n")
def htm03(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {k: F.col(k) for k, _ in N.columns()}
    return N.df(spark, sf_dir).select("node", F.round(article.density_score(n), 6).alias("score"))


@query("htm04_best_root", f"SELECT node, tag, score FROM (SELECT node, tag, round({SCORE_SQL}, 6) AS score FROM {N.sql()} n) WHERE score >= 300 ORDER BY score DESC, node LIMIT 1")
def htm04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = {k: F.col(k) for k, _ in N.columns()}
    return N.df(spark, sf_dir).select("node", "tag", F.round(article.density_score(n), 6).alias("score")).where("score >= 300").orderBy(F.col("score").desc(), "node").limit(1)


@query("htm05_fragmented_root", f"SELECT tag IN ('section', 'div') AND siblings >= 3 AND text_len / sibling_sum < 0.3 AS fragmented, node FROM {N.sql()} n")
def htm05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.df(spark, sf_dir).select((F.col("tag").isin("section", "div") & (F.col("siblings") >= 3) & (F.col("text_len") / F.col("sibling_sum") < 0.3)).alias("fragmented"), "node")


C = Literal(
    "page long, provider string, text_len long, readable long, link_len long, noise_len long, h1 long, h2 long, paragraphs long, named boolean, prior double, mapping double, coverage double",
    (
        (1, "selector", 4000, 3900, 200, 100, 1, 3, 12, True, 0.0, None, None), (1, "density", 5000, 3500, 900, 1200, 1, 3, 14, False, 2200.0, None, None), (1, "readability", 3900, 3850, 150, 60, 0, 3, 12, False, 0.0, 0.95, 0.9),
        (2, "density", 700, 300, 400, 300, 2, 0, 1, False, 350.0, None, None), (2, "readability", 600, 580, 20, 0, 1, 0, 4, False, 0.0, 0.5, 0.4), (3, "selector", 30, 30, 0, 0, 0, 0, 1, True, 0.0, None, None),
    ),
    more=derived.C,
)
QUALITY_SQL = """CASE WHEN text_len < 50 THEN 0.0 ELSE greatest(0.0, least(1.0, (least(0.4, log10(readable / 100) / 5) + greatest(0.0, least(0.35, CASE WHEN h1 = 1 THEN 0.15 WHEN h1 > 1 THEN -0.05 ELSE 0 END + CASE WHEN h2 >= 2 THEN 0.1 ELSE 0 END + CASE WHEN paragraphs >= 3 THEN 0.1 ELSE 0 END + CASE WHEN named THEN 0.08 ELSE 0 END)) + least(0.05, prior / 10000))
* CASE WHEN readable / text_len > 0.7 THEN 1.08 WHEN readable / text_len > 0.4 THEN 1.02 ELSE 1.0 END * CASE WHEN link_len / text_len < 0.3 THEN 1.04 ELSE 1.0 END * CASE WHEN noise_len / text_len < 0.2 THEN 1.04 ELSE 1.0 END * greatest(0.4, 1 - noise_len / text_len * 1.2))) END"""
BONUS_SQL = f"least(1.0, {QUALITY_SQL} + CASE WHEN provider <> 'readability' OR {QUALITY_SQL} <= 0.3 THEN 0 WHEN mapping >= 0.95 AND coverage >= 0.7 THEN 0.2 WHEN mapping >= 0.8 THEN 0.15 WHEN mapping >= 0.6 THEN 0.08 ELSE 0 END)"


def confidence():
    n = {k: F.col(k) for k, _ in C.columns()}
    base = article.quality_score(n)
    m, v = F.col("mapping"), F.col("coverage")
    bonus = F.when((F.col("provider") != "readability") | (base <= 0.3), 0.0).when((m >= 0.95) & (v >= 0.7), 0.2).when(m >= 0.8, 0.15).when(m >= 0.6, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), base + bonus)


@query("htm09_candidate_quality", f"SELECT page, provider, round({BONUS_SQL}, 6) AS confidence FROM {C.sql()} c")
def htm09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.df(spark, sf_dir).select("page", "provider", F.round(confidence(), 6).alias("confidence"))


@query(
    "htm10_ranked_candidates",
    f"""WITH s AS (SELECT page, provider, round({BONUS_SQL}, 6) AS c, mapping >= 0.85 AND coverage >= 0.8 AND text_len >= 500 AS dominant FROM {C.sql()} c), t AS (SELECT *, max(c) OVER (PARTITION BY page) AS top FROM s)
SELECT page, provider, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN provider = 'readability' AND dominant AND top - c <= 0.15 THEN 0 ELSE 1 END, c DESC, provider) AS rank FROM t""",
)
def htm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    dominant = (F.col("mapping") >= 0.85) & (F.col("coverage") >= 0.8) & (F.col("text_len") >= 500)
    w = W.partitionBy("page")
    s = C.df(spark, sf_dir).select("page", "provider", F.round(confidence(), 6).alias("c"), F.coalesce(dominant, F.lit(False)).alias("dominant")).withColumn("top", F.max("c").over(w))
    first = F.when((F.col("provider") == "readability") & F.col("dominant") & (F.col("top") - F.col("c") <= 0.15), 0).otherwise(1)
    return s.select("page", "provider", F.row_number().over(w.orderBy(first, F.col("c").desc(), "provider")).alias("rank"))


@query(
    "htm17_inline_blocks",
    "SELECT page_id, item, length(item) <= 70 AND len(string_split(item, ' ')) <= 10 AS is_inline FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' '))) AS item FROM pages)",
)
def htm17(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.transform(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1)), lambda x: F.btrim(F.regexp_replace(x, "<[^>]+>", "")))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(item).alias("item"))
    return rows.withColumn("is_inline", (F.char_length("item") <= 70) & (F.size(F.split("item", " ")) <= 10))


@query("htm02_candidate_nodes")
def htm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = article.candidates(html.nodes(table(spark, sf_dir, "pages")))
    return found.select("page_id", "node_id", "tag", "class", "text_len", F.round("score", 6).alias("score"))


@query("htm12_article_roots")
def htm12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.article_roots(html.nodes(table(spark, sf_dir, "pages")))


@query("htm15_page_blocks")
def htm15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(table(spark, sf_dir, "pages"))


@query("htm18_node_paths")
def htm18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.nodes(table(spark, sf_dir, "pages")).select("page_id", "node_id", "parent_id", "depth", "path", "tag")


@query("htm22_extraction_report")
def htm22(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = html.blocks(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("text")).alias("n_chars"), F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("headings"))
    n = html.nodes(table(spark, sf_dir, "pages")).groupBy("page_id").agg((F.max("noise_len") / F.greatest(F.max("text_len"), F.lit(1))).alias("noise"))
    return b.join(n, "page_id").withColumn("quality", article.extraction_quality(F.col("blocks"), F.col("n_chars"), F.col("noise"), F.col("headings"))).drop("noise")


STYLES = Literal("node long, style string", ((1, "height: 5000px; transform: translateY(120px); color: red"), (2, "position:absolute;top:40px"), (3, "color: blue"), (4, "min-height:300px;overflow:hidden")), more=derived.PAGE_STYLES)


@query("htm24_devirtualized_styles", f"SELECT node, trim(regexp_replace(regexp_replace(style, '(?i)(^|;)\\s*(min-height|height|top|transform)\\s*:[^;]*', '\\1', 'g'), '(?i)position\\s*:\\s*absolute', 'position:static', 'g'), '; ') AS style FROM {STYLES.sql()} s")
def htm24(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("style", r"(?i)(^|;)\s*(min-height|height|top|transform)\s*:[^;]*", "$1")
    return STYLES.df(spark, sf_dir).select("node", F.btrim(F.regexp_replace(bare, r"(?i)position\s*:\s*absolute", "position:static"), F.lit("; ")).alias("style"))


@query("htm26_stripped_scripts", "SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>.*?</script>')) AS scripts, length(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g')) AS n_chars FROM pages")
def htm26(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "(?is)<script[^>]*>.*?</script>"
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit(p)).cast("long").alias("scripts"), F.char_length(F.regexp_replace("html", p, "")).cast("long").alias("n_chars"))
