"""Choosing a page's main content from its node table, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: class tokens that speak for and against main content
GOOD = r"(^|[\s_-])(article|content|post|entry|story|body|main|text)([\s_-]|$)"
BAD = r"(^|[\s_-])(ad|ads|nav|menu|sidebar|footer|comment|related|share|promo|banner|cookie)([\s_-]|$)"
META = r"(^|[\s_-])(author|byline|date|meta|timestamp)([\s_-]|$)"


def density_score(n: dict[str, Column]) -> Column:
    """Text density of a node: readable text against links, times what its tag, class, siblings and depth say.

    ``n``: text_len, readable, links, link_len, tag, role, class, children, depth, body_len,
    sibling_max, sibling_sum and siblings."""
    readable, total = n["readable"].cast("double"), n["text_len"].cast("double")
    base = (readable - n["link_len"]) / (n["links"] + 1) * F.log(readable + 1)
    purity = readable / total
    dense = F.when(purity > 0.7, 1.1).when(purity < 0.4, 0.7).otherwise(1.0)
    tag = F.when((n["tag"] == "article") | (n["role"] == "article"), 1.3).when((n["tag"] == "main") | (n["role"] == "main"), 1.2).when(n["tag"] == "section", 1.02).otherwise(1.0)
    low = F.lower(n["class"])
    named = F.when(low.rlike(GOOD), 1.2).otherwise(1.0) * F.when(low.rlike(BAD), 0.5).otherwise(1.0) * F.when(low.rlike(META), 0.92).otherwise(1.0)
    linked = 1 / (1 + 2 * n["link_len"] / F.greatest(readable, F.lit(1.0)))
    packed = F.when((n["children"] > 20) & (readable / F.greatest(n["children"], F.lit(1)) < 25), 0.85).otherwise(1.0)
    mean = n["sibling_sum"] / n["siblings"]
    smaller = F.when((n["sibling_max"] > 0) & (readable < n["sibling_max"] * 0.7), 0.85).otherwise(1.0)
    even = F.when((n["siblings"] > 3) & (F.abs(readable - mean) / mean < 0.25), 0.9).otherwise(1.0)
    deep = F.when(n["depth"] < 3, 0.95).otherwise(1.0) * F.when(n["depth"] > 7, 0.9).otherwise(1.0)
    share = readable / F.greatest(n["body_len"], F.lit(1))
    whole = F.when(n["tag"] == "body", 1.0).when(share >= 0.4, 1.3).when(share >= 0.25, 1.15).when(share < 0.05, F.greatest(F.lit(0.1), share / 0.05)).otherwise(1.0)
    return F.when(total < 50, 0.0).otherwise(base * dense * tag * named * linked * packed * smaller * even * deep * whole)


def candidates(nodes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Containers that may hold the article, with their score."""
    sib = W.partitionBy(id_col, "parent_id")
    body = F.max(F.when(F.col("tag") == "body", F.col("text_len"))).over(W.partitionBy(id_col))
    wide = nodes.withColumns({"sibling_max": F.max("text_len").over(sib), "sibling_sum": F.sum("text_len").over(sib), "siblings": F.count(F.lit(1)).over(sib), "body_len": F.coalesce(body, F.lit(0))})
    c = F.col
    n = {k: c(v) for k, v in (("text_len", "text_len"), ("readable", "readable_len"), ("links", "link_count"), ("link_len", "link_len"), ("tag", "tag"), ("role", "role"), ("class", "class"), ("children", "children"), ("depth", "depth"), ("body_len", "body_len"), ("sibling_max", "sibling_max"), ("sibling_sum", "sibling_sum"), ("siblings", "siblings"))}
    holds = c("tag").isin("article", "main", "section", "body") | c("role").isin("article", "main") | (c("tag").isin("div", "td") & (F.lower("class").rlike(GOOD) | (c("text_len") > 1000)))
    return wide.where(holds).withColumn("score", density_score(n))


def article_roots(nodes: DataFrame, id_col: str = "page_id", least: float = 300.0) -> DataFrame:
    """The best container of each page; the body where none reaches the least score."""
    body = F.max(F.when(F.col("tag") == "body", F.col("node_id")))
    best = candidates(nodes, id_col).groupBy(id_col).agg(F.max_by(F.struct("node_id", "tag", "score", "text_len"), F.struct(F.col("score"), -F.col("node_id"))).alias("b"), body.alias("body_id"))
    strong = F.col("b.score") >= least
    return best.select(id_col, F.when(strong, F.col("b.node_id")).otherwise(F.coalesce("body_id", "b.node_id")).alias("node_id"), F.when(strong, F.col("b.tag")).otherwise("body").alias("tag"), F.round("b.score", 6).alias("score"))


def quality_score(n: dict[str, Column]) -> Column:
    """Confidence from 0 to 1 that a candidate is the article: size, structure, prior and purity."""
    text = F.least(F.lit(0.4), F.log10(n["readable"] / 100) / 5)
    shape = F.when(n["h1"] == 1, 0.15).when(n["h1"] > 1, -0.05).otherwise(0.0) + F.when(n["h2"] >= 2, 0.1).otherwise(0.0) + F.when(n["paragraphs"] >= 3, 0.1).otherwise(0.0) + F.when(n["named"], 0.08).otherwise(0.0)
    density, links, noise = n["readable"] / n["text_len"], n["link_len"] / n["text_len"], n["noise_len"] / n["text_len"]
    pure = F.when(density > 0.7, 1.08).when(density > 0.4, 1.02).otherwise(1.0) * F.when(links < 0.3, 1.04).otherwise(1.0) * F.when(noise < 0.2, 1.04).otherwise(1.0) * F.greatest(F.lit(0.4), 1 - noise * 1.2)
    raw = (text + F.greatest(F.lit(0.0), F.least(F.lit(0.35), shape)) + F.least(F.lit(0.05), n["prior"] / 10000)) * pure
    return F.when(n["text_len"] < 50, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def extraction_quality(blocks: Column, chars: Column, noise: Column, headings: Column) -> Column:
    parts = (
        F.when(blocks >= 5, 0.3).when(blocks >= 1, 0.1).otherwise(0.0) + F.when(chars >= 500, 0.3).when(chars >= 100, 0.15).otherwise(0.0)
        + F.when(noise < 0.5, 0.2).otherwise(0.0) + F.when(headings >= 1, 0.2).otherwise(0.0)
    )
    return F.least(F.lit(1.0), parts)
