"""Queries over page trees: noise marks, the walk for text blocks, roots.

They begin with parsed pages, which SQL does not have; ``tests/test_page_tree.py`` holds them to a plain walk of
the same pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import ledger, page_tree
from textloom.plans.base import query, table
from textloom.sources import tree


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree(table(spark, sf_dir, "pages"))


def saved_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read the elements more than once: each time would parse the pages again."""
    return ledger.saved(nodes(spark, sf_dir))


def bodies(nodes: DataFrame) -> DataFrame:
    return nodes.where("tag = 'body'").groupBy("page_id").agg(F.min("node_id").alias("node_id"))


@query("htm01_removed_nodes")
def htm01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page how many elements are marked for removal, and the characters in them (what stands in several counts once)."""
    marked = page_tree.marks(nodes(spark, sf_dir))
    outer = F.col("removed") & ~page_tree.below(F.col("removed"))
    return marked.select("page_id", "removed", F.when(outer, F.col("text_chars")).otherwise(0).alias("n")).groupBy("page_id").agg(
        F.count_if("removed").alias("removed_nodes"), F.sum("n").alias("removed_chars"), F.count(F.lit(1)).alias("nodes")
    )


@query("flt16_node_marks")
def flt16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tree.marks(nodes(spark, sf_dir)).select("page_id", "node_id", "tag", "is_hidden", "overlay", "low_priority", "noise", "metadata")


@query("flt17_consent_nodes")
def flt17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tree.marks(nodes(spark, sf_dir)).groupBy("page_id").agg(F.count_if("consent").alias("consent_nodes"), F.count(F.lit(1)).alias("nodes"))


@query("htm14_walk_verdicts")
def htm14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = saved_nodes(spark, sf_dir)
    return page_tree.walk(n, bodies(n)).select("page_id", "node_id", "tag", F.col("verdict.kind").alias("kind"), F.col("verdict.reason").alias("reason"))


@query("htm16_walk_blocks")
def htm16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = saved_nodes(spark, sf_dir)
    return page_tree.blocks(n, bodies(n)).withColumn("outline", F.array_join("outline", " > "))


@query("ext29_walk_facts")
def ext29(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = page_tree.walk_facts(nodes(spark, sf_dir))
    return facts.select("page_id", "node_id", "tag", "inside_article", "block_above", "prose_flow", "in_region", "in_chrome", "content_aside")


@query("ext28_refined_roots")
def ext28(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = saved_nodes(spark, sf_dir)
    picks = page_tree.selected_roots(n)
    steps = {"selected": picks, "refined": page_tree.refined_roots(n, picks)}
    steps["unwrapped"] = page_tree.unwrapped_roots(n, steps["refined"])
    steps["best"] = page_tree.best_roots(n, steps["unwrapped"])
    found = None
    for name, step in steps.items():
        named = step.select("page_id", F.col("node_id").alias(name))
        found = named if found is None else found.join(named, "page_id")
    return found


@query("htm23_header_expansion")
def htm23(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = saved_nodes(spark, sf_dir)
    return page_tree.with_headers(n, page_tree.selected_roots(n))


@query("htm06_readability_roots")
def htm06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_tree.readability_roots(saved_nodes(spark, sf_dir))


@query("htm21_prepared_blocks")
def htm21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots found and refined, then the blocks below them; pages without a block are walked through their tables."""
    n = saved_nodes(spark, sf_dir)
    return page_tree.page_blocks(n, ledger.checkpointed(page_tree.article_roots(n))).withColumn("outline", F.array_join("outline", " > "))
