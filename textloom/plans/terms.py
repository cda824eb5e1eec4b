"""Queries over fixed terms in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import graph, ledger, terms
from textloom.plans.base import query, table

#: Words of a benchmark item that are a term: more than any key holds.
TERM_WORDS = 6


@query(
    "ext26_protected_segments",
    f"""WITH t AS (SELECT min(item_id) AS item, lower(array_to_string(string_split(text, ' ')[1:{TERM_WORDS}], ' ')) AS source FROM benchmark WHERE len(string_split(text, ' ')) > {TERM_WORDS} GROUP BY 2),
d AS MATERIALIZED (SELECT doc_id, ' ' || lower(text) || ' ' AS low FROM documents),
hits AS (SELECT doc_id, item, (length(low) - length(replace(low, source, ''))) // length(source) AS n FROM d JOIN t ON contains(low, source))
SELECT doc_id, count(*) AS n_terms, sum(n)::BIGINT AS n_markers, true AS counts_match, true AS draft_back FROM hits WHERE n > 0 GROUP BY doc_id""",
)
def ext26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a term of six words: masked in the source, and in a draft that has the term's target in its place.

    The draft comes back from its markers as it was."""
    c = F.col
    first = F.array_join(F.slice(F.split("text", " "), 1, TERM_WORDS), " ")
    named = table(spark, sf_dir, "benchmark").where(F.size(F.split("text", " ")) > TERM_WORDS).select(first.alias("source"), F.format_string("Begriff Nr %d", "item_id").alias("target"))
    docs = table(spark, sf_dir, "documents").select("doc_id", c("text").alias("source"))
    own = ledger.saved(terms.terms_of_texts(docs, "doc_id", "source", named).withColumnRenamed("id", "doc_id"))
    # most texts hold no term: they stay behind before the join
    hashed = F.xxhash64("doc_id").alias("key")
    kept = graph.sieved(docs.select("*", hashed), own.select(hashed), "key").drop("key").join(own, "doc_id")
    drafted = kept.withColumn("draft", terms.restored(terms.masked(c("source"), c("terms"), "source"), c("terms"), F.lit("target")))
    held = terms.protected_by(drafted.withColumn("before", c("draft")), "source", "draft").where(F.size("terms") > 0)
    marks = F.regexp_count("source", F.lit(terms.MARKS)).cast("long")
    return held.select(
        "doc_id", F.size("terms").cast("long").alias("n_terms"), marks.alias("n_markers"), terms.marker_counts_match(c("source"), c("draft"), c("terms")).alias("counts_match"),
        (terms.restored(c("draft"), c("terms"), F.lit("target")) == c("before")).alias("draft_back"),
    )
