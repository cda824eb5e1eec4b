"""Names of documents as entities of kinds: a document is a book of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import book, entities
from textloom.plans.base import query, table

#: A capitalised word or two with the word after it, which says the kind.
NAMED = rf"({book.NAME})(?: ({book.NAME}))?(?: \p{{Ll}}+)?(?![\p{{L}}])"
# fixed values: words after a place, words after a person
AFTER_PLACE = "in at of from to à en de dans von zu im am aus nach del".split()
AFTER_PERSON = "and with by for is was et avec par qui und mit für ist y con que".split()


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, position, kind, source, aliases): names in order; one of two words goes by the whole, with its words as aliases."""
    c = F.col
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)).alias("found"))
    # a number of its own for each row of a document, in order
    words = found.select("doc_id", F.posexplode("found").alias("position", "name")).select("doc_id", c("position").cast("long").alias("position"), F.split("name", " ").alias("w"))
    after = F.element_at("w", -1)
    kind = F.when(after.isin(*AFTER_PLACE), "place").when(after.isin(*AFTER_PERSON), "person").otherwise("other")
    names = words.select("doc_id", "position", kind.alias("kind"), F.filter("w", lambda x: x.rlike(r"^\p{Lu}")).alias("names"))
    aliases = F.when(F.size("names") > 1, c("names")).otherwise(F.array().cast("array<string>"))
    return names.select("doc_id", "position", "kind", F.array_join("names", " ").alias("source"), aliases.alias("aliases"))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return entities.merged(document_entities(spark, sf_dir), ["doc_id"], "position", "kind", "source", "aliases")


@query("gra01_records_of_rows")
def records_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]


@query("gra01_kind_records")
def kind_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]
