"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenisation.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on
all rows of ``docs`` and returns a DataFrame.  Every stage but the last returns the
columns of the documents table, so the output of one, written as Parquet and read
again, is the ``docs`` of the next.

1. language_id drops documents that are ``und``: null, or without a letter.
2. line_dedup replaces a text by its kept lines and updates ``n_chars``.
3. near_dedup keeps one document of each class of near copies, whole.
4. mixing gives a row for each copy that the mix takes, whole, by shard and by place in it.
5. bpe encodes every text and decodes it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, language_id, line_dedup, mixing, order_minhash
from textloom.llm.storage import save

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    langs, model = language_id.train(docs)
    return language_id.predict(docs.select(*COLUMNS), langs, model).where(F.col("language.lang") != language_id.UNKNOWN).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS)).select("row.*", "kept_text")
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs.select(*COLUMNS), ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Language ID, near-dedup and BPE are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
