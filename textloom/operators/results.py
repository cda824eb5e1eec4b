"""Model answers as rows, and how they fit what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ITEMS = "struct<translations:array<struct<id:string,translated_text:string,text:string,translation:string>>>"


def answer_rows(answers: DataFrame, chunk_col: str, raw_col: str) -> DataFrame:
    """(chunk, pos, id, text): the first given of translated_text, text and translation."""
    items = F.from_json(F.col(raw_col), ITEMS)["translations"]
    rows = answers.select(chunk_col, F.posexplode(items).alias("pos", "r"))
    return rows.select(chunk_col, "pos", F.col("r.id").alias("id"), F.coalesce("r.translated_text", "r.text", "r.translation").alias("text"))


def first_answers(rows: DataFrame, chunk_col: str) -> DataFrame:
    """The first answer that is not blank for each id."""
    w = W.partitionBy(chunk_col, "id").orderBy("pos")
    return rows.where(F.btrim("text") != "").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "pos")


def judge_answers(blocks: DataFrame, rows: DataFrame, chunk_col: str) -> DataFrame:
    """(chunk, id, text, verdict): ok, unchanged, missing or extra."""
    verdict = F.when(F.col("source").isNull(), "extra").when(F.col("text").isNull(), "missing").when(F.col("text") == F.col("source"), "unchanged").otherwise("ok")
    return blocks.join(first_answers(rows, chunk_col), [chunk_col, "id"], "full").select(chunk_col, "id", "text", verdict.alias("verdict"))
