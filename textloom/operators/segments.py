"""Ordered segments: context before, summaries, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def extractive_summary(rows: DataFrame, group: list[str], order: list[str], text_col: str = "text") -> DataFrame:
    """(group, summary): the first three texts, and the last of more than five if it is not among them."""
    w = W.partitionBy(*group).orderBy(*order)
    placed = rows.select(*group, F.col(text_col).alias("t"), F.row_number().over(w).alias("p"), F.count(F.lit(1)).over(W.partitionBy(*group)).alias("n"))
    first = F.array_sort(F.collect_list(F.when(F.col("p") <= 3, F.struct("p", "t"))))
    s = placed.groupBy(*group).agg(
        F.max("n").alias("n"), F.substring(F.array_join(F.transform(first, lambda x: x["t"]), " "), 1, 420).alias("head"), F.max(F.when(F.col("p") == F.col("n"), F.substring("t", 1, 140))).alias("tail")
    )
    whole = F.when((F.col("n") > 5) & ~F.col("head").contains(F.col("tail")), F.concat("head", F.lit(" … "), "tail")).otherwise(F.col("head"))
    return s.select(*group, F.substring(whole, 1, 600).alias("summary"))


def preceding(rows: DataFrame, group: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """``rows`` with the array ``before`` of the values of up to ``most`` rows before."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(-most, -1)
    return rows.withColumn("before", F.collect_list(value).over(w))
