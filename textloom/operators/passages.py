"""Passages that stand word for word in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage that it is looked up by.
WORDS = 5


def holding(texts: DataFrame, id_col: str, passages: DataFrame, passage_col: str, text_col: str = "text") -> DataFrame:
    """(id, passage id) where the text contains the passage.

    Both sides meet in an equi join on the hash of the passage's second to sixth words (it may
    begin inside a word of the text); only ids go through it.  The pairs that met then fetch
    their text and passage once.  Passages of fewer words are met by what they have, so they
    must be whole words of the text after the first."""
    words = F.split(text_col, r"\s")
    size = F.least(F.lit(WORDS), F.greatest(F.lit(1), F.size("w") - 1))
    keyed = passages.withColumn("w", words).select(F.col(passage_col), size.alias("n"), F.xxhash64(F.array_join(F.slice("w", F.lit(2), size), " ")).alias("k"))
    lengths = [r[0] for r in keyed.select("n").distinct().collect()]  # at most WORDS numbers
    cut = texts.withColumn("w", words)

    def runs(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))

    grams = F.array_distinct(F.flatten(F.array(*[runs(n) for n in sorted(lengths)]))) if lengths else F.array().cast("array<long>")
    met = cut.select(F.col(id_col), F.explode(grams).alias("k")).join(keyed.drop("n"), "k").select(id_col, passage_col).distinct()
    pairs = met.join(texts.select(id_col, F.col(text_col).alias("_text")), id_col).join(passages.select(passage_col, F.col(text_col).alias("_passage")), passage_col)
    return pairs.where(F.col("_text").contains(F.col("_passage"))).select(id_col, passage_col).distinct()
