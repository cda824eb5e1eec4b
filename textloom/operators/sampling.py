"""Bounded samples and diverse choices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.packing import group_keys, in_order


def planned_sample(candidates: DataFrame, segment: str, quotas: dict[str, int]) -> DataFrame:
    """(segment, reasons): candidates (segment, phase, rank) by phases in order; a phase adds new segments
    while fewer than its quota, counted over all phases so far, are chosen.

    Each phase is a top-k of the segments not chosen yet; what is chosen so far is bounded
    by the last quota."""
    spark = candidates.sparkSession
    chosen = spark.createDataFrame([], f"{segment} {candidates.schema[segment].dataType.simpleString()}, phase string")
    taken = 0
    for phase, quota in quotas.items():
        free = candidates.where(F.col("phase") == phase).groupBy(segment).agg(F.min("rank").alias("rank"))
        new = free.join(F.broadcast(chosen), segment, "left_anti").orderBy("rank", segment).limit(max(0, quota - taken))  # at most the quota
        chosen = spark.createDataFrame(chosen.unionByName(new.select(segment, F.lit(phase).alias("phase"))).collect(), chosen.schema)
        taken = chosen.count()
    reasons = candidates.join(F.broadcast(chosen.select(segment)), segment, "left_semi").groupBy(segment).agg(F.sort_array(F.collect_set("phase")).alias("reasons"))
    return reasons.select(segment, F.array_join("reasons", ",").alias("reasons"))


def diverse(rows: DataFrame, group: str, order: str, tokens: str, most: int, redundant: float = 0.85) -> DataFrame:
    """Of each group's rows in order, those whose token sets are below ``redundant`` Jaccard to all kept before.

    A stream over sorted groups, of which the token sets of the ``most`` kept rows are held."""

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        kept: list[set] = []
        for frame in frames:
            picks = []
            for i, (own_key, words) in enumerate(zip(group_keys(frame, [group]), frame[tokens], strict=True)):
                if own_key != key:
                    key, kept = own_key, []
                own = set(words)
                if len(kept) < most and all(len(own & k) < redundant * len(own | k) for k in kept):
                    kept.append(own)
                    picks.append(i)
            yield frame.iloc[picks]

    return in_order(rows, [group], [order]).mapInPandas(greedy, rows.schema)


def stable_sides(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``swapped``: a coin per key that reruns agree on."""
    return rows.withColumn("swapped", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(2)) == 1)


def capped(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows in order, with whether there were more."""
    more = rows.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return rows.orderBy(*order).limit(cap).join(F.broadcast(more))  # a single row


def evenly(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = W.partitionBy(group)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    return placed.where(F.array_contains(F.array(*[F.floor(F.lit(j) * (F.col("_n") - 1) / max(1, n - 1)).cast("int") for j in range(n)]), F.col("_i"))).drop("_i", "_n")
