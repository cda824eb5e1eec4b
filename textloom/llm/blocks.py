"""Comparing the members of buckets in blocks of bounded size.

Buckets that hold more than ``most`` rows are cut into chunks by a hash, and every pair
of chunks is a block of its own; so no task holds a bucket and none is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import shuffle_partitions


def in_blocks(rows: DataFrame, bucket: list[str], member: str, most: int, counted: str) -> DataFrame:
    """``rows`` of buckets with two members or more, with ``left``, ``right`` and ``side``
    (0: of chunk left, 1: of chunk right), grouped in partitions and sorted by block.

    ``counted`` is the column with the number of rows in the bucket."""
    sized = rows.withColumn("chunks", F.ceil(F.col(counted) / most).cast("int"))
    own = F.pmod(F.xxhash64(F.lit("chunk"), F.col(member)), F.col("chunks")).cast("int")
    placed = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = placed.select(
        *rows.columns,
        F.least("own", "other").alias("left"),
        F.greatest("own", "other").alias("right"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    key = [*bucket, "left", "right"]
    return blocks.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key, "side", member)


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of two rows or more of equal keys from frames that are sorted by them."""
    carry: pd.DataFrame | None = None
    for frame in frames:
        whole = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
        if whole.empty:
            continue
        k = whole[keys].to_numpy()
        starts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]
        ends = np.r_[starts[1:], len(whole)]
        for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if e - s > 1:
                yield whole.iloc[s:e]
        carry = whole.iloc[starts[-1] :]
    if carry is not None and len(carry) > 1:
        yield carry


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The lowest index that each row of a symmetric link matrix reaches."""
    root = np.arange(len(linked))
    n = len(linked)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        lower = np.where(reach, root[None, :], n).min(axis=1)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower
