"""Versioned results as append-only rows: latest by key, overlays, state, retention."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order (give it a total tiebreak)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def newest_value(value: str, order: Column, when: Column | None = None) -> Column:
    """An aggregate: the value at the largest order, of the rows where ``when`` holds."""
    return F.max_by(value, order if when is None else F.when(when, order))


def overlay(base: DataFrame, over: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``base`` with its value replaced where ``over`` has one that is not blank."""
    new = over.select(*keys, F.col(value).alias("_over"))
    return base.join(new, keys, "left").withColumn(value, F.coalesce(F.when(F.btrim("_over") != "", F.col("_over")), F.col(value))).drop("_over")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def keep_newest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order; a top-k, so no task sorts the whole table."""
    return rows.orderBy(*order).limit(n)


def run_outcome(pending: Column, candidates: Column, failed: Column, accepted: Column) -> Column:
    return (
        F.when(pending > 0, "paused")
        .when(candidates > 0, "awaiting-review")
        .when((failed > 0) & (accepted > 0), "partial")
        .when(failed > 0, "failed")
        .otherwise("completed")
    )


def ranked(rows: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in their group, by counts per range of (group, order) and ranks within a range.

    No task holds a group: ranges are of equal size, and what goes through a window per group is a
    row per range.  The ranges are written as a checkpoint, since both steps must see the same."""
    keys = [*group, *order]
    placed = checkpointed(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order))
    named = counts.select(*[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_of"), "_before")
    on = F.col("_range") == F.col("_of")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return placed.withColumn("_inside", inside).join(named, on).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(out))


def checkpoint_dir(rows: DataFrame) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session without one gets its own."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-textloom-', dir='/tmp')}")
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share."""
    checkpoint_dir(rows)
    return rows.checkpoint()


def saved(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in that folder, of which each later step reads the columns that it needs."""
    path = f"{checkpoint_dir(rows)}/saved-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before them in their group.

    A scan in two steps, as in ``ranked``: within ranges, and over a row per range and group."""
    placed = checkpointed(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    named = sums.select(*[F.col(x).alias(f"_of_{x}") for x in group], F.col("_range").alias("_of"), "_before")
    on = F.col("_range") == F.col("_of")
    for x in group:
        on = on & F.col(x).eqNullSafe(F.col(f"_of_{x}"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", inside).join(named, on).select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(out))
