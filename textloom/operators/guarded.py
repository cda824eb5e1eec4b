"""Batched updates that a run's state admits or refuses, over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col
# fixed values: the states in which a run takes results, and the marks that need one of them
ACTIVE = ["queued", "running"]
NEEDS_ACTIVE = ["running", "failed", "candidate"]


def judged(states: DataFrame, updates: DataFrame) -> DataFrame:
    """``updates`` (run, seq, segment, mark) with ``state``, what the run's was just before, and ``accepted``.

    ``states`` has (run, seq, state); the last one before an update decides, in one ordered pass over both logs
    of a run.  Marks of work need an active run, ``cancelled`` a cancelled one; before a run's first state all
    is refused.  The segments of one update (run, seq) share the verdict, so a batch is taken whole or not at all."""
    log = states.select("run", "seq", "state", F.lit(None).cast("string").alias("mark"), F.lit(None).cast("long").alias("segment")).unionByName(
        updates.select("run", "seq", F.lit(None).cast("string").alias("state"), "mark", "segment")
    )
    before = W.partitionBy("run").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    seen = log.withColumn("now", F.max(F.when(c("state").isNotNull(), F.struct("seq", "state"))).over(before)["state"]).where(c("mark").isNotNull())
    fits = F.when(c("mark").isin(*NEEDS_ACTIVE), c("now").isin(*ACTIVE)).when(c("mark") == "cancelled", c("now") == "cancelled").otherwise(c("now").isNotNull())
    return seen.select("run", "seq", "segment", "mark", c("now").alias("state"), F.coalesce(fits, F.lit(False)).alias("accepted"))


def current(marks: DataFrame) -> DataFrame:
    """(run, segment, mark, attempts, refused): what the accepted updates of ``judged`` come to; an attempt is a mark ``running``."""
    done = c("accepted")
    by = marks.groupBy("run", "segment").agg(
        F.max_by("mark", F.when(done, c("seq"))).alias("mark"), F.count_if(done & (c("mark") == "running")).alias("attempts"), F.count_if(~done).alias("refused"), F.bool_or(done).alias("any")
    )
    return by.select("run", "segment", F.when(c("any"), c("mark")).alias("mark"), "attempts", "refused")
