"""Event logs as streams: file source, cursors, expiring state, windows.

The windows with watermarks are extensions; the rest mirrors what the batch queries do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet event files as a stream; the checkpoint holds the cursor."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_calls(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per (user, type) within the watermark: concurrent equal calls share one flight."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def spaced_calls(events: DataFrame, seconds: int = 30) -> DataFrame:
    """(event_id, user_id, allowed): a call is allowed ``seconds`` or more after the last allowed one of its user.

    State is one time per user and expires with the watermark."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        allowed = []
        for at in rows["ts"].astype("datetime64[ms]").astype("int64"):
            ok = last is None or at - last >= seconds * 1000
            last = int(at) if ok else last
            allowed.append(ok)
        state.update((last,))
        due = last + seconds * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    marked = events.withWatermark("ts", "1 minute").select("event_id", "ts", "user_id")
    return marked.groupBy("user_id").applyInPandasWithState(judge, "event_id long, user_id long, allowed boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def counts_by_window(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Extension: counts per type in tumbling windows, late rows dropped behind the watermark."""
    w = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Extension: sessions of each user, closed by a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "n")


def append_to(events: DataFrame, folder: str, checkpoint: str):
    """All available events appended as Parquet; running it again continues behind the last one."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
