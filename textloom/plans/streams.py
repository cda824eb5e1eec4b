"""Batch forms of the stream queries, and windows as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.base import query, table
from textloom.streaming import events, frames


@query("str02_cursor_batches", "SELECT event_id // 1000 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("str03_live_entries", "WITH k AS (SELECT user_id, event_type, max(ts) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT user_id, event_type, value FROM k WHERE ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events)")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    k = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("value", "event_id").alias("value"))
    return k.join(F.broadcast(now), F.col("ts") > F.col("since")).select("user_id", "event_type", "value")  # a single row


@query("ext_stream_tumbling_windows", "SELECT date_trunc('hour', ts) AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.counts_by_window(e).withColumns({"total": F.round("total", 4), "begins": F.col("begins").cast("timestamp_ntz")})


@query(
    "ext_stream_sessions",
    "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS grp FROM s) SELECT user_id, min(ts) AS begins, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM g GROUP BY user_id, grp",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.sessions(e).withColumns({"begins": F.col("begins").cast("timestamp_ntz"), "ends": F.col("ends").cast("timestamp_ntz")})


#: Bytes of a chunk: no line and no character ends where one does.
CHUNK = 37


@query(
    "str01_framed_lines",
    """WITH s AS (SELECT conv_id, string_split(string_agg('data: ' || text || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) END, '' ORDER BY turn), chr(10)) AS parts FROM conversations GROUP BY conv_id)
SELECT conv_id AS stream_id, i - 1 AS line, parts[i] AS text, CASE WHEN parts[i] LIKE 'data:%' THEN trim(parts[i][6:], ' ' || chr(13)) END AS data FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM s)""",
)
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of an event stream, of which some run on into the next turn, cut into chunks of bytes."""
    sent = F.encode(F.concat(F.lit("data: "), "text", F.when(F.col("turn") % 3 == 0, "").otherwise("\n")), "UTF-8")
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", sent.alias("sent"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.octet_length("sent") - 1), F.lit(CHUNK))
    chunks = turns.select("conv_id", "turn", "sent", F.explode(starts).alias("at")).select(
        F.col("conv_id").alias("stream_id"), F.struct("turn", "at").alias("seq"), F.substring("sent", F.col("at") + 1, F.lit(CHUNK)).alias("chunk")
    )
    return frames.lines(chunks).withColumn("data", frames.event_data(F.col("text")))
