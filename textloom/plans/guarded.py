"""Guarded updates over the event log: purchases start a user's run, errors cancel it, all else marks a segment of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import guarded
from textloom.plans.base import query, table

STATES = {"purchase": "running", "error": "cancelled"}
JUDGED = """WITH log AS (SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'cancelled' END AS state, json_extract_string(props, '$.k')::BIGINT AS segment,
  CASE WHEN event_type IN ('purchase', 'error') THEN NULL WHEN value < 20 THEN 'running' WHEN value < 60 THEN 'candidate' ELSE 'cancelled' END AS mark FROM events),
seen AS (SELECT *, last_value(state IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
judged AS (SELECT run, seq, segment, mark, before AS state, coalesce(CASE WHEN mark = 'cancelled' THEN before = 'cancelled' ELSE before = 'running' END, false) AS accepted FROM seen WHERE mark IS NOT NULL)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    events = table(spark, sf_dir, "events").select(c("user_id").alias("run"), c("event_id").alias("seq"), "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("segment"))
    states = events.where(c("event_type").isin(*STATES)).select("run", "seq", F.when(c("event_type") == "purchase", "running").otherwise("cancelled").alias("state"))
    mark = F.when(c("value") < 20, "running").when(c("value") < 60, "candidate").otherwise("cancelled")
    return guarded.judged(states, events.where(~c("event_type").isin(*STATES)).select("run", "seq", "segment", mark.alias("mark")))


@query("sta02_judged_updates", JUDGED + " SELECT * FROM judged")
def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir)


@query(
    "sta02_current_marks",
    JUDGED + " SELECT run, segment, arg_max(mark, seq) FILTER (WHERE accepted) AS mark, count(*) FILTER (WHERE accepted AND mark = 'running') AS attempts, count(*) FILTER (WHERE NOT accepted) AS refused FROM judged GROUP BY run, segment",
)
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded.current(logs(spark, sf_dir))
