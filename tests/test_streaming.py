from __future__ import annotations

import datetime
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from textloom.streaming import cache, events, frames

T0 = datetime.datetime(2024, 1, 1)


def written(spark, rows, folder, n):
    data = [(i, T0 + datetime.timedelta(seconds=s), u, k, 1.0, "{}") for i, s, u, k in rows]
    spark.createDataFrame(data, events.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_append_continues_behind_the_cursor(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    os.makedirs(f"{folder}/in")
    written(spark, [(1, 0, 1, "a"), (2, 5, 1, "b")], folder, "in/x")
    stream = lambda: events.append_to(events.read_events(spark, f"{folder}/in/*"), f"{folder}/out", f"{folder}/check").awaitTermination()
    stream()
    written(spark, [(3, 9, 2, "a")], folder, "in/y")
    stream()
    assert sorted(r[0] for r in spark.read.parquet(f"{folder}/out").select("event_id").collect()) == [1, 2, 3]


def test_spaced_calls(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    written(spark, [(1, 0, 1, "a"), (2, 10, 1, "a"), (3, 30, 1, "a"), (4, 31, 2, "a"), (5, 45, 1, "a")], folder, "x")
    drained(events.spaced_calls(events.read_events(spark, f"{folder}/*")), "spaced")
    assert {r["event_id"]: r["allowed"] for r in spark.table("spaced").collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_first_calls_and_windows(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    written(spark, [(1, 0, 1, "a"), (2, 10, 1, "a"), (3, 20, 1, "b"), (4, 7200, 2, "a")], folder, "x")
    drained(events.first_calls(events.read_events(spark, f"{folder}/*")), "firsts")
    assert spark.table("firsts").count() == 3
    drained(events.counts_by_window(events.read_events(spark, f"{folder}/*")), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 4


def cut_anywhere(rng, data: bytes) -> list[bytes]:
    edges = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(12)))})
    return [data[a:b] for a, b in zip(edges, edges[1:])] or [b""]


def test_chunks_cut_anywhere_give_the_same_lines(spark):
    rng = random.Random(8)
    texts = {1: "data: {\"a\":\"é中😀\"}\n\ndata: [DONE]\n", 2: "no end", 3: "\n\n\n", 4: "ü" * 50 + "\nrest é", 5: ""}
    want = {(k, i, x) for k, t in texts.items() for i, x in enumerate(t.split("\n")[:-1])}
    schema = "stream_id long, seq long, chunk binary"
    for _ in range(3):
        rows = [(k, n, bytearray(b)) for k, t in texts.items() for n, b in enumerate(cut_anywhere(rng, t.encode()))]
        rng.shuffle(rows)
        assert {tuple(r) for r in frames.lines(spark.createDataFrame(rows, schema)).collect()} == want
    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    rows.sort(key=lambda r: (r[1], r[0]))
    for n in range(0, len(rows), 5):
        # a chunk that is sent twice changes nothing
        spark.createDataFrame(rows[max(0, n - 1) : n + 5], schema).coalesce(1).write.parquet(f"{folder}/in/{n:04d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    drained(frames.lines_as_they_come(stream), "framed")
    assert {tuple(r) for r in spark.table("framed").collect()} == want
    data = {r[0] for r in spark.table("framed").select(frames.event_data(F.col("text"))).collect()}
    assert data == {'{"a":"é中😀"}', None}


def test_cache_entries_expire(spark):
    folder = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def turn(n, calls):
            spark.createDataFrame(calls, "call_id long, key string, put string").coalesce(1).write.parquet(f"{folder}/in/{n}")
            stream = spark.readStream.schema("call_id long, key string, put string").parquet(f"{folder}/in/*")
            answers = cache.answered(stream, 20_000)
            answers.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(once=True).start().awaitTermination()
            return time.time()

        put = turn(0, [(1, "a", "x"), (2, "b", "y"), (3, "a", None), (4, "a", "z"), (5, "c", None)])
        assert turn(1, [(6, "a", None), (7, "b", None)]) - put < 19, "too slow a machine for this test"
        time.sleep(max(0, put + 21 - time.time()))
        turn(2, [(8, "a", None), (9, "b", "new"), (10, "b", None)])
        got = {r.call_id: r.value for r in spark.read.parquet(f"{folder}/out").collect()}
        assert got == {3: "x", 5: None, 6: "z", 7: "y", 8: None, 10: "new"}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
