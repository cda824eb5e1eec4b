from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.util import SCHEMA, documents, folder
from textloom.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    free, left = set(order), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
            free.discard(s)


def test_targets_and_words_taken(spark):
    rows = documents(90, 7)
    got = mixing.op9_mixing(spark, folder(spark, rows)).collect()
    source = {r[0]: r[3] for r in rows}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    for r in got:
        taken[source[r.doc_id]] += r.taken if source[r.doc_id] == source.get(r.doc_id) else 0
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    unique = [s for s in want if s != "src2"]  # an id that repeats with another source is left out of the sums
    assert all(abs(target[s] - want[s]) < 1e-6 for s in unique if s in target)
    assert len(got) == len(rows)
    total = sum(r.taken for r in got)
    assert abs(total - sum(want.values())) <= 0.02 * total + 10


def test_each_source_comes_near_its_target(spark):
    """Words taken by source against targets from plain Python, with one source of a third of all rows and one of few."""
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 120))), "en", f"s{i % 9}" if i % 3 else "hot", 0) for i in range(900)]
    rows += [(1000, "one long " * 3000, "en", "few", 0), (1001, "a b c", "en", "few", 0), (1002, None, "en", "none", 0), (1003, "x y z", "en", None, 0)]
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r[0]: r[3] for r in rows}
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    for r in mixing.op9_mixing(spark, folder(spark, rows)).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
    want = brute_targets(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in want)


def test_clashing_columns_and_a_long_text(spark):
    names = ["size", "block", "h", "rank", "target", "draws", "draw", "row", "words"]
    rows = [(i, f"text {i} " * (20_000 if i == 3 else 5), "s", *range(9)) for i in range(12)] + [(None, None, None, *range(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", {c} int" for c in names))
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert all(tuple(r[n] for n in names) == tuple(range(9)) for r in got.collect())
    assert {r.text for r in got.collect()} <= {r[1] for r in rows}


def test_reruns_agree_and_shards_split_tokens(spark):
    path = folder(spark, documents(60, 1))
    a, b = mixing.op9_mixing(spark, path), mixing.op9_mixing(spark, path)
    assert a.exceptAll(b).count() == 0
    tokens = spark.range(1000).select((F.col("id") % 3).cast("int").alias("rank"), (F.col("id") / 3).cast("int").alias("place"))
    quotas = mixing.split_tree(tokens, 3, 5)
    assert quotas.agg(F.sum("quota")).first()[0] == 1000
    per = [r[1] for r in quotas.groupBy("shard").agg(F.sum("quota")).collect()]
    assert len(per) == 8 and set(per) == {125}
    placed = mixing.shard_of(tokens.withColumn("place", F.col("place") + 1), quotas)
    assert placed.count() == 1000 and placed.dropDuplicates(["rank", "place"]).count() == 1000


def test_the_mix_itself(spark):
    rows = [r for r in documents(50, 9) if r[0] is not None]
    df = spark.createDataFrame(list({r[0]: r for r in rows}.values()), SCHEMA)
    mixed = mixing.mixed(df)
    n = mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert n == mixing.plan_mix(df).select(F.sum("taken")).first()[0]
    assert mixed.columns == df.columns
    joined = mixed.select("doc_id", F.col("text").alias("t")).join(df, "doc_id")
    assert joined.where(~F.col("text").startswith(F.col("t"))).count() == 0
    assert mixing.op9_mixing(spark, folder(spark, [])).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c d ",), ("a",), ("",)], "t string")
    for n, want in ((0, ["", "", ""]), (2, ["  a b", "a", ""]), (4, ["  a b\n c d", "a", ""])):
        assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.lit(n))).collect()] == want


def test_no_text_is_cut_and_words_come_nearest_to_the_target(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20 + i * 37 % 60)), "en", f"src{i % 3}", 0) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in (256, 1):
        taken, target = defaultdict(int), {}
        for r in mixing.plan_mix(df, blocks=blocks).collect():
            assert r.taken in (0, r["size"], 2 * r["size"]) and all(d.words == r["size"] for d in r.draws)
            taken[r.row.source] += r.taken
            target[r.row.source] = r.target
        assert all(abs(taken[s] - target[s]) <= 40 for s in target)


def test_the_mix_is_written_by_shard_and_position(spark):
    df = spark.createDataFrame([(i, f"{i} " * 30, "en", f"src{i % 3}", 0) for i in range(300)], SCHEMA)
    want = sorted((d.shard, d.position, r.row.doc_id) for r in mixing.plan_mix(df).collect() for d in r.draws)
    got = mixing.mixed(df).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in got}) > 1 and all(r.text == f"{r.doc_id} " * 30 for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.part)] == [i for *_, i in want]
