from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import SCHEMA, documents, folder, prose
from textloom.llm import importance

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=200):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(rng, "en", 60) if good else " | ".join("%%%" + prose(rng, "de", 1) for _ in range(50))
        rows.append((i, text, "en", "s", 0))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(4 * i, 0, i % 2) for i in range(12)]
    return rows, labels


def query(spark, rows, labels):
    path = folder(spark, rows)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return importance.op4_importance(spark, path)


def test_good_documents_are_kept(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in query(spark, rows, labels).collect()}
    assert len(got) == len(rows)
    assert sum(r.kept for r in got.values()) == int(np.ceil(len(rows) * sum(q for _, q, _ in labels) / len(labels)))
    good = [r for i, r in got.items() if i % 4]
    bad = [r for i, r in got.items() if not i % 4]
    assert np.mean([r.kept for r in good]) > 0.95 > 0.75 > np.mean([r.kept for r in bad])
    assert min(r.log_weight for r in good) > max(r.log_weight for r in bad)


def test_top_share_equals_a_sort(spark):
    rng = random.Random(1)
    keys = [rng.choice([rng.gauss(0, 1), 0.5, None]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(keys)), "did long, key double")
    order = sorted(range(500), key=lambda i: (keys[i] is None, -(keys[i] or 0), i))
    for share in (0.1, 0.37, 0.9, 1.0):
        kept = {r.did for r in importance.top_share(df, share).where("kept").collect()}
        assert kept == set(order[: int(np.ceil(share * 500))])


def test_weights_against_plain_counts(spark):
    rows, labels = corpus(40)
    docs = spark.createDataFrame(rows, SCHEMA)
    hashed = [np.asarray(r.words, dtype=np.int64) for r in importance.word_hashes(docs, "doc_id", "text").collect()]
    counts = np.zeros(importance.BUCKETS, dtype=int)
    for w in hashed:
        np.add.at(counts, importance.buckets_of(w), 1)
    mine = {r.bucket: r.n for r in importance.counted(importance.word_hashes(docs, "doc_id", "text")).collect()}
    assert mine == {int(b): int(counts[b]) for b in np.flatnonzero(counts)}


def test_edge_rows_and_reruns(spark):
    rows = documents()
    a = query(spark, rows, [(1, 1, 0), (2, 0, 1), (None, 1, None)])
    assert a.count() == len(rows)
    b = query(spark, rows, [(1, 1, 0), (2, 0, 1), (None, 1, None)])
    assert a.exceptAll(b).count() == 0
    assert {r.doc_id for r in a.where("log_weight is null").collect()} == {7, 8, 9}
    assert query(spark, rows, []).where("log_weight != 0").count() == 0
    assert query(spark, [], []).count() == 0


def test_weights_keys_and_kept_against_plain_python(spark):
    """Models, weights, Gumbel keys and the top share, document by document."""
    rows, labels = corpus(60)
    rows += [(None, "no id here", "en", "s", 0), (500, "", "en", "s", 0), (501, "word " * 30_000, "en", "s", 0), (2, rows[2][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    hashes = [(r.doc_id, [np.asarray(r.words, dtype=np.int64)]) for r in importance.word_hashes(docs, "doc_id", "text").withColumnRenamed("did", "doc_id").collect()]
    good = {i for i, q, t in labels if q == 1 and not t}
    logs = []
    for chosen in (good, None):
        counts = np.full(importance.BUCKETS, 0.5)
        for i, (w,) in hashes:
            if chosen is None or i in chosen:
                for b in importance.buckets_of(w).tolist():
                    counts[b] += 1
        logs.append(np.log(counts / counts.sum()))
    ratio = logs[0] - logs[1]
    u = {r.doc_id: ((r.h % 2**64 >> 11) + 0.5) / 2**53 for r in docs.select("doc_id", F.xxhash64(F.lit(4), "doc_id").alias("h")).collect()}
    want = []
    for i, (w,) in hashes:
        weight = ratio[importance.buckets_of(w)].mean() * importance.UNIT if len(w) else None
        want.append((i, weight, None if weight is None else weight - np.log(-np.log(u[i]))))
    k = int(np.ceil(sum(q for _, q, _ in labels) / len(labels) * len(rows)))
    order = sorted(range(len(want)), key=lambda n: (want[n][2] is None, -(want[n][2] or 0), want[n][0] is None, want[n][0] or 0))
    kept = Counter((want[n][0], want[n][2] is not None) for n in order[:k])
    got = query(spark, rows, labels).collect()
    assert sorted((r.doc_id or -1, round(r.log_weight or 0, 6), round(r.key or 0, 6)) for r in got) == sorted((i or -1, round(w or 0, 6), round(x or 0, 6)) for i, w, x in want)
    assert Counter((r.doc_id, r.key is not None) for r in got if r.kept) == kept


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2.0, True)], "doc_id long, text string, did int, key double, kept boolean")
    labels = spark.createDataFrame([(1, 1, 0, "x")], LABELS + ", text string")
    assert importance.resample(df, labels).columns == ["did", "log_weight", "key", "kept"]
