from __future__ import annotations

import hashlib
import random
import statistics
import string

from pyspark.sql import functions as F

from tests.llm.util import documents, folder, prose
from textloom.llm import syncmers


def test_edits_and_likeness(spark):
    rows = [r for r in documents(60, 2) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in syncmers.op7_syncmers(spark, folder(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (k, text, *_) in enumerate(order):
        own, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(own) // 3
        assert got[k].n_chars == len(own)
        assert got[k].edited_sha256 == hashlib.sha256((own[: len(own) - cut] + after[:cut]).encode()).hexdigest()
        assert len(got[k].fingerprint) % 8 == 0 and 0 <= got[k].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 200]
    assert statistics.mean(r.near_edited for r in long) > 0.35
    assert statistics.mean(r.near_next for r in long) < 0.05
    assert got[4].fingerprint == got[5].fingerprint  # equal texts


ENDS = set("aeiouAEIOU0369") | set(string.punctuation)
SPACES = set(" \t\n\x0b\x0c\r")


def tokens_of(text):
    """Pieces of words that end after certain characters or after seven others, one character at a time."""
    out, now = [], ""
    for c in text:
        ends = c in ENDS or ord(c) > 127
        if c in SPACES or (len(now) == syncmers.LONGEST - 1 and not ends):
            out, now = out + [now], ""
        if c not in SPACES:
            now += c
        if ends:
            out, now = out + [now], ""
    return [t for t in [*out, now] if t]


def slow_anchors(spark, text):
    """Anchors from the definition: the k-mers of tokens whose smallest s-mer is the first or the last."""
    tokens = tokens_of(text)
    k, s = syncmers.K, syncmers.S
    if len(tokens) < k:
        return [("few", *tokens)] if tokens else []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").select("i", F.xxhash64("t").alias("h"))
    h = [r.h for r in rows.orderBy("i").collect()]
    smers = spark.createDataFrame([(i, *h[i : i + s]) for i in range(len(h) - s + 1)], "i int, a long, b long, c long").select("i", F.xxhash64("a", "b", "c").alias("h"))
    inner = [r.h for r in smers.orderBy("i").collect()]
    width = k - s
    return [tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1) if min(inner[i : i + width + 1]) in (inner[i], inner[i + width])]


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(4)
    texts = [prose(rng, "en", 120), prose(rng, "de", 60), "".join(chr(0x4E00 + rng.randrange(90)) for _ in range(200)), "kk" * 50 + " 12 1245", "a b", "x", "", " \n", "a,b;c" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r for r in syncmers.with_anchors(df, "text", "anchors").withColumn("n", F.size(syncmers.token_hashes(F.col("text")))).collect()}
    named = {}
    for i, text in enumerate(texts):
        want = slow_anchors(spark, text)
        assert got[i].n == len(tokens_of(text))
        assert len(got[i].anchors) == len(want)
        # equal k-mers, and only those, have equal hashes
        for kmer, anchor in zip(want, got[i].anchors, strict=True):
            assert named.setdefault(kmer, anchor) == anchor
    assert len(set(named.values())) == len(named)


def test_fingerprints_and_likeness_against_plain_sets(spark):
    rows = [r for r in documents(40, 6) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in syncmers.op7_syncmers(spark, folder(spark, rows)).collect()}
    cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (k, *_) in enumerate(order):
        own, after = got[k], got[order[(i + 1) % len(order)][0]]
        assert abs(own.near_edited - jaccard(cut(own.fingerprint), cut(own.edited_fingerprint))) < 1e-12
        assert abs(own.near_next - jaccard(cut(own.fingerprint), cut(after.fingerprint))) < 1e-12


def test_ranges_and_repeated_ids(spark):
    """Neighbours over many ranges, with ids that repeat and ids that are the least or the largest long."""
    rows = [(i, f"text number {i} has its own words") for i in range(60)]
    rows += [(7, "other words under seven"), (7, "other words under seven"), (-(2**63), "least"), (2**63 - 1, "most"), (None, "one"), (None, "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({(i is not None, i or 0, hashes[t], t) for i, t in rows}, reverse=True)
    want = {}
    for n, (known, i, _, t) in enumerate(order):
        after = order[(n + 1) % len(order)][3]
        want[i if known else None, t] = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
    got = [(r.did, r.text, r.edited) for r in syncmers.fingerprint_edits(df).collect()]
    assert len(got) == len(rows)
    assert all(want[i, t] == e for i, t, e in got)


def test_context_free(spark):
    part = " ".join(f"x{i * 13 % 97}" for i in range(120))
    df = spark.createDataFrame([(1, part), (2, "some words before it " * 5 + part + " and after" * 9)], "i long, text string")
    a, b = (r.anchors for r in syncmers.with_anchors(df, "text", "anchors").orderBy("i").collect())
    assert ",".join(map(str, a)) in ",".join(map(str, b))


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (None, None, "en", "s", 0), (3, "", "en", "s", 0)]
    got = syncmers.op7_syncmers(spark, folder(spark, rows)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 3, 3]
    assert syncmers.op7_syncmers(spark, folder(spark, [])).count() == 0
    one = syncmers.op7_syncmers(spark, folder(spark, rows[:1])).first()
    assert one.near_next == 1.0


def test_pairs_across_the_border_are_compared_in_one_unit(spark):
    rng = random.Random(3)
    base = prose(rng, "en", 90)[:402]
    rows = [(9, base[:399]), (8, base), (7, prose(rng, "en", 200)[:550]), (6, "short"), (5, "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(900)))]
    got = {r.doc_id: r for r in syncmers.op7_syncmers(spark, folder(spark, [(*r, "en", "s", 0) for r in rows])).collect()}
    assert got[9].near_next > 0.9  # 399 and 402 characters
    assert got[7].near_edited > 0.3 and got[7].n_chars == 550  # edited to fewer than 400
    assert got[5].near_edited > 0.3  # long, without white space
