from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from tests.llm.util import SCHEMA, documents, folder, prose
from textloom.llm import order_minhash


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]


def edits(a, b):
    """Words inserted and deleted between two lists of word numbers, by the whole table of common subsequences."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return len(a) + len(b) - 2 * int(row[-1])


def similar(texts, threshold=0.8):
    """Which pairs (i > j) of texts have that edit similarity."""
    number = {}
    seqs = [np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.int64) for t in texts]
    for i, a in enumerate(seqs):
        for j, b in enumerate(seqs[:i]):
            n = len(a) + len(b)
            if abs(len(a) - len(b)) <= (1 - threshold) * n + 1e-9 and edits(a, b) <= (1 - threshold) * n + 1e-9:
                yield i, j


def components(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar(texts):
        root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def brute(rows):
    part = components([r[1] for r in rows])
    names = {}
    for c, r in zip(part, rows, strict=True):
        names.setdefault(c, []).append(r[0])
    best = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return Counter((r[0], best[c]) for c, r in zip(part, rows, strict=True))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = documents(30, 5)
    original = prose(rng, "en", 300)
    rows += [(500 + i, edited(rng, original, rng.randrange(1, 6)), "en", "src0", 0) for i in range(40)]
    rows += [(600 + i, edited(rng, original, 60), "en", "src0", 0) for i in range(5)] + [(499, original.upper(), "en", "src0", 0)]
    boiler = prose(rng, "en", 60)
    rows += [(700 + i, boiler + " " + prose(rng, "en", 70), "en", "src1", 0) for i in range(12)]  # a shared passage makes no copy
    got = Counter((r.doc_id, r.class_id) for r in order_minhash.op6_near_dedup(spark, folder(spark, rows)).collect())
    assert got == brute(rows)


def test_keep_one_has_a_row_per_class(spark):
    rows = documents(30, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = order_minhash.keep_one(df).collect()
    assert len(kept) == len(set(components([r[1] for r in rows])))
    assert order_minhash.keep_one(df.limit(0)).count() == 0


def test_scattered_edits_are_links(spark):
    """The similarity is that of the alignment: a few edits all over a text leave few k-mers whole."""
    rng = random.Random(20)
    text = prose(rng, "en", 200).split(" ")
    other = [f"new{i}" if i % 10 == 5 else w for i, w in enumerate(text)]
    swapped = text[100:] + text[:100]  # as many common k-mers as can be, but no alignment
    rows = [(1, " ".join(text)), (2, " ".join(other)), (3, " ".join(swapped))]
    got = {r.doc_id: r.class_id for r in order_minhash.op6_near_dedup(spark, folder(spark, rows, schema="doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_recall_against_alignments(spark):
    """Pairs from a similarity of 0.8 on, of all lengths, against alignments of all pairs."""
    rng = random.Random(21)
    rows = []
    for i in range(150):
        a = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 8, 14, 30, 70, 97, 150, 300]))]
        b = list(a)
        share = rng.uniform(0.0, 0.2)
        for _ in range(int(share * len(a))):
            place, kind = rng.randrange(len(b)), rng.random()
            b[place : place + (kind < 0.8)] = [f"n{rng.randrange(10**6)}"] if kind < 0.6 or kind >= 0.8 else []
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    links = [(i, j) for i, j in similar([r[1] for r in rows])]
    got = {r.doc_id: r.class_id for r in order_minhash.op6_near_dedup(spark, folder(spark, rows, schema="doc_id long, text string")).collect()}
    found = [got[i] == got[j] for i, j in links]
    assert len(links) > 130 and np.mean(found) >= 0.95
    part = components([r[1] for r in rows])
    assert all(got[a] != got[b] or part[a] == part[b] for a in range(300) for b in (a ^ 1,))


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(22)
    long = [f"w{rng.randrange(4000)}" for _ in range(20_000)]
    near = [w if rng.random() > 0.1 else "x" for w in long]
    rows = [(1, " ".join(long), 7, 7, "a"), (2, " ".join(near), 8, 8, "b"), (None, None, None, None, None), (3, "", 1, 1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t long, did long, _row string")
    kept = order_minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.t, r.did, r._row) for r in kept.collect()) == [(1, 7, 7, "a"), (3, 1, 1, "c")]


def test_edits():
    a = "a b c d e f g h i j".split()
    assert order_minhash.edits_within(a, a, 0) == 0
    assert order_minhash.edits_within(a, [*a[:4], "x", *a[5:]], 4) == 2
    assert order_minhash.edits_within(a, a[3:], 4) == 3
    assert order_minhash.edits_within(a, list("zzzzzzzzzz"), 4) is None
    assert order_minhash.edits_within([], [], 0) == 0


def test_large_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "FAMILY_BLOCK", 4)
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    rng = random.Random(8)
    text = prose(rng, "en", 200)
    rows = [(i, edited(rng, text, rng.randrange(0, 12)), "en", "s", 0) for i in range(30)]
    got = Counter((r.doc_id, r.class_id) for r in order_minhash.op6_near_dedup(spark, folder(spark, rows)).collect())
    assert got == brute(rows)


def test_keep_one_has_a_row_per_component(spark):
    rng = random.Random(12)
    texts = [prose(rng, "en", 80) for _ in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (None, texts[1] + " tail")]  # three classes without an id
    rows += [(7, texts[3]), (7, texts[4]), (7, texts[4]), (9, texts[3] + " tail"), (3, texts[5])]  # two under one id
    got = [(r.doc_id, r.text) for r in order_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 6
    assert {t.removesuffix(" tail") for _, t in got} == set(texts)
    assert Counter(i for i, _ in got) == {None: 3, 7: 2, 3: 1}
