from __future__ import annotations

import random

import numpy as np

from tests.llm.util import SCHEMA, documents, folder, prose
from textloom.llm import substring_dedup


def test_chunks_cover_each_text_and_resist_shifts():
    rng = random.Random(5)
    texts = [prose(rng, "en", n) for n in (1, 3, 400, 2000)] + ["x", "é😀" * 5, "a" * 3000]
    owner, start, size, digest, _, words = substring_dedup.chunks(texts)
    for i, t in enumerate(texts):
        own = owner == i
        assert start[own].tolist() == np.r_[0, np.cumsum(size[own])[:-1]].tolist() and size[own].sum() == len(t)
    assert size.max() <= 4 * substring_dedup.CLEAR
    long = texts[3]
    a = set(substring_dedup.chunks([long])[3].tolist())
    b = set(substring_dedup.chunks(["inserted words before it, " + long[:500] + "INSERT" + long[500:]])[3].tolist())
    assert len(a & b) > 0.95 * len(a)
    assert [len(x) for x in substring_dedup.chunks([])] == [0] * 6


def test_digests_tell_texts_apart():
    rng = random.Random(6)
    seen = {}
    for _ in range(200):
        t = prose(rng, "en", 100)
        owner, start, size, digest, *_ = substring_dedup.chunks([t])
        for s, n, d in zip(start, size, digest, strict=True):
            part = t[s : s + n].replace("\n", " ")
            assert seen.setdefault(int(d), part) == part
    assert len(set(seen.values())) == len(seen)


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, "en", 150), "en", "s", 0) for i in range(80)]
    passages = [prose(rng, "de", 55) for _ in range(10)]
    for i in range(30):
        words = rows[i][1].split(" ")
        cut = rng.randrange(len(words))
        rows[i] = (i, " ".join([*words[:cut], passages[i % 10], *words[cut:]]), "en", "s", 0)
    got = substring_dedup.op2_substring_dedup(spark, folder(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(30))
    assert {r.doc_id for r in got if r.kept} == set(range(10))
    assert all(r.first_doc_id == r.doc_id % 10 for r in got)
    text = {r[0]: r[1] for r in rows}
    cleaned = {r.doc_id: r.text for r in substring_dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(cleaned[i] == text[i] for i in [*range(10), *range(30, 80)])
    assert all(len(cleaned[i]) < len(text[i]) - 150 for i in range(10, 30))


def test_edge_rows(spark):
    rows = documents()
    got = substring_dedup.op2_substring_dedup(spark, folder(spark, rows)).collect()
    assert all(r.end - r.start >= substring_dedup.MIN_CHARS for r in got)
    assert len({(r.doc_id, r.start, r.end) for r in got}) == len(got)
    assert substring_dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert substring_dedup.op2_substring_dedup(spark, folder(spark, [])).count() == 0


def test_chunks_do_not_depend_on_the_texts_around():
    rng = random.Random(8)
    texts = [prose(rng, "en", n) for n in [20] * 200 + [1, 2, 3]] + ["", "é"]
    owner, start, size, digest, *_ = substring_dedup.chunks(texts)
    for i, t in enumerate(texts):
        _, s, n, d, *_ = substring_dedup.chunks([t])
        own = owner == i
        assert start[own].tolist() == s.tolist() and size[own].tolist() == n.tolist() and digest[own].tolist() == d.tolist()


def test_every_copy_of_a_short_text_is_found(spark):
    rng = random.Random(9)
    texts = [prose(rng, "en", 60)[: 100 + i % 60] for i in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(1000 - i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = substring_dedup.op2_substring_dedup(spark, folder(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(r[0], 0, len(r[1])) for r in rows}


def test_characters_beyond_sixteen_bits_are_told_apart():
    low = "".join(chr(0x41 + i * 7 % 26) for i in range(300))
    high = "".join(chr(ord(c) + 0x10000) for c in low)
    a, b = (substring_dedup.chunks([t]) for t in (low, high))
    assert not set(zip(a[3].tolist(), a[4].tolist(), strict=True)) & set(zip(b[3].tolist(), b[4].tolist(), strict=True))
    assert not set(a[3].tolist()) & set(b[3].tolist())


def test_periodic_passages_are_found(spark):
    """One word over and over has no cut of its own at all, or one in each period."""
    rng = random.Random(10)
    rows = []
    for i, unit in enumerate(["the ", "blah ", "a ", "abcdefg hij ", "x", "\u4e2d\u6587 ", "one two three four five six seven "]):
        for k in range(2):
            rows.append((10 * i + k, prose(rng, "en", 40 + 7 * k) + " " + unit * (260 // len(unit)) + prose(rng, "de", 30), "en", "s", 0))
    got = substring_dedup.op2_substring_dedup(spark, folder(spark, rows)).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_a_long_text_in_stretches_has_the_same_chunks(monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, "en", 4000), "the " * 3000 + prose(rng, "de", 500) + "y" * 3000, prose(rng, "en", 50), "z" * 5000]
    for text in texts:
        whole = substring_dedup.chunks([text])
        for size in (500, 1777):
            monkeypatch.setattr(substring_dedup, "GROUP_CHARS", size)
            parts = [np.concatenate(x) for x in zip(*substring_dedup.long_chunks(text), strict=True)]
            for a, b in zip(whole[1:], parts[1:], strict=True):
                assert a.tolist() == b.tolist()


def brute(rows, least):
    """Spans from chunks of whole texts, held in plain dictionaries."""
    cut = {}
    for i, t, *_ in rows:
        own = -(2**63) if i is None else i
        if t:
            _, start, size, d1, d2, _ = (x.tolist() for x in substring_dedup.chunks([t]))
            cut[own, t] = list(zip(start, size, d1, d2, strict=True))
    held = {}
    for (i, _), parts in cut.items():
        for _, _, *d in parts:
            held.setdefault(tuple(d), set()).add(i)
    out = set()
    for (i, t), parts in cut.items():
        run = None
        for start, size, *d in [*parts, (len(t), 0, None)]:
            owners = held.get(tuple(d), ())
            if len(owners) > 1:
                run = (run or [start, start, 0])
                run[1], run[2] = start + size, run[2] + size * (min(owners) == i)
            elif run:
                if run[1] - run[0] >= least:
                    out.add((i, *run))
                run = None
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(12)
    rows = documents(60, 9)
    passage = prose(rng, "en", 60)
    rows += [(300 + i, prose(rng, "en", 30) + " " + passage + " " + prose(rng, "en", 30), "en", "s", 0) for i in range(6)] + [(None, passage, "en", "s", 0)]
    got = {(-(2**63) if r.doc_id is None else r.doc_id, r.start, r.end, r.n_kept) for r in substring_dedup.op2_substring_dedup(spark, folder(spark, rows)).collect()}
    assert got == brute(rows, substring_dedup.MIN_CHARS) and len(got) > 6


def test_clashing_columns(spark):
    rng = random.Random(13)
    passage = prose(rng, "en", 80)
    rows = [(i, passage, i, i, i, i, i) for i in range(3)] + [(9, None, 9, 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _did int, _row int, _spans int, did int, start int")
    got = substring_dedup.drop_repeats(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r._did, r._spans, r.did, r.start) for r in got.collect()) == [(0, passage, 0, 0, 0, 0), (1, "", 1, 1, 1, 1), (2, "", 2, 2, 2, 2), (9, None, 9, 9, 9, 9)]
