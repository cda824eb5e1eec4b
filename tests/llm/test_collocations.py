"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import SCHEMA, documents, folder
from tests.oracle import assert_same, connection
from textloom.llm import collocations, merkle

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str) -> list[list[str]]:
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n-\r]", text.translate(UPPER))]


def counted(rows: list[tuple[str | None, str | None]]) -> dict[str, Counter]:
    found: dict[str, Counter] = {}
    for lang, text in rows:
        for words in pieces(text or ""):
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    found.setdefault(lang or "und" if lang != "" else "", Counter())[tuple(words[i : i + n])] += 1
    return found


def brute(rows: list[tuple[str | None, str | None]], least: int, most: int, share: int) -> list[tuple]:
    out = []
    for lang, f in counted(rows).items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            if any(p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in candidates.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


@pytest.mark.parametrize(("least", "most", "share"), [(2, 2000, 50), (3, 7, 80)])
def test_against_counting(spark, least, most, share):
    rng = random.Random(2)
    words = "the The of big Data é 中文 a b x-1 'q' \x00z".split(" ")
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! ", "\x0b", "\x0c"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(40)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("en", " .;\n "), ("xx", "one two three")] + [("en", "a tie of words here")] * 5 + [("de", "lang " * 3000)]
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=least, most=most, share=share).collect())
    assert got == brute(rows, least, most, share)


def test_query(spark):
    rows = [r for _ in range(4) for r in documents(40)]
    got = collocations.op13_collocations(spark, folder(spark, rows, schema=SCHEMA))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute([(r[2], r[1]) for r in rows], 10, 2000, 50)


def test_empty_and_clashing_columns(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    df = spark.createDataFrame([("en", "x y " * 12, 1, 2, 3)] * 2, "lang string, text string, n int, c int, phrase int")
    assert [r.phrase for r in collocations.collocations(df).collect()] == [r[2] for r in brute([("en", "x y " * 12)] * 2, 10, 2000, 50)]


def test_without_a_bitmap(spark, monkeypatch):
    rows = [("en", "p q r. p q s. p q")] * 6
    monkeypatch.setattr(collocations, "MOST_KEYS", 0)
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=2).collect()) == brute(rows, 2, 2000, 50)


@pytest.mark.parametrize("name", ["op11_manifest", "op13_collocations"])
def test_against_sql(spark, name):
    path = "/root/testdata/sf0.01"
    run, sql = {"op11_manifest": (merkle.op11_manifest, merkle.ORACLE_SQL), "op13_collocations": (collocations.op13_collocations, collocations.ORACLE_SQL)}[name]
    assert assert_same(run(spark, path), sql, connection(path)) > 0


def test_shards_hold_all_pieces(monkeypatch):
    """Small shards and blocks give the same counts."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", 11)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 30)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de"]), "".join(rng.choice("abc") + rng.choice("   .\n") for _ in range(60))) for _ in range(30)]
    frames = [pd.DataFrame(rows[i : i + 7], columns=["lang", "text"]) for i in range(0, 30, 7)]
    got: dict[str, Counter] = {}
    for out in collocations._phrases(iter(frames), None):
        for lang, n, phrase, c in out.itertuples(index=False):
            if n:
                got.setdefault(lang, Counter())[tuple(phrase.split(" "))] += c
    assert got == counted(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=8), st.integers(1, 6))
def test_suffix_array(found, words):
    ids = np.concatenate([np.array(p, dtype=np.int32) for p in found])
    rest = np.concatenate([np.minimum(np.arange(len(p), 0, -1), words) for p in found]).astype(np.int8)
    text = ids.tolist()
    order, ranks = collocations.suffix_array(ids, rest, words)
    suffixes = [text[i : i + rest[i]] for i in order.tolist()]
    assert suffixes == sorted(suffixes)
    shared = collocations.shared_words(order, ranks, rest, words)
    for n in range(1, words + 1):
        place, times = collocations.intervals(order, shared, rest, n)
        want = Counter(tuple(text[i : i + n]) for i in range(len(text)) if rest[i] >= n)
        assert {tuple(text[i : i + n]): c for i, c in zip(place.tolist(), times.tolist(), strict=True)} == want
