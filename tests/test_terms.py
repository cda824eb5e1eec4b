"""Fixed terms against a plain scan, their round trip, and names of more tokens than a key holds."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from textloom.operators import graph, terms
from textloom.plans.catalog import registered

TERMS = [("King Rat", "王鼠"), ("the King Rat of the Old Northern Town", "Rattenkönig"), ("king", "König"), ("中村", "Nakamura"), ("中村先生", "Herr Nakamura"), ("O'Neil-Smith", "ON"), ("Élan", "Schwung"), ("Иван", "Ivan"), ("...", "dots"), (None, "x")]
TEXTS = [
    "The King Rat of the Old Northern Town met King Rat and a king, kings, viking.", "昨日、中村先生と中村が来た", "O'Neil-Smith saw élan; Élan's ÉLAN", "Иван и Ивановна", "", None, "no such thing", "KING RAT king rat King  Rat", "__TERM_001__ king",
    "xKing King9 King中村 中村King",
]


def plain(text: str, words: list[str]) -> list[str]:
    """Terms found from the left, the longest first."""
    low, at, found = text.lower(), 0, []
    while at < len(text):
        fits = [w for w in words if low.startswith(w.lower(), at) and terms.bounded(text, at, at + len(w))]
        if fits:
            best = max(fits, key=len)
            found.append(best)
            at += len(best)
        else:
            at += 1
    return found


def test_masked_terms_are_those_of_a_plain_scan(spark):
    rng = random.Random(3)
    bits = ["King", "Rat", "the", "中村", "先生", "king", " ", " ", "of", "Old", ",", "Élan", "O'Neil-Smith", "King Rat", "the King Rat of the Old Northern Town"]
    rows = list(enumerate([*TEXTS, *("".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(150))]))
    known = spark.createDataFrame(TERMS, "source string, target string")
    got = {r.id: r for r in terms.protected(spark.createDataFrame(rows, "id long, text string"), known, "id", "text").collect()}
    words = [s for s, _ in TERMS if s and re.search(r"\w", s)]
    for i, text in rows:
        r = got[i]
        if not text or terms.MARKS[:7] in text:
            continue
        of = {t.marker: t.source for t in r.terms}
        assert [of[m] for m in re.findall(terms.MARKS, r.text)] == plain(text, words), text
        back = r.text
        for t in r.terms:
            back = back.replace(t.marker, t.source)
        assert back.lower() == text.lower()
    assert got[4].text == "" and got[5].text is None and got[5].terms == []
    assert [t.source for t in got[0].terms] == ["the King Rat of the Old Northern Town", "King Rat", "king"]


def test_drafts_are_masked_for_terms_of_their_source_only(spark):
    rows = [(1, "King Rat came", "王鼠 und Ivan und Ivan"), (2, "Иван came", "王鼠 und Ivan")]
    known = spark.createDataFrame(TERMS, "source string, target string")
    held = terms.protected(spark.createDataFrame(rows, "id long, source string, draft string"), known, "id", "source", "draft")
    c = F.col
    got = {r.id: r for r in held.withColumn("match", terms.marker_counts_match(c("source"), c("draft"), c("terms"))).withColumn("back", terms.restored(c("draft"), c("terms"), F.lit("target"))).collect()}
    assert got[1].draft == f"{got[1].terms[0].marker} und Ivan und Ivan" and got[1].match
    assert got[2].draft == f"王鼠 und {got[2].terms[0].marker}" and got[2].match
    assert [got[i].back for i, _, d in rows] == [d for _, _, d in rows]


def test_restoring_in_depth(spark):
    m = [terms.MARK.format(1), terms.MARK.format(2)]
    value = {"findings": [{"sourceExcerpt": f"a {m[0]}", "note": {"text": f"{m[1]}, {m[0]}"}}, m[1]], "n": 1}
    docs = spark.createDataFrame([(1, json.dumps(value)), (2, "{}")], "id long, json string")
    own = spark.createDataFrame([(1, [("King", "König", m[0]), ("Rat", "Ratte", m[1])])], f"id long, terms {terms.PAIRS}")
    got = {r.id: json.loads(r.json) for r in terms.restored_documents(docs, own, "id", "json").collect()}
    assert got == {1: {"findings": [{"sourceExcerpt": "a King", "note": {"text": "Ratte, König"}}, "Ratte"], "n": 1}, 2: {}}


def test_names_of_more_tokens_than_a_key(spark):
    texts = spark.createDataFrame([(1, "one the King Rat of the Old Town two"), (2, "the king rat of the other town"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("The King-Rat of the Old Town",), ("king rat",), ("",)], "name string")
    assert {(r.id, r.name) for r in graph.mentions(texts, "text", names, "name").collect()} == {(1, "The King-Rat of the Old Town"), (1, "king rat"), (2, "king rat")}


def test_sieve_keeps_what_is_asked_for(spark):
    asked = spark.range(0, 1000, 10).selectExpr("xxhash64(id) AS k")
    rows = spark.range(0, 1000).selectExpr("id", "xxhash64(id) AS k")
    kept = {r.id for r in graph.sieved(rows, asked, "k").collect()}
    assert set(range(0, 1000, 10)) <= kept and len(kept) < 110


def test_each_count_of_a_mapping_is_taken_once(spark):
    plan = registered()["scl12_mapping_verdicts"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # one a side
    assert plan.count("[^.!?;。！？；") == 2


def test_texts_are_cut_once_for_their_terms(spark, monkeypatch):
    cuts, keys = [], terms.keys_of_texts
    monkeypatch.setattr(terms, "keys_of_texts", lambda *a, **k: cuts.append(1) or keys(*a, **k))
    registered()["ext26_protected_segments"][0](spark, "/root/testdata/sf0.001")
    assert len(cuts) == 1


def test_runs_that_begin_no_term_stay_behind(spark):
    texts = spark.createDataFrame([(1, "a king and a queen of the old town " * 3), (2, "nothing here"), (3, None), (4, "tail of the old town"), (5, "昨日中村")], "id long, text string")
    hashed = ["xxhash64(u[0]) AS first", "CASE size(u) WHEN 1 THEN xxhash64(u[0]) ELSE xxhash64(u[0], u[1], u[2], u[3]) END AS gram"]
    asked = spark.createDataFrame([(["king"],), (["of", "the", "old", "town"],), (["\x01中村"],)], "u array<string>").selectExpr(*hashed)
    got = {(r.id, r.gram) for r in terms.keys_of_texts(texts, "id", "text", asked).collect()}
    king, town, pair = [r.gram for r in asked.collect()]
    assert got == {(1, king), (1, town), (4, town), (5, pair)}
