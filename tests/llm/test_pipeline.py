from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_line_dedup import key
from tests.llm.test_order_minhash import brute as classes
from tests.llm.util import SCHEMA, folder, prose


def corpus():
    rng = random.Random(11)
    shared = "This very line stands in many documents."
    rows = []
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, prose(rng, lang, 80) + ("\n" + shared if i % 4 == 0 else ""), lang, f"src{i % 4}", 0))
    rows += [(100, rows[10][1] + " tail", "en", "src1", 0), (101, rows[11][1], "en", "src2", 0), (102, None, "en", "src0", 0), (103, "123 --", None, None, 0)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]


def test_each_stage_takes_effect(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, "")
    assert {r.doc_id for r in first.collect()} == {r[0] for r in rows} - {102, 103}
    second = stages["line_dedup"](spark, first, "")
    held = Counter(key(x) for r in second.collect() for x in r.text.split("\n") if len(key(x)) >= 20)
    assert held[key("This very line stands in many documents.")] == 1
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = stages["near_dedup"](spark, second, "")
    kept = [r.doc_id for r in third.collect()]
    assert len(kept) == len(set(kept)) == len({c for _, c in classes([(r.doc_id, r.text) for r in second.collect()])})
    assert 10 in kept and 100 not in kept and 101 not in kept
    fourth = stages["mixing"](spark, third, "")
    assert third.columns == second.columns == first.columns == fourth.columns == corpus_pipeline.COLUMNS
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(fourth) - 1.5 * words(third)) <= 5
    last = stages["bpe"](spark, fourth, "")
    assert last.count() == fourth.count() and last.where("n_tokens = 0").count() == 0


def test_run_is_the_stages_in_order(spark):
    path = folder(spark, corpus())
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.exceptAll(corpus_pipeline.run(spark, path)).count() == 0
    assert corpus_pipeline.run(spark, folder(spark, [])).count() == 0


def test_nulls_repeats_a_long_text_and_other_columns(spark):
    """Each stage over null ids, texts and sources, rows and ids that repeat, a very long text and columns of clashing names."""
    rng = random.Random(15)
    rows = [(i, prose(rng, "en", 60), "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(None, prose(rng, "en", 50), "en", None, None), (None, prose(rng, "en", 50), None, "src1", 1), (3, prose(rng, "en", 50), "en", "src0", 0), rows[5], rows[5]]
    rows += [(200, prose(rng, "de", 30_000), "de", "src2", 0), (201, None, None, None, None), (202, "", "en", "src0", 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", t int, row int, language int")
    docs, sizes = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == corpus_pipeline.COLUMNS
        sizes[name] = docs.count()
    letters = len(rows) - 2
    assert sizes["language_id"] == sizes["line_dedup"] == letters
    assert sizes["near_dedup"] == letters - 2  # the rows that repeat; ids that repeat with other texts stay
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == sizes["mixing"] and last.where("n_tokens = 0").count() == 0
