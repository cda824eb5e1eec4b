from __future__ import annotations

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SCHEMA, folder, prose
from textloom.llm import language_id


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, "de" if i % 3 == 0 else "en", 40), "de" if i % 3 == 0 else "en", "s", 0) for i in range(200)]
    odd = [(1000, None, "en", "s", 0), (1001, "12 !! --", "de", "s", 0), (None, prose(rng, "de", 30), None, "s", 0), (1002, "", None, "s", 0)]
    got = language_id.op8_language_id(spark, folder(spark, rows + odd)).collect()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(got) == 204 and held
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == ("de" if r.doc_id % 3 == 0 else "en") for r in held) >= 0.95 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "de" and 0 <= by[None].score <= 1


def slow_logs(lattice, word, weight):
    """Log of the sum over all segmentations, place by place in exact fractions of large powers."""
    raw = (" " + word).encode()
    alpha = [Fraction(1)]
    for place in range(1, len(raw) + 1):
        alpha.append(sum(alpha[b] * Fraction(weight[lattice.pieces[raw[b:place]]]) for b in range(max(0, place - 40), place) if raw[b:place] in lattice.pieces))
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


def test_forward_sums_all_segmentations():
    """Words within a block, at its border (31, 32, 33 and 48, 49 bytes with the space) and far beyond, of pieces likely and not."""
    lattice = language_id.load(language_id.default_vocabulary())
    words = ["thin", "é", *[("overthelazydog" * 9)[:n] for n in (30, 31, 32, 33, 47, 48, 64, 65, 100)], "ありがとうございました" * 12, "x" * 300, "中文" * 40]
    rng = np.random.default_rng(0)
    for low in (1e-3, 1e-9):
        weight = 10 ** rng.uniform(np.log10(low), -2, size=(lattice.n, 2))
        length, at, begin, end, piece = lattice.edges(words)
        assert length.tolist() == [len((" " + w).encode()) for w in words]
        logs = lattice.likelihoods(length, *lattice.forward(length, at, begin, end, weight[piece]))
        back = lattice.likelihoods(length, *lattice.backward(length, at, begin, end, weight[piece]))
        assert np.isfinite(logs).all() and np.allclose(logs, back)
        for i, word in enumerate(words):
            assert math.isclose(logs[i, 0], slow_logs(lattice, word, weight[:, 0]), rel_tol=1e-9)
        counts = lattice.expected(length, at, begin, end, weight[piece][:, :1])[:, 0]
        # each byte is covered once, whatever the segmentation
        assert np.allclose(np.bincount(at, counts * (end - begin)), length)


def test_predictions_against_plain_sums(spark):
    """The predicted language is the one of the highest sum of word likelihoods, by exact fractions."""
    rng = random.Random(6)
    rows = [(i, prose(rng, "de" if i % 2 else "en", 25), "de" if i % 2 else "en", "s", 0) for i in range(60)] + [(100, "Überaus" + "schön" * 12 + " 12 the", None, "s", 0), (101, "thing " + "x" * 400, None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    langs, model = language_id.train(df)
    assert langs == ["de", "en"] and np.allclose(model.sum(axis=0), 1)
    lattice = language_id.load(language_id.default_vocabulary())
    for r in language_id.predict(df, langs, model).collect()[::4] + language_id.predict(df.where("doc_id >= 100"), langs, model).collect():
        total = [sum(slow_logs(lattice, w, model[:, k]) for w in lattice.words(r.text.lower())) for k in range(2)]
        assert r.language.lang == langs[int(np.argmax(total))]
        assert math.isclose(r.language.score, 1 / (1 + math.exp(-abs(total[0] - total[1]))), rel_tol=1e-6)


def test_small_batches_change_nothing(monkeypatch):
    words = ["a", "bb" * 40, "the", "c" * 200, "ü"]
    lattice = language_id.load(language_id.default_vocabulary())
    model = np.random.default_rng(1).random((lattice.n, 3)) / 1000
    tables = []
    for cells in (1, 4_000_000):
        monkeypatch.setattr(language_id, "CELLS", cells)
        scorer = language_id.Scorer(["x", "y", "z"], model, language_id.default_vocabulary())
        scorer.learn(words)
        tables.append(scorer.table)
    assert np.allclose(*tables)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 0)], SCHEMA).withColumn("language", F.lit("kept")).withColumn("score", F.lit(3))
    with pytest.raises(ValueError):
        language_id.predict(df, [], np.zeros((0, 0)))
    got = language_id.predict(df, [], np.zeros((0, 0)), out="found").first()
    assert (got.language, got.score, got.found.lang) == ("kept", 3, "und")


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 0)], SCHEMA)
    langs, model = language_id.train(df)
    assert langs == []
    assert language_id.predict(df, langs, model).first().language.lang == "und"
    assert language_id.op8_language_id(spark, folder(spark, [])).count() == 0
