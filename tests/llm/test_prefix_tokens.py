"""Token counts of prefixes against the tokenizers library, prefix by prefix."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.util import documents, folder
from textloom.llm import bpe, prefix_tokens

PIECES = [
    "'re", "'ve", "'ll", "'s", "'t", " ", "  ", "\n", "\n\n", "\t", "a", "ab", "hello", " world", "!", "!!", "...", "--------", " " * 10, "<|endoftext|>", "<|endo", "é", "中文", "😀", "123", "١", "'", "’", "r", "v", "l",
    "ing", "x" * 30, "=", "==", "\r\n", "ÿ", "a" * 70, "ab" * 50, "-" * 140, " " * 130, "Ünï", "　", "<|endoftext|><|endoftext|>",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def counts(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def every_prefix(tokenizer, text: str) -> list[int]:
    return counts(tokenizer, [text[:i] for i in range(1, len(text) + 1)])


def test_prefixes_of_hostile_texts(tokenizer):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(700)]
    got = prefix_tokens.load(bpe.default_vocabulary()).prefixes(texts)
    for text, found in zip(texts, got, strict=True):
        assert found.tolist() == every_prefix(tokenizer, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_prefixes_of_any_text(tokenizer, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    got = prefix_tokens.load(bpe.default_vocabulary()).prefixes([text])[0]
    assert got.tolist() == every_prefix(tokenizer, text)


def test_chunks_and_long_words(tokenizer, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(40)) for _ in range(30)] + [None, "", "".join(rng.choice("abcdeé ") for _ in range(3000)), "ab" * 2000]
    whole = prefix_tokens.Counter(bpe.default_vocabulary()).prefixes(texts)
    monkeypatch.setattr(prefix_tokens, "CHUNK_CHARS", 50)
    monkeypatch.setattr(prefix_tokens, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "LONG_TEXT", 25)
    again = prefix_tokens.Counter(bpe.default_vocabulary()).prefixes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, again, strict=True))
    assert [int(x[-1]) if len(x) else 0 for x in whole] == counts(tokenizer, [t or "" for t in texts])


@given(st.lists(st.integers(0, 2000), max_size=40))
def test_pack_and_unpack(values):
    assert prefix_tokens.unpack(prefix_tokens.pack(np.array(values, dtype=np.int64))).tolist() == [0, *values]


def test_query(spark, tokenizer):
    rows = documents(60)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.n_chars_within_limit) for r in prefix_tokens.op12_token_counts(spark, folder(spark, rows)).collect()}
    want = set()
    for i, text, *_ in rows:
        text = text or ""
        n = counts(tokenizer, [text])[0]
        within = len(text) if n <= 512 else None
        if within is None:
            ends = [k for k in range(len(text)) if k < 6000]
            within = max(k for k, x in zip(ends, counts(tokenizer, [text[:k] for k in ends]), strict=True) if x <= 512)
        want.add((i, len(text.encode()), n, n > 512, within))
    assert got == want and {True, False} == {r[3] for r in got}


def test_other_prefixes_and_columns(spark, tokenizer):
    rows = [("one two  three", 5, 1), ("one two  three", 99, 2), ("don't", None, 3), (None, 4, 4), ("x <|endoftext|>", 8, 5)]
    df = spark.createDataFrame(rows, "body string, n int, tokens int")
    got = prefix_tokens.count_at(prefix_tokens.prefix_counts(df, "body", "packed"), "n", "packed").orderBy("tokens").collect()
    assert [r.n_tokens for r in got] == [None if n is None else counts(tokenizer, [(t or "")[:n]])[0] for t, n, _ in rows]
    with pytest.raises(ValueError):
        prefix_tokens.prefix_counts(df, "body", "Tokens")
    assert prefix_tokens.prefix_counts(df.limit(0), "body").collect() == []
