from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.util import documents, folder
from textloom.llm import bpe

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(packed: bytes) -> list[int]:
    return [x[0] for x in struct.iter_unpack("<I", packed)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_equals_the_library_on_any_text(texts):
    v = bpe.load(PATH)
    for text, packed in zip(texts, v.encode_all(texts), strict=True):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == want
        assert v.decode(packed) == LIBRARY.decode(want, skip_special_tokens=False)


def test_hard_texts():
    rng = random.Random(0)
    texts = ["a" * 1000, "ab" * 3000, "<|endoftext|><|endoftext|> x", " \n\n\t x", "\0\0a", "don't we'LL", "x" * 30000] + ["".join(rng.choice("ab \n'é😀") for _ in range(400)) for _ in range(50)]
    v = bpe.Vocabulary(PATH)
    assert [ids_of(p) for p in v.encode_all(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_short_and_long_lists_agree(monkeypatch):
    texts = [t for _, t, *_ in documents(40, 3) if t]
    found = []
    for most in (1, 10**9):
        monkeypatch.setattr(bpe, "SHORT_LIST", most)
        found.append(bpe.Vocabulary(PATH).encode_all(texts))
    assert found[0] == found[1]


def test_query(spark):
    rows = documents()
    got = sorted(bpe.op10_bpe(spark, folder(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.ids_sha256))
    want = []
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(struct.pack("<I", x) for x in ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert bpe.op10_bpe(spark, folder(spark, [])).count() == 0
    one = bpe.encode(spark.createDataFrame([("a b",), (None,)], "text string")).select(bpe.unpack_ids(bpe.F.col("ids_packed")).alias("ids")).collect()
    assert [r.ids for r in one] == [LIBRARY.encode("a b").ids, []]


def test_words_across_parts_and_chunks(monkeypatch):
    """Long texts cut into parts, endings, white space of all kinds, added tokens beside words."""
    rng = random.Random(3)
    bits = ["'s", "'re", "'ll", "'x", "' s", "!'s", "'", " ", "  ", "\n", "\n\n ", "\t", "\u3000", "\x1c", "\x85", "a", "B", "\u00e9", "\u4e2d", "7", "\u0663", "\u00b2", "!?", "_", "<|endoftext|>", "<|", "\U0001f600", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for long_text, chunk in ((10**6, 10**6), (5, 40)):
        monkeypatch.setattr(bpe, "LONG_TEXT", long_text)
        monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(bpe, "CHUNK_IDS", chunk)
        v = bpe.Vocabulary(PATH)
        packed = v.encode_all(texts)
        assert [ids_of(p) for p in packed] == want
        assert v.decode_all([*packed, None]) == [LIBRARY.decode(w, skip_special_tokens=False) for w in want] + [""]


def test_equal_hashes_fall_back_to_the_words_themselves(monkeypatch):
    monkeypatch.setattr(bpe, "_hash_powers", lambda n: (np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)))
    texts = ["one two three two", "three", "one  one"]
    assert [ids_of(p) for p in bpe.Vocabulary(PATH).encode_all(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_the_cache_lets_go_of_its_older_half(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    texts = [t for _, t, *_ in documents(40, 4) if t]
    v = bpe.Vocabulary(PATH)
    assert [ids_of(p) for p in v.encode_all(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert len(v.known) <= 10


def test_clashing_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "x", b"")], "doc_id long, text string, ids_packed binary")
    with pytest.raises(ValueError):
        bpe.encode(df)
    assert bpe.encode(df, out="other").columns == ["doc_id", "text", "ids_packed", "other"]


def test_a_batch_of_millions_of_characters_takes_little_memory():
    """Measured: 10 bytes a character at the peak, results included; 69 where a whole batch was cut into words at once."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(1000)]
    assert sum(map(len, texts)) > 3_000_000
    v = bpe.Vocabulary(PATH)
    bpe._hash_powers.cache_clear()
    tracemalloc.start()
    packed = v.encode_all(texts)
    decoded = v.decode_all(packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert decoded == texts
    assert peak < 24 * sum(map(len, texts))


def test_cuts_and_gathered_stretches_change_nothing(monkeypatch):
    texts = [t for _, t, *_ in documents(40, 8)] + ["<|endoftext|>a<|endoftext|>", "x" * 300, "end<|endoftext|> of <|endoftext|>"]
    v = bpe.Vocabulary(PATH)
    want = [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for cut, chunk, ids in ((1, 1, 1), (30, 1000, 7), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(bpe, "CUT_CHARS", cut)
        monkeypatch.setattr(bpe, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(bpe, "CUT_IDS", ids)
        packed = v.encode_all(texts)
        assert [ids_of(p) for p in packed] == want
        assert v.decode_all(packed) == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_texts_are_encoded_once(spark):
    plan = bpe.op10_bpe(spark, folder(spark, documents(13)))._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
