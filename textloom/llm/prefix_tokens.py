"""Token counts of every prefix of a text, by dynamic programming over the BPE vocabulary.

The encoding of a prefix ends with one token.  It is the one token of the vocabulary that
the prefix ends with and that may follow the last token of what stands before it: two
tokens may stand side by side if no merge crosses the border between them while their
bytes are merged.  So the last token and the number of tokens of each prefix follow from
shorter prefixes, and no prefix is encoded again.  The recurrence runs within the words
of the pre-tokenizer, over the bytes of a worker's new words at once, place by place; what
it gives for a word is kept in a bounded cache.  Counts of a text's prefixes are the sums
over the words before and the count within the last one, but for the prefixes that end
in white space, in an ending such as 're or in an added token: these are cut into other
words than the whole text is, and get counts of their own.

The counts of all prefixes leave as one binary column: a byte for the width, then the
difference to the prefix that is a character shorter, a byte each (four where one byte is
too few).  ``answers`` reads from it the count of the whole text and the longest prefix
within a budget; ``count_at`` the count of any prefix.

Edge cases: a null or empty text has no prefix but the empty one, of no tokens.  Rows that
repeat, an empty table and columns of any name pass through unchanged; a column that has
the name of the output (a parameter) is refused.  Texts of any length are counted whole.
A word of n bytes costs O(n), a million letters some seconds.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe
from textloom.llm.storage import small_batches

#: Words that a Python worker keeps before the older half of its cache is let go.
CACHE_WORDS = 200_000
#: Characters of text that are worked on together.
CHUNK_CHARS = 1_000_000
#: Bytes from which a word is counted alone.
LONG_WORD = 64
#: Answers kept about which tokens may follow each other (a power of two).
KEPT_PAIRS = 1 << 20
NEVER = np.int64(1) << 40


class Counter:
    """The vocabulary's trie of tokens, and the rule by which two tokens may stand side by side."""

    def __init__(self, path: str):
        v = self.v = bpe.load(path)
        n = len(v.sizes)
        # rank of the merge that makes a token (-1: a byte), and its parts
        self.made, self.left, self.right = np.full(n, -1, dtype=np.int64), np.arange(n), np.arange(n)
        for rank, ((a, b), whole) in enumerate(zip(v.pairs, v.product, strict=True)):
            self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        merged = sorted((v.bytes_of[i], i) for i in {*v.byte_id.tolist(), *v.product})
        children: dict[tuple[int, int], int] = {}
        token = [-1]
        for raw, i in merged:
            at = 0
            for byte in raw:
                step = children.get((at, byte))
                if step is None:
                    step = children[at, byte] = len(token)
                    token.append(-1)
                at = step
            token[at] = i
        self.token = np.array(token, dtype=np.int32)
        self.child = np.full((len(token), 256), -1, dtype=np.int32)
        keys = np.array(list(children), dtype=np.int64)
        self.child[keys[:, 0], keys[:, 1]] = list(children.values())
        self.pairs = np.full(KEPT_PAIRS, -1, dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merges_across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a merge crosses the border when the bytes of ``a`` and ``b`` are encoded together.

        Walks back in time: of the two tokens at the border the one made last is taken apart.  A merge of
        the two applies if it comes before either has gone into a larger one; of equal ranks the left is first."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(b), NEVER)
        out = np.zeros(len(a), dtype=bool)
        rows = np.arange(len(a))
        while len(rows):
            rank = self.v.ranks_of(a, b)
            crossed = (rank >= 0) & (rank < until_a) & (rank <= until_b)
            out[rows[crossed]] = True
            made_a, made_b = self.made[a], self.made[b]
            on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            rows, a, b, until_a, until_b, made_a, made_b = (x[on] for x in (rows, a, b, until_a, until_b, made_a, made_b))
            split_a = made_a > made_b
            a, until_a = np.where(split_a, self.right[a], a), np.where(split_a, made_a, until_a)
            b, until_b = np.where(split_a, b, self.left[b]), np.where(split_a, until_b, made_b)
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token ``b`` may stand after ``a``; answers are kept by a hash of the pair."""
        code = a.astype(np.int64) << 32 | b
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (KEPT_PAIRS - 1)
        kept = self.pairs[slot]
        missing = np.flatnonzero(kept >> 1 != code)
        if len(missing):
            fresh, first, back = np.unique(code[missing], return_index=True, return_inverse=True)
            ok = ~self._merges_across(fresh >> 32, fresh & 0xFFFFFFFF)
            kept = kept.copy()
            kept[missing] = (fresh << 1 | ok)[back]
            self.pairs[slot[missing[first]]] = fresh << 1 | ok
        return (kept & 1).astype(bool)

    def _matches(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, token) of all tokens in the words that ``raw`` joins; ``stop``: where each byte's word ends."""
        found = []
        start = np.arange(len(raw))
        at = np.zeros(len(raw), dtype=np.int32)
        step = 0
        while len(start):
            at = self.child[at, raw[start + step]]
            step += 1
            alive = at >= 0
            start, at = start[alive], at[alive]
            ends = self.token[at] >= 0
            found.append((start[ends] + step, start[ends], self.token[at[ends]]))
            inside = start + step < stop[start]
            start, at = start[inside], at[inside]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _by_places(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of the prefixes that end after each byte; all words together, one place in the word after the other."""
        begin_of = np.repeat(begins, sizes)
        end, start, token = self._matches(raw, np.repeat(begins + sizes, sizes))
        place = end - begin_of[start]
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(1, int(sizes.max()) + 2))
        whole = start == begin_of[start]
        # by the last byte of the prefix
        last, count = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int32)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[lo:hi]
            before = start[own] - 1
            fits = whole[own].copy()
            rest = np.flatnonzero(~fits)
            fits[rest] = self.may_follow(last[before[rest]], token[own[rest]])
            own, before = own[fits], before[fits]
            at = end[own] - 1
            last[at] = token[own]
            count[at] = np.where(whole[own], 0, count[before]) + 1
        return count

    def _alone(self, raw: np.ndarray) -> np.ndarray:
        """The same for one long word, byte by byte."""
        n = len(raw)
        end, start, token = self._matches(raw, np.full(n, n))
        order = np.argsort(end, kind="stable")
        edges = np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
        starts, tokens = start[order].tolist(), token[order].tolist()
        last, count = [0] * (n + 1), [0] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, n + 1):
            for k in range(edges[i - 1], edges[i]):
                s, t = starts[k], tokens[k]
                if s:
                    ok = known.get((last[s], t))
                    if ok is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        ok = known[last[s], t] = bool(self.may_follow(np.array([last[s]]), np.array([t]))[0])
                    if not ok:
                        continue
                last[i], count[i] = t, count[s] + 1
                break
        return np.array(count[1:], dtype=np.int32)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Counts of each word's prefixes by characters, as packed 32-bit integers."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(x) for x in coded], dtype=np.int64)
        short = sizes <= LONG_WORD
        out: list[bytes] = [b""] * len(words)
        if short.any():
            picks = np.flatnonzero(short)
            raw = np.frombuffer(b"".join(coded[i] for i in picks.tolist()), dtype=np.uint8)
            own = sizes[picks]
            begins = np.cumsum(own) - own
            count = self._by_places(raw, begins, own)
            # a character ends where the next byte does not continue it
            closes = np.r_[(raw[1:] & 0xC0) != 0x80, True]
            packed = count[closes].astype("<i4").tobytes()
            upto = np.r_[0, np.cumsum(closes)][np.r_[begins, len(raw)]] * 4
            for i, a, b in zip(picks.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                out[i] = packed[a:b]
        for i in np.flatnonzero(~short).tolist():
            raw = np.frombuffer(coded[i], dtype=np.uint8)
            closes = np.r_[(raw[1:] & 0xC0) != 0x80, True]
            out[i] = self._alone(raw)[closes].astype("<i4").tobytes()
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        found = [self.known.get(w) for w in words]
        new = []
        for i, x in enumerate(found):
            if x is None:
                found[i] = self.older.get(words[i])
                if found[i] is None:
                    new.append(i)
        for i, packed in zip(new, self._learn([words[i] for i in new]) if new else [], strict=True):
            found[i] = packed
        # long words are few and not worth keeping
        self.known.update((w, x) for w, x in zip(words, found, strict=True) if len(w) <= LONG_WORD)
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without added tokens, from one character to the whole."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        first = np.zeros(len(points), dtype=bool)
        first[0] = True
        return self._counted(text, points, first, {})

    def _counted(self, text: str, points: np.ndarray, first: np.ndarray, added: dict[int, tuple[int, bool]]) -> np.ndarray:
        """Counts after each character of parts that ``first`` marks; ``added``: by the begin of each added token's
        part its end, and whether the part before it is ordinary text of the same document."""
        v, n = self.v, len(points)
        starts = v.word_starts(points, first)
        for begin, (end, _) in added.items():
            starts = starts[(starts <= begin) | (starts >= end)]
        kinds, number = bpe.distinct_words(points, starts)
        sizes = np.diff(np.r_[starts, n])
        space = v.classes[points] == bpe.SPACE
        # runs of white space, of which a prefix may end in any place
        opens = np.flatnonzero(space & np.r_[True, ~space[:-1] | first[1:]])
        shuts = np.flatnonzero(space & np.r_[~space[1:] | first[1:], True]) + 1
        long_run = shuts - opens > 1
        opens, shuts = opens[long_run], shuts[long_run]
        spans = list(zip(starts[kinds].tolist(), (starts + sizes)[kinds].tolist(), strict=True))
        words = [text[s:e] for s, e in spans]
        runs = sorted({text[s:e] for s, e in zip(opens.tolist(), shuts.tolist(), strict=True)})
        packed = self.of_words(words + runs)
        of_run = dict(zip(runs, packed[len(words) :], strict=True))
        packed = packed[: len(words)]
        lengths = np.array([len(x) // 4 for x in packed], dtype=np.int64)
        table = np.frombuffer(b"".join(packed), dtype="<i4")
        ends = np.cumsum(lengths)
        tokens = table[ends - 1][number].astype(np.int64)
        for begin in added:
            tokens[np.searchsorted(starts, begin)] = 1
        before = np.cumsum(tokens) - tokens
        within = table[bpe._gathered(ends - lengths, lengths, number)]
        counts = np.repeat(before, sizes) + within
        for begin, (end, _) in added.items():
            counts[end - 1] = (counts[begin - 1] if begin else 0) + 1
        for s, e in zip(opens.tolist(), shuts.tolist(), strict=True):
            base = counts[s - 1] if s else 0
            counts[s:e] = base + np.frombuffer(of_run[text[s:e]], dtype="<i4")
        # the endings of two letters: while one is missing, ' is a word and the letter another
        ending = np.flatnonzero((sizes == 3) & (points[starts] == ord("'")))
        ending = ending[np.isin(points[starts[ending] + 1], [ord(c) for c in "rvl"])]
        counts[starts[ending] + 1] = before[ending] + 2
        for begin, (end, joins) in added.items():
            self._inside_added(text, counts, first, begin, end, joins)
        return counts

    def _inside_added(self, text: str, counts: np.ndarray, first: np.ndarray, begin: int, end: int, joins: bool) -> None:
        """Prefixes that end within an added token: what stands of it is ordinary text, and joins what is before it."""
        at = begin
        while joins and self.v.classes[ord(text[at - 1])] in (bpe.SPACE, bpe.OTHER):
            at -= 1
            joins = not first[at]
        tail = self._plain(text[at : end - 1])
        counts[begin : end - 1] = (counts[at - 1] if at else 0) + tail[begin - at :]

    def prefixes(self, texts: list[str | None]) -> list[np.ndarray]:
        """Counts of the prefixes of each text, from one character to the whole."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, str, bool]] = []
        size = 0
        for i, text in enumerate(texts):
            for part, token in self.v.parts(text) if text else ():
                # an added token stays with the part before it, which its own prefixes may join
                if size >= CHUNK_CHARS and token < 0:
                    self._hold(held, out)
                    held, size = [], 0
                held.append((i, part, token >= 0))
                size += len(part)
        if held:
            self._hold(held, out)
        done = []
        for parts in out:
            base, sums = 0, []
            for x in parts:
                sums.append(x + base)
                base = int(sums[-1][-1])
            done.append(np.concatenate(sums) if sums else np.zeros(0, dtype=np.int64))
        return done

    def _hold(self, held: list[tuple[int, str, bool]], out: list[list[np.ndarray]]) -> None:
        whole = "".join(part for _, part, _ in held)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(part) for _, part, _ in held])
        begins = ends - [len(part) for _, part, _ in held]
        first = np.zeros(len(points), dtype=bool)
        first[begins] = True
        added = {
            int(begins[k]): (int(ends[k]), k > 0 and held[k - 1][0] == owner and not held[k - 1][2]) for k, (owner, _, token) in enumerate(held) if token
        }
        counts = self._counted(whole, points, first, added)
        owners = np.array([i for i, _, _ in held])
        edges = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        for k, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(owners)], strict=True):
            a, b = int(begins[k]), int(ends[stop - 1])
            out[int(owners[k])].append(counts[a:b] - (counts[a - 1] if a else 0))


@lru_cache(maxsize=1)
def load(path: str) -> Counter:
    return Counter(path)


def pack(counts: np.ndarray) -> bytes:
    steps = np.diff(counts, prepend=0)
    if len(steps) and (steps.min() < -128 or steps.max() > 127):
        return b"\x04" + steps.astype("<i4").tobytes()
    return b"\x01" + steps.astype("i1").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """Counts of the prefixes of 0, 1, 2, ... characters."""
    steps = np.frombuffer(packed, dtype="<i4" if packed[:1] == b"\x04" else "i1", offset=1)
    return np.r_[0, np.cumsum(steps, dtype=np.int64)]


def prefix_counts(df: DataFrame, text_col: str = "text", out: str = "prefix_tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a binary column ``out``: the token count of every prefix of the text (see the module)."""
    path = vocabulary or bpe.default_vocabulary()
    bpe._refuse(df, out)
    small_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(x) for x in load(path).prefixes(texts.tolist())], dtype=object)

    return df.withColumn(out, packed(F.col(text_col)))


def answers(df: DataFrame, budget: int, packed_col: str = "prefix_tokens", out: str = "tokens") -> DataFrame:
    """``df`` with a struct column ``out``: ``n_tokens`` of the whole text and ``n_within``, the characters of its longest prefix of ``budget`` tokens or fewer."""
    bpe._refuse(df, out)

    @F.pandas_udf("n_tokens long, n_within long")
    def read(packed: pd.Series) -> pd.DataFrame:
        rows = []
        for x in packed:
            counts = unpack(x)
            rows.append((int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])))
        return pd.DataFrame(rows, columns=["n_tokens", "n_within"])

    return df.withColumn(out, read(F.col(packed_col)))


def count_at(df: DataFrame, length_col: str, packed_col: str = "prefix_tokens", out: str = "n_tokens") -> DataFrame:
    """``df`` with the tokens of the prefix of ``length_col`` characters (beyond the text: of all of it; null: null)."""
    bpe._refuse(df, out)

    @F.pandas_udf("long")
    def read(packed: pd.Series, length: pd.Series) -> pd.Series:
        found = []
        for x, n in zip(packed, length, strict=True):
            counts = unpack(x)
            found.append(None if pd.isna(n) else int(counts[min(max(int(n), 0), len(counts) - 1)]))
        return pd.Series(found, dtype="Int64")

    return df.withColumn(out, read(F.col(packed_col), F.col(length_col)))


#: Tokens beyond which op12 calls a text too long.
LIMIT = 512


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = answers(prefix_counts(docs), LIMIT)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("tokens.n_tokens").alias("n_tokens"),
        (F.col("tokens.n_tokens") > LIMIT).alias("over_limit"),
        F.col("tokens.n_within").alias("n_chars_within_limit"),
    )
