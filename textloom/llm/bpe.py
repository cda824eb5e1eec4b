"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut at added tokens and into the vocabulary's words by the classes of their
characters, about ``CUT_CHARS`` at a time.  The index covers the distinct words of about
``CHUNK_CHARS`` of a partition's text that the worker has not met lately; those it has
come from a cache of bounded size.  The new words are laid out in one symbol array; an index maps each
mergeable pair to all its positions there.  Active ranks are applied in ascending
order: every occurrence of the pair is merged from left to right, and the lists of the
neighbouring pairs are updated.  A merge can only create pairs of higher rank (checked
when the vocabulary is loaded), so one ascending sweep over all those words equals the
per-word rule of lowest rank first.

Ids leave the encoder packed as little-endian unsigned 32-bit integers in a binary
column; ``unpack_ids`` makes an array of them.

Edge cases: a null text encodes like an empty one, to no ids, and decodes to the
empty string; null ids decode to the empty string.  Rows that repeat, an empty table
and columns of any name pass through unchanged; a column that has the name of the output
(a parameter) is refused.  Texts of any length are encoded whole, stretch by stretch, cut
where a word begins; one word of a million characters costs O(n log n).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.storage import small_batches

VOCABULARY = "byte_bpe_50k.json"
#: New words that a Python worker keeps before the older half of its cache is let go.
CACHE_WORDS = 200_000
#: Characters of text whose new words are indexed together.
CHUNK_CHARS = 4_000_000
#: Characters of text whose words are told apart together, with some 60 bytes of arrays each.
CUT_CHARS = 500_000
#: Words or ids whose stretches are gathered together.
CUT_IDS = 100_000
#: Characters after which a text is cut at the next white space (a word always begins there).
LONG_TEXT = 500_000
#: Ids that are decoded together.
CHUNK_IDS = 500_000
#: Positions from which a pair's list is merged with array operations.
SHORT_LIST = 64
#: Classes of characters: letters, numbers, white space, all others.
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Stand between words, and where a symbol was merged into the one before.
BETWEEN, GONE = -1, -2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return [shown[b] for b in range(256)]


class PairIndex:
    """One array of symbols, linked both ways, and the positions of each mergeable pair by rank.

    Long lists are merged with array operations and short ones in a loop; both work on
    the same memory."""

    def __init__(self, vocabulary: Vocabulary, raw: np.ndarray, symbols: np.ndarray):
        self.v, n = vocabulary, len(symbols)
        # array.array for the loop, a numpy view of it for the long lists
        self.sym, self.after, self.before = array("q", symbols.tobytes()), array("q", np.arange(1, n + 1).tobytes()), array("q", np.arange(-1, n - 1).tobytes())
        self.np_sym, self.np_after, self.np_before = (np.frombuffer(x, dtype=np.int64) for x in (self.sym, self.after, self.before))
        self.n = n
        self.lists: dict[int, list] = {}
        self.active: list[int] = []
        at = np.flatnonzero(vocabulary.byte_rank[raw[:-1], raw[1:]] >= 0)
        at = at[(symbols[at] != BETWEEN) & (symbols[at + 1] != BETWEEN)]
        self._enter(vocabulary.byte_rank[raw[at], raw[at + 1]], at)

    def _enter(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Add positions to the lists of their ranks (-1: not a mergeable pair)."""
        has = ranks >= 0
        ranks, positions = ranks[has].astype(self.v.rank_type), positions[has]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        edges = [*starts.tolist(), len(ranks)]
        for i, r in enumerate(ranks[starts].tolist()):
            self._list(r).append(positions[edges[i] : edges[i + 1]])

    def _list(self, r: int) -> list:
        found = self.lists.get(r)
        if found is None:
            found = self.lists[r] = []
            heappush(self.active, r)
        return found

    def sweep(self) -> np.ndarray:
        """Apply the active ranks in ascending order; the symbols left, GONE where one was merged away."""
        while self.active:
            r = heappop(self.active)
            parts = self.lists.pop(r)
            size = sum(1 if isinstance(x, int) else len(x) for x in parts)
            if size < SHORT_LIST:
                positions: list[int] = []
                for x in parts:
                    if isinstance(x, int):
                        positions.append(x)
                    else:
                        positions += x.tolist()
                self._merge_few(r, sorted(positions))
            else:
                few = np.array([x for x in parts if isinstance(x, int)], dtype=np.int64)
                i = np.sort(np.concatenate([few, *[x for x in parts if not isinstance(x, int)]]))
                self._merge_many(r, i[np.r_[True, i[1:] != i[:-1]]])
        return self.np_sym

    def _merge_few(self, r: int, positions: list[int]) -> None:
        sym, after, before, rank, n = self.sym, self.after, self.before, self.v.rank, self.n
        (left, right), whole = self.v.pairs[r], self.v.product[r]
        for i in positions:
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # a part went into another merge
            k = after[j]
            sym[i], sym[j] = whole, GONE
            after[i] = k
            if k < n:
                before[k] = i
                x = rank.get((whole, sym[k]))
                if x is not None:
                    self._list(x).append(i)
            h = before[i]
            if h >= 0:
                x = rank.get((sym[h], whole))
                if x is not None:
                    self._list(x).append(h)

    def _merge_many(self, r: int, i: np.ndarray) -> None:
        sym, after, before = self.np_sym, self.np_after, self.np_before
        (left, right), whole = self.v.pairs[r], self.v.product[r]
        i = i[sym[i] == left]
        j = after[i]
        fits = j < self.n
        i, j = i[fits], j[fits]
        fits = sym[j] == right
        i, j = i[fits], j[fits]
        if left == right and len(i):
            # of overlapping pairs in a run, every second is merged, from the left
            begins = np.r_[True, j[:-1] != i[1:]]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(i)), 0))
            odd = (np.arange(len(i)) - first) % 2 == 0
            i, j = i[odd], j[odd]
        if not len(i):
            return
        k = after[j]
        sym[i], sym[j] = whole, GONE
        after[i] = k
        inside = k < self.n
        before[k[inside]] = i[inside]
        h = before[i]
        led = h >= 0
        lefts = np.concatenate([i[inside], h[led]])
        self._enter(self.v.ranks_of(sym[lefts], sym[after[lefts]]), lefts)


class Vocabulary:
    """Symbols, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["model"]["type"] != "BPE":
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.classes = np.full(0x110000, OTHER, dtype=np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run in regex.finditer(pattern, every):
                self.classes[run.start() : run.end()] = number
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.byte_id = np.array([ids[c] for c in letters], dtype=np.int64)
        of_letter = {c: b for b, c in enumerate(letters)}
        self.rank: dict[tuple[int, int], int] = {}
        self.product: list[int] = []
        made: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = ids[a], ids[b], ids[a + b]
            if made.get(left, -1) >= r or made.get(right, -1) >= r or whole in made:
                raise ValueError("a merge comes before its parts")
            made[whole] = r
            self.rank[left, right] = r
            self.product.append(whole)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not handled")
        self.added_packed = [np.uint32(i).tobytes() for i in self.added.values()]
        self.added_number = {i: k - len(self.added) for k, i in enumerate(self.added.values())}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.next_word = regex.compile(r"(?<=\S)\s").search
        self.bytes_of: dict[int, bytes] = {i: bytes(of_letter[c] for c in s) for s, i in ids.items() if all(c in of_letter for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.pairs = list(self.rank)
        codes = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        self._order = np.argsort(codes)
        self._codes = codes[self._order]
        # ranks of pairs of bytes, which every sweep starts from
        self.byte_rank = np.full((256, 256), -1, dtype=np.int32)
        of_id = {i: b for b, i in enumerate(self.byte_id.tolist())}
        for r, (a, b) in enumerate(self.pairs):
            if a in of_id and b in of_id:
                self.byte_rank[of_id[a], of_id[b]] = r
        self.rank_type = np.uint16 if len(self.pairs) <= 1 << 16 else np.int32
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.table = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in table], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 if it has none."""
        code = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._order[at], -1)

    def learn(self, words: list[str]) -> list[bytes]:
        """The packed ids of ``words``, by one sweep over the pair index."""
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(x) + 1 for x in raw])
        joined = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        symbols = self.byte_id[joined]
        symbols[ends - 1] = BETWEEN
        merged = PairIndex(self, joined, symbols).sweep()
        kept = merged >= 0
        packed = merged[kept].astype("<u4").tobytes()
        last = (np.cumsum(kept)[ends - 1] * 4).tolist()
        return list(map(packed.__getitem__, map(slice, [0, *last[:-1]], last)))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words, from the cache or learnt now."""
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = []
            for i in missing:
                found[i] = self.older.get(words[i])
                if found[i] is None:
                    new.append(i)
            for i, packed in zip(new, self.learn([words[i] for i in new]) if new else [], strict=True):
                found[i] = packed
            self.known.update((words[i], found[i]) for i in missing)
            if len(self.known) > CACHE_WORDS:
                self.known, self.older = {}, self.known
        return found

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """A text as parts that no word crosses, with the id of those that are added tokens (else -1)."""
        pieces = self.cut(text) if self.cut and any(s in text for s in self.added) else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield piece, self.added[piece]
                continue
            at = 0
            while len(piece) - at > LONG_TEXT and (space := self.next_word(piece, at + LONG_TEXT)):
                yield piece[at : space.start()], -1
                at = space.start()
            if at < len(piece):
                yield piece[at:], -1

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of the byte-level pre-tokenizer begin; ``first`` marks the first characters of parts.

        Words are runs of letters, of numbers or of other characters, each with a space before it if there
        is one, the endings listed below, and what is left of white space."""
        n = len(points)
        kind = self.classes[points]
        new = np.r_[True, kind[1:] != kind[:-1]] | first
        # white space before another character: the last one goes with what follows if it is a space, else stands alone
        ends = np.flatnonzero(new[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
        new[ends - 1] = True
        new[ends[points[ends - 1] == ord(" ")]] = False
        # fixed values: the endings 's 't 'm 'd 're 've 'll
        marks = np.flatnonzero((points[:-1] == ord("'")) & new[:-1] & ~first[1:])
        if len(marks):
            after = points[marks + 1]
            one = np.isin(after, [ord(c) for c in "stmd"])
            two = np.zeros(len(marks), dtype=bool)
            inside = np.flatnonzero(marks + 2 < n)
            at = marks[inside] + 2
            pair = after[inside].astype(np.int64) << 32 | points[at]
            two[inside] = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & ~first[at]
            for hit, size in ((one, 2), (two, 3)):
                begin = marks[hit]
                new[begin + 1] = False
                stop = begin + size
                new[stop[stop < n]] = True
        return np.flatnonzero(new)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts; about CUT_CHARS are cut into words, and the new words of about CHUNK_CHARS indexed, at once."""
        out: list[list[bytes]] = [[] for _ in texts]
        words: dict[str, int] = {}
        cuts: list[tuple[list[int], np.ndarray, list[int]]] = []
        owner: list[int] = []
        held: list[str] = []
        added: list[int] = []
        size = total = 0
        for i, text in enumerate(texts):
            for part, token in self.parts(text) if text else ():
                owner.append(i)
                held.append(part)
                added.append(token)
                size += len(part)
                if size >= min(CUT_CHARS, CHUNK_CHARS):
                    cuts.append((owner, *self._numbered(held, added, words)))
                    total += size
                    owner, held, added, size = [], [], [], 0
                if total >= CHUNK_CHARS:
                    self._encode_cuts(cuts, words, out)
                    words, cuts, total = {}, [], 0
        if held:
            cuts.append((owner, *self._numbered(held, added, words)))
        if cuts:
            self._encode_cuts(cuts, words, out)
        return [b"".join(x) for x in out]

    def _numbered(self, held: list[str], added: list[int], words: dict[str, int]) -> tuple[np.ndarray, list[int]]:
        """The number in ``words``, which grows, of each word of the parts, and where each part's begin and the last one's end.

        Added tokens count from -1 down: their text may be a word elsewhere, cut in another way."""
        whole = "".join(held)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(x) for x in held])
        begins = np.r_[0, ends[:-1]]
        first = np.zeros(len(points), dtype=bool)
        first[begins] = True
        starts = self.word_starts(points, first)
        tokens = [i for i, token in enumerate(added) if token >= 0]
        for i in tokens:
            starts = starts[(starts <= begins[i]) | (starts >= ends[i])]
        kinds, number = distinct_words(points, starts)
        stops = np.r_[starts[1:], len(points)]
        spans = zip(starts[kinds].tolist(), stops[kinds].tolist(), strict=True)
        number = np.array([words.setdefault(whole[s:e], len(words)) for s, e in spans], dtype=np.int32)[number]
        for i in tokens:
            number[np.searchsorted(starts, begins[i])] = self.added_number[added[i]]
        return number, np.searchsorted(starts, np.r_[begins, len(points)]).tolist()

    def _encode_cuts(self, cuts: list[tuple[list[int], np.ndarray, list[int]]], words: dict[str, int], out: list[list[bytes]]) -> None:
        packed = [*self.ids_of(list(words)), *self.added_packed]
        counts = np.array([len(x) // 4 for x in packed], dtype=np.int64)
        places = np.cumsum(counts) - counts
        every = np.frombuffer(b"".join(packed), dtype="<u4")
        for owner, number, edges in cuts:
            ids = _joined(every, places, counts, number)
            upto = np.r_[0, np.cumsum(counts[number])]
            at = (upto[edges] * 4).tolist()
            for i, a, b in zip(owner, at[:-1], at[1:], strict=True):
                out[i].append(ids[a:b])

    def decode(self, packed: bytes) -> str:
        return self.decode_all([packed])[0]

    def decode_all(self, packed: list[bytes | None]) -> list[str]:
        """Texts of packed ids; bytes that are no text in UTF-8 are shown as U+FFFD."""
        out: list[str] = []
        held: list[bytes] = []
        size = 0
        for i, one in enumerate(packed):
            held.append(one or b"")
            size += len(held[-1]) // 4
            if size >= CHUNK_IDS or i + 1 == len(packed):
                ids = np.frombuffer(b"".join(held), dtype="<u4")
                raw = _joined(self.table, self.places, self.sizes, ids)
                upto = np.r_[0, np.cumsum(self.sizes[ids])]
                edges = upto[np.r_[0, np.cumsum([len(x) // 4 for x in held])]].tolist()
                out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
                held, size = [], 0
        return out


def _gathered(places: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Indices of the stretches ``picks``, one after the other, of stretches given by place and size."""
    own = sizes[picks]
    shift = places[picks] - (np.cumsum(own) - own)
    return np.repeat(shift, own) + np.arange(int(own.sum()))


def _joined(data: np.ndarray, places: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> bytes:
    """The bytes of those stretches of ``data``, with an index over CUT_IDS of them at a time."""
    return b"".join(data[_gathered(places, sizes, picks[a : a + CUT_IDS])].tobytes() for a in range(0, len(picks), CUT_IDS))


def distinct_words(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place in ``starts`` of each distinct word, and the number of its word for each start.

    Words are sorted by a rolling hash and then compared with their first fellow, character by character."""
    n = len(points)
    ends = np.r_[starts[1:], n]
    power, inverse = _hash_powers(1 << (n - 1).bit_length() if n > 1 else 1)
    with np.errstate(over="ignore"):
        value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(29)
        value *= power[:n]
        sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        digest = (sums[ends] - sums[starts]) * inverse[starts]
    order = np.argsort(digest)
    ranked = digest[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    number = np.empty(len(starts), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    kinds = order[fresh]
    sizes = ends - starts
    fellow = kinds[number]
    if (sizes == sizes[fellow]).all() and (points[np.arange(n) + np.repeat(starts[fellow] - starts, sizes)] == points).all():
        return kinds, number
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(points[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends, strict=True)], dtype=np.int64)
    return np.unique(number, return_index=True)[1], number


@lru_cache(maxsize=1)
def _hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    both = []
    for b in (base, pow(base, -1, 2**64)):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _refuse(df: DataFrame, out: str) -> None:
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out} already: name another for the output")


def encode(df: DataFrame, text_col: str = "text", out: str = "ids_packed", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a binary column ``out``: ids as little-endian unsigned 32-bit integers."""
    path = vocabulary or default_vocabulary()
    _refuse(df, out)
    small_batches(df.sparkSession)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        v = load(path)
        return pd.Series(v.encode_all(texts.tolist()), dtype=object)

    return df.withColumn(out, packed(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "ids_packed", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a string column ``out`` decoded from packed ids, special tokens kept."""
    path = vocabulary or default_vocabulary()
    _refuse(df, out)
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = load(path)
        return pd.Series(v.decode_all(ids.tolist()), dtype=object)

    return df.withColumn(out, text(F.col(ids_col)))


def encode_decode(df: DataFrame, text_col: str = "text", out: str = "encoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with a struct column ``out`` of ``ids_packed`` and the text ``decoded`` from them.

    Texts are encoded once.  Where the ids of an ``encode`` are read beside a ``decode`` of them, Spark chains
    the two functions in one node and encodes every text twice."""
    path = vocabulary or default_vocabulary()
    _refuse(df, out)
    small_batches(df.sparkSession)

    @F.pandas_udf("ids_packed binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        v = load(path)
        packed = v.encode_all(texts.tolist())
        return pd.DataFrame({"ids_packed": pd.Series(packed, dtype=object), "decoded": pd.Series(v.decode_all(packed), dtype=object)})

    return df.withColumn(out, both(F.col(text_col)))


def unpack_ids(packed: Column) -> Column:
    """The ids of a packed column as an array of long."""
    n = (F.octet_length(packed) / 4).cast("int")
    pick = lambda i, k: F.conv(F.hex(F.substring(packed, i * 4 + k, 1)), 16, 10).cast("long")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: pick(i, 1) + pick(i, 2) * 256 + pick(i, 3) * 65536 + pick(i, 4) * 16777216)
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(ids)


def digests(docs: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """``carried`` columns with the number of ids, the digest of the ids and that of the text decoded from them."""
    return encode_decode(docs, text_col).select(
        *carried,
        (F.octet_length("encoded.ids_packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("encoded.ids_packed", 256).alias("ids_sha256"),
        F.sha2(F.col("encoded.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
