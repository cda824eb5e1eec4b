"""Phrases whose words stand together more often than apart, by suffix arrays of word ids.

Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into
words at spaces and tabs.  A task numbers the words of a shard of its texts, sorts the
positions by the words that follow them (prefix doubling: ranks by one word, by two, by
four, as far as the longest phrase), and reads n-gram counts from the intervals of the
suffix array in which neighbours share n words or more.  The counts of the shards are
merged by key.

That is done twice.  The first pass merges 64-bit hashes of words and pairs of words
only; those that reach ``least`` are set in a bitmap of bounded size.  The second pass
merges the phrases themselves, but only n-grams whose words and pairs are all in the
bitmap: a phrase cannot be more frequent than its parts.  A false hit of the bitmap costs a
row, no result depends on it; beyond ``MOST_KEYS`` frequent keys there is no bitmap and
the second pass merges every n-gram.

Edge cases: null and empty texts hold no words; a null language is ``und``, one with the
text of that one.  Repeated rows count again.  An empty table, or one without a frequent
phrase, gives no rows.  Only the two named columns are read.  Long texts are
cut at piece borders, where no phrase crosses; memory grows with the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, shuffle_partitions, small_batches

#: Words of a shard.
SHARD_WORDS = 800_000
#: Bytes of text whose words are told apart together.
BLOCK_BYTES = 1_000_000
#: Rows that leave a task together.
OUT_ROWS = 50_000
#: Words of the longest phrase.
WORDS = 3
#: Bits of the bitmap for each key, and the keys up to which there is one (64 MB).
KEY_BITS = 16
MOST_KEYS = 1 << 27
MOST_BITS = 1 << 29
#: Bits of a stretch of the bitmap that one group of keys makes (a power of two).
CHUNK_BITS = 1 << 19
UNKNOWN = "und"
#: Parts of a language's phrases that are ranked on their own before its first ``most`` are.
RANK_PARTS = 32
# fixed values: what ends a piece, and what parts words
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_LOWER = bytes(0x0A if b in ENDS else 0x20 if b in BLANKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_KIND = np.array([1 if b in ENDS else 2 if b in BLANKS else 0 for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shard:
    """The words of some texts in order, numbered by language and spelling."""

    def __init__(self) -> None:
        number = count()
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.ids: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, block: bytes) -> None:
        """Words of a block of lower-cased text that ends where a piece ends."""
        kind = _KIND[np.frombuffer(block, dtype=np.uint8)]
        starts = np.flatnonzero((kind == 0) & np.r_[True, kind[:-1] != 0])
        if not len(starts):
            return
        self.ids.append(np.fromiter(map(self.numbers[lang].__getitem__, block.split()), dtype=np.int32, count=len(starts)))
        piece = np.cumsum(kind == 1, dtype=np.int32)[starts]
        last = np.flatnonzero(np.r_[piece[1:] != piece[:-1], True])
        # words from each one to the end of its piece, as far as a phrase can reach
        self.rest.append(np.minimum(np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(len(starts)) + 1, WORDS).astype(np.int8))
        self.size += len(starts)

    def words(self) -> tuple[list[str], list[bytes]]:
        """Language and spelling by number."""
        n = sum(map(len, self.numbers.values()))
        langs, found = [""] * n, [b""] * n
        for lang, own in self.numbers.items():
            for word, i in own.items():
                langs[i], found[i] = lang, word
        return langs, found


def shards(frames: Iterator[pd.DataFrame]) -> Iterator[Shard]:
    """Shards of about ``SHARD_WORDS`` words from batches of (lang, text)."""
    shard = Shard()
    for frame in frames:
        for lang, texts in frame.groupby("lang", sort=False)["text"]:
            raw = "\n".join(texts).encode().translate(_LOWER) + b"\n"
            at = 0
            while at < len(raw):
                # a piece longer than a block stays whole
                stop = raw.rfind(b"\n", at, at + BLOCK_BYTES) + 1 or raw.find(b"\n", at + BLOCK_BYTES) + 1
                shard.add(lang, raw[at:stop])
                at = stop
                if shard.size >= SHARD_WORDS:
                    full, shard = shard, Shard()
                    yield full
                    del full
    if shard.size:
        yield shard


def suffix_array(ids: np.ndarray, rest: np.ndarray, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions sorted by the up to ``words`` words that follow, and the ranks by 1, 2, 4, ... words.

    Prefix doubling: the rank by 2h words is that of the pair of ranks by h words, here and h words on; a
    piece that ends before counts as the lowest."""
    ranks = [ids]
    h = 1
    order = np.argsort(ranks[0], kind="stable")
    while h < words:
        own = ranks[-1]
        key = own.astype(np.int64) * (int(own.max()) + 2)
        inside = np.flatnonzero(rest > h)
        key[inside] += own[inside + h] + 1
        order = np.argsort(key, kind="stable")
        fresh = key[order]
        rank = np.empty(len(own), dtype=np.int32)
        rank[order] = np.cumsum(np.r_[False, fresh[1:] != fresh[:-1]], dtype=np.int32)
        ranks.append(rank)
        h *= 2
    return order, ranks


def shared_words(order: np.ndarray, ranks: list[np.ndarray], rest: np.ndarray, words: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in the suffix array, ``words`` at most."""
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(b), dtype=np.int8)
    for h in range(len(ranks) - 1, -1, -1):
        step = 1 << h
        # binary lifting: as many words on as are shared already
        fits = np.flatnonzero((rest[a] >= shared + step) & (rest[b] >= shared + step))
        x, y = a[fits] + shared[fits], b[fits] + shared[fits]
        shared[fits[ranks[h][x] == ranks[h][y]]] += step
    return np.r_[np.int8(0), np.minimum(shared, words)]


def intervals(order: np.ndarray, shared: np.ndarray, rest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, count) of each distinct n-gram: runs of suffixes that share ``n`` words or more."""
    has = rest[order] >= n
    begins = np.flatnonzero(has & (shared < n))
    upto = np.r_[0, np.cumsum(has)]
    # suffixes too short for n words stand between runs and are in none
    return order[begins], np.diff(np.r_[upto[begins], upto[-1]])


def _hashes(shard: Shard) -> np.ndarray:
    langs, words = shard.words()
    seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in shard.numbers}
    return np.array([xxhash.xxh3_64_intdigest(w, seeds[lang]) for lang, w in zip(langs, words, strict=True)], dtype=np.uint64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b))


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First pass: (h, c) of the words and pairs of words of each shard."""
    for shard in shards(frames):
        yield from _keys_of(shard)
        del shard


def _keys_of(shard: Shard) -> Iterator[pd.DataFrame]:
    ids, rest = np.concatenate(shard.ids), np.concatenate(shard.rest)
    own = _hashes(shard)
    order, ranks = suffix_array(ids, rest, 2)
    shared = shared_words(order, ranks, rest, 2)
    one, times = intervals(order, shared, rest, 1)
    two, pair_times = intervals(order, shared, rest, 2)
    h = np.concatenate([own[ids[one]], _pair(own[ids[two]], own[ids[two + 1]])]).view(np.int64)
    c = np.concatenate([times, pair_times])
    for i in range(0, len(h), OUT_ROWS):
        yield pd.DataFrame({"h": h[i : i + OUT_ROWS], "c": c[i : i + OUT_ROWS]})


class Bitmap:
    """Membership of hashes, with false hits but no misses."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def _set(self, slot: np.ndarray) -> np.ndarray:
        return self.packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        return (self._set((h & mask).astype(np.int64)) & self._set(((h >> np.uint64(32)) & mask).astype(np.int64))).astype(bool)


def bitmap(keys: DataFrame) -> Bitmap | None:
    """The hashes of column ``h`` as a bitmap; none where they are too many for it to help.

    Stretches of it are made by groups of keys; at most ``MOST_BITS`` bits come to the driver."""
    n = keys.count()
    if n > MOST_KEYS:
        return None
    bits = min(MOST_BITS, max(CHUNK_BITS, 1 << (n * KEY_BITS - 1).bit_length() if n else 0))
    mask = F.lit(bits - 1)
    slots = keys.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("slot"))

    def stretch(chunk: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(CHUNK_BITS, dtype=np.uint8)
        held[frame["slot"].to_numpy() & (CHUNK_BITS - 1)] = 1
        return pd.DataFrame({"chunk": [int(chunk[0])], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    chunks = slots.withColumn("chunk", (F.col("slot") / CHUNK_BITS).cast("int")).groupBy("chunk").applyInPandas(stretch, "chunk int, bits binary")
    packed = np.zeros(bits >> 3, dtype=np.uint8)
    size = CHUNK_BITS >> 3
    for row in chunks.toLocalIterator():
        packed[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(row.bits, dtype=np.uint8)
    return Bitmap(bits, packed)


def _phrases(frames: Iterator[pd.DataFrame], frequent: Bitmap | None) -> Iterator[pd.DataFrame]:
    """Second pass: (lang, n, phrase, c) of the n-grams of each shard whose words and pairs are all
    frequent by the bitmap; n = 0 has the number of all words."""
    for shard in shards(frames):
        yield from _phrases_of(shard, frequent)
        del shard


def _phrases_of(shard: Shard, frequent: Bitmap | None) -> Iterator[pd.DataFrame]:
    ids, rest = np.concatenate(shard.ids), np.concatenate(shard.rest)
    langs, spelt = shard.words()
    lang_of = np.array(langs, dtype=object)
    words = np.array([w.decode() for w in spelt], dtype=object)
    order, ranks = suffix_array(ids, rest, WORDS)
    shared = shared_words(order, ranks, rest, WORDS)
    del ranks
    if frequent is not None:
        own = _hashes(shard)
        good = frequent.has(own)[ids]
        pair = np.zeros(len(ids), dtype=bool)
        at = np.flatnonzero((rest > 1) & good)
        at = at[good[at + 1]]
        pair[at] = frequent.has(_pair(own[ids[at]], own[ids[at + 1]]))
    for n in range(1, WORDS + 1):
        place, times = intervals(order, shared, rest, n)
        if n == 1:
            for lang in shard.numbers:
                yield pd.DataFrame({"lang": [lang], "n": [0], "phrase": [""], "c": [int(times[lang_of[ids[place]] == lang].sum())]})
        if frequent is not None:
            keep = good[place] if n == 1 else np.logical_and.reduce([pair[place + k] for k in range(n - 1)])
            place, times = place[keep], times[keep]
        for i in range(0, len(place), OUT_ROWS):
            p = place[i : i + OUT_ROWS]
            phrase = words[ids[p]]
            for k in range(1, n):
                phrase = phrase + " " + words[ids[p + k]]
            yield pd.DataFrame({"lang": lang_of[ids[p]], "n": np.full(len(p), n, dtype=np.int32), "phrase": phrase, "c": times[i : i + OUT_ROWS]})


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10) -> DataFrame:
    """(lang, n, phrase, c): n-grams of 1 to ``WORDS`` words that occur ``least`` times or more in a
    language, and with n = 0 the number of its words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    keys = texts.mapInPandas(_keys, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h")
    shared = spark.sparkContext.broadcast(bitmap(save(keys, "phrase-keys")))
    rows = texts.mapInPandas(lambda frames: _phrases(frames, shared.value), "lang string, n int, phrase string, c long")
    return save(rows.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c")).where((F.col("n") == 0) | (F.col("c") >= least)), "phrase-counts")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals, since the products pass 64 bits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.expr("cast(1000000 as decimal(7,0))") * (wide(a) * wide(a)), wide(left) * wide(right)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``most`` phrases of 2 to ``WORDS`` words.

    A phrase within a longer one that has ``share`` percent of its occurrences is left out."""
    spark = docs.sparkSession
    counts = frequent_phrases(docs, text_col, lang_col, least)
    c = F.col
    candidates = counts.where("n > 1").select("lang", "phrase", c("c").alias("a"), F.split("phrase", " ", -1).alias("words"))
    part = lambda i, n: F.array_join(F.slice(c("words"), i, n), " ")
    # a phrase within a longer one: its most frequent extension
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(WORDS - 1)), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: part(i, n))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_in = candidates.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * c("longer") < share * c("a"), F.lit(True)))
    cuts = left_in.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), c("k")).alias("first"), part(c("k") + 1, F.size("words") - c("k")).alias("second")
    )
    known = lambda name, out: counts.where("n > 0").select("lang", c("phrase").alias(name), c("c").alias(out))
    parted = cuts.join(known("first", "l"), ["lang", "first"]).join(known("second", "r"), ["lang", "second"])
    over, under = _score(c("a"), c("l"), c("r"))
    scored = parted.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    flat = best.select("lang", "phrase", "a", c("cut.l").alias("l"), c("cut.r").alias("r"), c("cut.score").alias("score"))
    by = [c("score").desc(), c("a").desc(), c("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = flat.withColumn("part", parts).withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*by))).where(c("place") <= most)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by)).cast("long")).where(c("rank") <= most)
    totals = counts.where("n = 0").select("lang", c("c").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE_SQL = """WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) >= 3),
f AS (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND c >= 10),
longer AS (SELECT lang, phrase, max(a) AS b FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM cand WHERE m = 3) GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, 1 AS k, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM cand UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE m = 3),
scored AS (SELECT cuts.*, p.c AS l, q.c AS r, (1000000::HUGEINT * a * a // (p.c::HUGEINT * q.c))::BIGINT AS score FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
best AS (SELECT * FROM scored LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a QUALIFY row_number() OVER (PARTITION BY scored.lang, scored.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""
