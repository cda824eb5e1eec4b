"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public byte-level
vocabulary.  The likelihood of a word (a run of letters, lower-cased, with a leading
space) is the sum, over all its segmentations into pieces, of the product of the
pieces' probabilities, which a forward pass over the word's bytes adds up.  A text's
score is the sum of its words' log likelihoods; the predicted language is the one with
the highest, and ``score`` is its share of the posterior under equal priors.

Training starts from the frequency of each piece as a substring and runs ``rounds`` of
expectation maximisation: a forward-backward pass gives each piece's expected count.
It sees at most about ``per_language`` documents of each language (drawn by a hash of
the id; the bound is a parameter), of those whose id is not held out and whose language
is known.  Word counts and expected counts are aggregated by Spark; what reaches the
driver is one probability per language and piece.

Words are scored whole, whatever their length: the forward pass is scaled anew every
``BLOCK`` bytes, and pieces across such a place count like others, so nothing underflows and
no segmentation is left out.  Pieces with anything but a space before letters are not
part of a word and are passed over.  Memory grows with the longest word of a batch.

Edge cases: a text that is null or without a letter is ``und`` with score 0.  A null id
is neither held out nor learnt from.  Ties go to the language that sorts first.  If
nothing can be learnt, all is ``und``.  Rows that repeat are scored alike.  Columns of
``predict`` are carried through; one with the name of its output (a parameter) is refused.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.storage import save, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PER_LANGUAGE = 1000
ROUNDS = 2
#: Bytes after which a forward pass is scaled anew, and numbers that its arrays may hold.
BLOCK, CELLS = 32, 4_000_000
#: Words whose scores a Python worker keeps before those not met lately are let go.
CACHE_WORDS = 200_000
#: Expected count that every piece starts with.
SMOOTHING = 0.01
UNKNOWN = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Lattice:
    """All segmentations of words into pieces of a vocabulary of byte strings."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            lines = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        self.n = len(lines)
        self.pieces = {piece: i for i, piece in enumerate(lines) if not any(c < 128 and not chr(c).isalpha() for c in piece.removeprefix(b" "))}
        # the pieces of each length, by hash
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for size in range(1, max(map(len, self.pieces)) + 1):
            own = [p for p in self.pieces if len(p) == size]
            rows = np.frombuffer(b"".join(own), dtype=np.uint8).reshape(len(own), size)
            rolled = np.zeros(len(own), dtype=np.uint64)
            for j in range(size):
                rolled = _longer(rolled, rows[:, j])
            keys = _mixed(rolled)
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(own):
                raise ValueError("two pieces have one hash")
            self.by_length.append((keys[order], np.array([self.pieces[own[i]] for i in order], dtype=np.int32)))
        self.words = regex.compile(r"\p{L}+").findall

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The length of each word in bytes; edges: word, begin, end, piece.

        All substrings of a length are looked up at once, by hash."""
        raw = [(" " + word).encode() for word in words]
        length = np.array([len(x) for x in raw], dtype=np.int32)
        points = np.frombuffer(b"".join(raw), dtype=np.uint8)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), length)
        place = np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)
        left = length[word] - place
        at, rolled = np.arange(len(points)), np.zeros(len(points), dtype=np.uint64)
        begins, sizes, pieces = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for size, (keys, numbers) in enumerate(self.by_length, 1):
            fits = left[at] >= size
            at = at[fits]
            rolled = _longer(rolled[fits], points[at + size - 1])
            if not len(keys):
                continue
            h = _mixed(rolled)
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h
            begins.append(at[hit])
            sizes.append(np.full(int(hit.sum()), size, dtype=np.int32))
            pieces.append(numbers[i[hit]])
        from_ = np.concatenate(begins)
        begin = place[from_].astype(np.int32)
        return length, word[from_], begin, begin + np.concatenate(sizes), np.concatenate(pieces)

    def forward(self, length: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[word, place, language] and scale[word, block, language]: the log of what alpha was divided by there.

        ``weight``: probability of each edge's piece by language.  Every byte is a piece, so no place is without a path."""
        places = int(length.max(initial=0)) + 1
        alpha = np.zeros((len(length), places, weight.shape[1]))
        scale = np.zeros((len(length), _block(places) + 1, weight.shape[1]))
        alpha[:, 0] = 1.0
        last = 0
        for place, edges in _by_place(end, 1, places):
            block = _block(place)
            own, origin = at[edges], begin[edges]
            if block > last:
                before = alpha[:, block * BLOCK]
                scale[:, block] = scale[:, last] + np.log(np.where(before > 0, before, 1.0))
                last = block
            part = alpha[own, origin]
            if block:
                across = np.flatnonzero(_block(origin) < block)
                o = own[across]
                part[across] = np.exp(np.log(part[across]) + scale[o, _block(origin[across])] - scale[o, block])
            np.add.at(alpha, (own, place), part * weight[edges])
        return alpha, scale

    def backward(self, length: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the ends of the words: beta[word, bytes after the place, language] and its scale."""
        return self.forward(length, at, length[at] - end, length[at] - begin, weight)

    def likelihoods(self, length: np.ndarray, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The log of the sum over all segmentations of each word, by language."""
        each = np.arange(len(length))
        return np.log(alpha[each, length]) + scale[each, _block(length)]

    def expected(self, length: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each edge is part of a segmentation drawn in proportion to its probability."""
        alpha, a = self.forward(length, at, begin, end, weight)
        beta, b = self.backward(length, at, begin, end, weight)
        left = length[at] - end
        log = np.log(alpha[at, begin]) + a[at, _block(begin)] + np.log(weight) + np.log(beta[at, left]) + b[at, _block(left)]
        return np.exp(log - self.likelihoods(length, alpha, a)[at])


def _longer(rolled: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one byte longer."""
    with np.errstate(over="ignore"):
        return rolled * np.uint64(0x9E3779B97F4A7C15) + points + np.uint64(1)


def _mixed(rolled: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def _block(place):
    """The block of a place: 1..BLOCK are of the first, with place 0."""
    return np.maximum(place - 1, 0) // BLOCK


def batches(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """Places of the words by length, as many at once as CELLS allows."""
    size = np.array([2 + 4 * len(w) for w in words])
    order = np.argsort(size, kind="stable")
    while len(order):
        # the last is the longest
        room = np.flatnonzero(np.arange(1, len(order) + 1) * size[order] * langs > CELLS)
        n = max(1, int(room[0])) if len(room) else len(order)
        yield order[:n]
        order = order[n:]


def _by_place(places: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(places, kind="stable")
    bounds = np.searchsorted(places[order], np.arange(low, high + 1))
    for i, place in enumerate(range(low, high)):
        if bounds[i] < bounds[i + 1]:
            yield place, order[bounds[i] : bounds[i + 1]]


@lru_cache(maxsize=2)
def load(path: str) -> Lattice:
    return Lattice(path)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_words(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, word, n) over a bounded, hashed draw of the documents that may be learnt from."""
    allowed = F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()
    # a row per language
    sizes = {r[0]: r[1] for r in docs.where(allowed).groupBy(lang_col).count().collect()}
    rate = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        rate = F.when(F.col(lang_col) == lang, min(1.0, per_language / n)).otherwise(rate)
    u = F.shiftrightunsigned(F.xxhash64(F.lit("language"), F.col(id_col)), 11) / F.lit(float(2**53))
    drawn = docs.where(allowed & (u < rate))
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\p{L}+"), F.lit(0)))
    return drawn.select(F.col(lang_col).alias("lang"), words.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    rounds: int = ROUNDS,
    vocabulary: str | None = None,
) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each piece by language, as (pieces, languages)."""
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    words = save(training_words(docs, id_col, text_col, lang_col, per_language), "language-words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    size = load(path).n
    if not langs:
        return [], np.zeros((size, 0))
    number = {lang: i for i, lang in enumerate(langs)}
    model: np.ndarray | None = None
    for _ in range(rounds + 1):
        known = words.sparkSession.sparkContext.broadcast(model)

        def expected(frames: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            lattice = load(path)
            for frame in frames:
                for part in batches(frame["word"].tolist(), len(langs)):
                    own = frame.iloc[part]
                    length, at, begin, end, piece = lattice.edges(own["word"].tolist())
                    lang = own["lang"].map(number).to_numpy()[at]
                    count = own["n"].to_numpy(dtype=float)[at]
                    if known.value is not None:
                        count = count * lattice.expected(length, at, begin, end, known.value[piece, lang][:, None])[:, 0]
                    keys, place = np.unique(lang.astype(np.int64) * size + piece, return_inverse=True)
                    yield pd.DataFrame({"lang": keys // size, "piece": keys % size, "n": np.bincount(place, count)})

        counts = words.mapInPandas(expected, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        # at most a row per language and piece of the vocabulary
        rows = counts.toPandas()
        model = np.full((size, len(langs)), SMOOTHING)
        np.add.at(model, (rows["piece"].to_numpy(), rows["lang"].to_numpy()), rows["n"].to_numpy())
        model /= model.sum(axis=0)
        known.destroy()
    return langs, model


class Scorer:
    def __init__(self, langs: list[str], model: np.ndarray, path: str):
        self.langs, self.model, self.lattice = langs, model, load(path)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def learn(self, words: list[str]) -> None:
        """Add the words' log likelihoods to the table."""
        total = np.zeros((len(words), len(self.langs)))
        for part in batches(words, len(self.langs)):
            length, at, begin, end, piece = self.lattice.edges([words[i] for i in part])
            total[part] = self.lattice.likelihoods(length, *self.lattice.forward(length, at, begin, end, self.model[piece]))
        first = len(self.table)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.table = np.concatenate([self.table, total])

    def score(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            group.append(self.lattice.words(text.lower()) if text and self.langs else [])
            size += len(text or "")
            if size >= 1_000_000 or i + 1 == len(texts):
                yield from self._score(group)
                group, size = [], 0

    def _score(self, group: list[list[str]]) -> Iterator[tuple[str, float]]:
        distinct = set().union(*group)
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            # keep what this group asks for
            held = list(distinct & self.known.keys())
            self.table = self.table[[self.known[w] for w in held]]
            self.known = {w: i for i, w in enumerate(held)}
        if new:
            self.learn(list(new))
        known, table = self.known, self.table
        for words in group:
            if not words:
                yield UNKNOWN, 0.0
                continue
            total = table[[known[w] for w in words]].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(np.argmax(total))
            yield self.langs[best], float(share[best] / share.sum())


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", out: str = "language", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang`` and ``score``."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {out} already: name another for the output")
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf("lang string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shipped.value, path)
        for texts in batches:
            yield pd.DataFrame(list(scorer.score(texts.tolist())), columns=["lang", "score"])

    return docs.withColumn(out, language(F.col(text_col)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, model = train(docs)
    scored = predict(docs.select("doc_id", "text"), langs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
