"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is a sequence of words (runs without ASCII white space, in lower case).  Its
k-mers of ``K`` words are labelled with their occurrence, so a repeated k-mer counts as
often as it stands.  For each of ``SAMPLES`` hash functions the ``TUPLE`` labelled k-mers of
smallest hash are put in the order of the text; the hash of that tuple is a bucket.
Two documents meet in a bucket if they share those k-mers in the same order, so the
index is sensitive to edit similarity.  Few k-mers survive the edits of a short text, so
texts of up to ``SHORT`` words also have ``SHORT_SAMPLES`` tuples of ``SHORT_TUPLE`` single
words each.  (Both texts of a pair with one of at most 2/3 of that are such texts, so no
length parts a pair.)

A pair is a link if its edit similarity, one less the share of words inserted or
deleted, is ``threshold`` or more: an alignment of the two word sequences within the band
of that many edits decides, and nothing else.  Where a pair reaches 0.8, at least 2/3 of
the union of its labelled words is common.  ``SIGNATURE`` minima over labelled words estimate
that share within a bucket; members estimated at ``PLAUSIBLE`` or more join a family.
Only families have their texts compared, in two steps: all members with one leader (the
one with most plausible partners), then, in blocks, those that the leader did not link,
with each other and with all the rest where signatures allow.  So a large group of near
copies costs about a comparison each, and no plausible pair of a family is passed over.

Documents of equal words are one class before all this.  The result has a row for each
document row: the class id is the smallest document id reachable by links.

What may be missed: pairs that meet in no bucket, or whose estimate falls short.  With
words replaced at random, 0 to 7 pairs in 100 at a similarity of exactly 0.8 (the more,
the longer the text), up to 1 in 100 at 0.85 and none seen at 0.9; the tests measure
recall against alignments of all pairs.

Edge cases: a null text and one without a word are in one class of empty documents.
A text with fewer than K words has one k-mer, all its words.  Null ids come after all
others, so they name only a class that has no other.  Rows that repeat fall into one
class; rows that repeat an id with other texts are documents of their own.  Columns of
any name beside the id and the text pass through ``keep_one``.  An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.blocks import in_blocks, local_roots, runs
from textloom.llm.components import connected_components
from textloom.llm.storage import save, shuffle_partitions, small_batches

K, TUPLE, SAMPLES = 5, 2, 80
SHORT, SHORT_TUPLE, SHORT_SAMPLES = 144, 3, 12
THRESHOLD, PLAUSIBLE, SIGNATURE = 0.8, 0.55, 128
BLOCK, FAMILY_BLOCK = 256, 128
SPACE = "[\\x20\\x09-\\x0D]+"
#: K-mers whose hashes under all functions are laid out at once.
STRETCH = 4096
#: Rows of the shorter text that an alignment moves its band by.
BAND_STEP = 256
_MIX = np.random.default_rng(6).integers(1, 2**32, size=(2, SAMPLES + SHORT_SAMPLES + SIGNATURE), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

LONG_TUPLES, SHORT_TUPLES, MINIMA = slice(0, SAMPLES), slice(SAMPLES, SAMPLES + SHORT_SAMPLES), slice(SAMPLES + SHORT_SAMPLES, None)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")


split_words = re.compile("[^\x20\x09-\x0d]+").findall


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash for each place: its k words and how often they stood before."""
    words = words.view(np.uint64)
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for j in range(min(k, len(words))):
            h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # sorted by the high bits of the hash, then by place
        bits = np.uint64(max(1, n.bit_length()))
        ranked = np.sort(h >> bits << bits | np.arange(n, dtype=np.uint64))
        order = (ranked & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ranked >>= bits
        fresh = np.ones(n, dtype=bool)
        np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
        occurrence = np.zeros(n, dtype=np.uint64)
        if not fresh.all():
            places = np.arange(n)
            occurrence[order] = (places - np.maximum.accumulate(np.where(fresh, places, 0))).astype(np.uint64)
        h = (h + occurrence * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(32))


def hashed(h: np.ndarray, functions: slice) -> np.ndarray:
    """Values of the k-mers under some of the hash functions, a row for each function."""
    x = h.astype(np.uint32) ^ _MIX[0, functions, None]
    x *= _MIX[1, functions, None]
    return x


def ordered_tuples(h: np.ndarray, size: int, functions: slice) -> np.ndarray:
    """Hashes of the tuples of the ``size`` smallest k-mers under each function, in the order of the text."""
    if len(h) <= size:
        places = np.arange(len(h))[None, :]
    else:
        found = []
        for part in range(0, len(h), STRETCH):
            x = hashed(h[part : part + STRETCH], functions)
            each = np.arange(len(x))
            for _ in range(min(size, x.shape[1])):
                i = x.argmin(axis=1)
                found.append((x[each, i], i + part))
                x[each, i] = np.uint32(2**32 - 1)
        places = np.array([i for _, i in found]).T
        if len(found) > size:
            keep = np.argsort(np.array([v for v, _ in found]).T, axis=1, kind="stable")[:, :size]
            places = np.take_along_axis(places, keep, 1)
        places = np.sort(places, axis=1)
    with np.errstate(over="ignore"):
        b = np.full(len(places), size, dtype=np.uint64)
        for j in range(places.shape[1]):
            b = (b ^ h[places[:, j]]) * np.uint64(0x9E3779B97F4A7C15)
            b ^= b >> np.uint64(32)
    return b


def sketch(words: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bucket hashes of the Order MinHash tuples, and the signature of the labelled words."""
    buckets = [ordered_tuples(labelled_kmers(words), TUPLE, LONG_TUPLES)]
    single = labelled_kmers(words, 1)
    if len(words) <= SHORT:
        buckets.append(ordered_tuples(single, SHORT_TUPLE, SHORT_TUPLES))
    if len(words) == 3:
        # a text of two of these words has no third one
        buckets += [ordered_tuples(single[[i, j]], SHORT_TUPLE, SHORT_TUPLES) for i, j in ((0, 1), (0, 2), (1, 2))]
    minima = np.full(SIGNATURE, np.uint32(2**32 - 1))
    for part in range(0, len(single), STRETCH):
        minima = np.minimum(minima, hashed(single[part : part + STRETCH], MINIMA).min(axis=1))
    # a byte of each: 1 in 256 agrees by chance
    low = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return np.unique(np.concatenate(buckets)).view(np.int64), low.tobytes()


def agreeing(signatures: list[bytes], words: np.ndarray, threshold: float, plausible: float) -> np.ndarray:
    """Which pairs may be links by their lengths and by the estimate of their common words."""
    minima = np.frombuffer(b"".join(signatures), dtype=np.uint8).reshape(len(words), SIGNATURE)
    equal = np.zeros((len(words), len(words)), dtype=np.uint8)
    for s in range(SIGNATURE):
        equal += minima[:, s][:, None] == minima[:, s][None, :]
    n = words.astype(np.int64)
    allowed = np.abs(n[:, None] - n[None, :]) <= (1 - threshold) * (n[:, None] + n[None, :]) + 1e-9
    found = (equal >= plausible * SIGNATURE) & allowed
    np.fill_diagonal(found, False)
    return found


class Sequence:
    """The words of a text, for aligning it with others."""

    def __init__(self, text: str):
        self.words = split_words(text.lower())
        self._places: dict[str, int] | None = None

    def places(self) -> dict[str, int]:
        """For each word the set of its places, as bits."""
        if self._places is None:
            at: dict[str, list[int]] = {}
            for i, w in enumerate(self.words):
                at.setdefault(w, []).append(i)
            self._places = {w: sum(1 << i for i in x) for w, x in at.items()}
        return self._places


def edits_within(a: Sequence | list[str], b: Sequence | list[str], most: int) -> int | None:
    """Fewest words inserted and deleted between two sequences, if at most ``most``.

    Row by row of b, the bits of a number say where the longest common subsequence
    with the words of a so far does not grow; only places within ``most`` of the
    diagonal, the band, are held, and those behind it are counted and let go."""
    a, b = (x if isinstance(x, Sequence) else _sequence(x) for x in (a, b))
    n, m = len(a.words), len(b.words)
    if abs(n - m) > most:
        return None
    places = a.places()
    state, base, top, common = 0, 0, 0, 0
    for row in range(0, m, BAND_STEP):
        left, right = min(n, max(0, row - most)), min(n, row + BAND_STEP + most)
        if left > base:
            behind = left - base
            common += behind - (state & ((1 << behind) - 1)).bit_count()
            state >>= behind
            base = left
        if right > top:
            state |= ((1 << (right - top)) - 1) << (top - base)
            top = right
        band = (1 << (top - base)) - 1
        for w in b.words[row : row + BAND_STEP]:
            if w in places:
                hit = state & (places[w] >> base)
                state = ((state + hit) | (state - hit)) & band
    common += top - base - state.bit_count()
    edits = n + m - 2 * common
    return edits if edits <= most else None


def _sequence(words: list[str]) -> Sequence:
    made = Sequence("")
    made.words = list(words)
    return made


def alike(a: Sequence, b: Sequence, threshold: float = THRESHOLD) -> bool:
    """Whether two texts are a link."""
    return edits_within(a, b, int((1 - threshold) * (len(a.words) + len(b.words)) + 1e-9)) is not None


class Groups:
    """Disjoint sets of 0..n-1 named by their lowest member."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, t, w1, w2, n, buckets, signature) of each row; t stands for the text, w1 and w2 for its n words."""
    words = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("t"), F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)).alias("words"))
    keyed = words.select("did", "t", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit("words"), F.col("words")).alias("w2"), F.size("words").alias("n"), "words")

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [sketch(np.asarray(w, dtype=np.int64)) for w in frame["words"]]
            yield frame[["did", "t", "w1", "w2", "n"]].assign(buckets=[r[0] for r in made], signature=[r[1] for r in made])

    return keyed.mapInPandas(sketched, "did long, t long, w1 long, w2 long, n int, buckets array<long>, signature binary")


def plausible_edges(classes: DataFrame, threshold: float, plausible: float) -> DataFrame:
    """(node, root, partners): who reaches whom in a bucket by the estimate of common words."""
    slim = classes.select(F.explode("buckets").alias("bucket"), "node")
    # buckets of the same members are one
    held = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit("member"), "node")).alias("x"))
    once = held.where(F.col("in_bucket") > 1).groupBy("in_bucket", "s", "x").agg(F.min("bucket").alias("bucket"))
    shared = save(once.select("bucket", "in_bucket"), "near-buckets")
    met = slim.join(shared.hint("merge"), "bucket")
    signed = met.join(classes.select("node", "n", "signature").hint("merge"), "node").select("bucket", "in_bucket", "node", "n", "signature")

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(frames, ["bucket", "left", "right"]):
            node, side = group["node"].to_numpy(), group["side"].to_numpy()
            crossed = group["left"].iat[0] != group["right"].iat[0]
            if crossed and side.min() == side.max():
                continue
            linked = agreeing(group["signature"].tolist(), group["n"].to_numpy(), threshold, plausible)
            if crossed:
                linked &= side[:, None] != side[None, :]
            partners = linked.sum(axis=1)
            has = partners > 0
            if has.any():
                yield pd.DataFrame({"node": node[has], "root": node[local_roots(linked)][has], "partners": partners[has]})

    return in_blocks(signed, ["bucket"], "node", BLOCK, counted="in_bucket").mapInPandas(estimate, "node long, root long, partners long")


def leader_links(members: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """(family, node, linked) of each member but the leader."""
    first = members.join(leaders.hint("merge"), ["family", "node"]).select("family", F.col("node").alias("leader"), F.col("text").alias("leader_text"))
    pairs = members.join(first.hint("merge"), "family").where(F.col("node") != F.col("leader"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, leader = None, Sequence("")
        for frame in frames:
            linked = []
            for text, other, other_text in zip(frame["text"], frame["leader"], frame["leader_text"], strict=True):
                if other != name:
                    name, leader = other, Sequence(other_text)
                linked.append(alike(leader, Sequence(text), threshold))
            yield pd.DataFrame({"family": frame["family"], "node": frame["node"], "leader": frame["leader"], "linked": linked})

    return pairs.select("family", "node", "text", "leader", "leader_text").mapInPandas(compare, "family long, node long, leader long, linked boolean")


def rest_links(members: DataFrame, judged: DataFrame, threshold: float, plausible: float, block: int) -> DataFrame:
    """(node, root): links of the members that the leader did not link with each other and with the rest.

    Members are cut into chunks; every pair of chunks of which one is of unlinked
    members is a block."""
    sizes = judged.groupBy("family").agg(F.count_if(~F.col("linked")).alias("free"), F.count_if("linked").alias("bound"))
    # written, so that both sides of the join are shuffled and a large family can be split
    sizes = save(sizes.where((F.col("free") > 0) & (F.col("free") + F.col("bound") > 1)), "near-sizes")
    sized = judged.join(sizes.hint("merge"), "family").select(
        "family",
        "node",
        (~F.col("linked")).alias("is_free"),
        F.ceil(F.col("free") / block).cast("int").alias("free_chunks"),
        F.ceil(F.col("bound") / block).cast("int").alias("bound_chunks"),
    )
    h = F.xxhash64(F.lit("family"), F.col("node"))
    own = F.when(F.col("is_free"), F.pmod(h, F.col("free_chunks"))).otherwise(F.col("free_chunks") + F.pmod(h, F.col("bound_chunks"))).cast("int")
    last = F.when(F.col("is_free"), F.col("free_chunks") + F.col("bound_chunks")).otherwise(F.col("free_chunks"))
    placed = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1)))
    blocks = placed.select("family", "node", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    texts = blocks.join(members.select("node", "text", "n", "signature").hint("merge"), "node")
    key = ["family", "left", "right"]
    grouped = texts.repartition(shuffle_partitions(members.sparkSession), *key).sortWithinPartitions(*key, "side", "node")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(frames, key):
            node, side = group["node"].to_numpy(), group["side"].to_numpy()
            crossed = group["left"].iat[0] != group["right"].iat[0]
            may = np.triu(agreeing(group["signature"].tolist(), group["n"].to_numpy(), threshold, plausible))
            if crossed:
                may &= side[:, None] != side[None, :]
            texts = group["text"].tolist()
            held: dict[int, Sequence] = {}
            sets = Groups(len(node))
            for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
                if sets.find(i) != sets.find(j):
                    for one in (i, j):
                        if one not in held:
                            held[one] = Sequence(texts[one])
                    if alike(held[i], held[j], threshold):
                        sets.join(i, j)
            roots = np.array([sets.find(i) for i in range(len(node))])
            moved = roots != np.arange(len(node))
            if moved.any():
                yield pd.DataFrame({"node": node[moved], "root": node[roots][moved]})

    return grouped.mapInPandas(compare, "node long, root long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, plausible: float = PLAUSIBLE) -> DataFrame:
    """A row (did, t, component, class_id, kept) for each row of ``docs``; ``t`` is the hash of its text.

    ``component`` is the class itself: classes of null ids, or of other texts under one repeated id,
    share a ``class_id``.  ``kept`` marks the rows of the document that names the class."""
    small_batches(docs.sparkSession)
    rows = save(sketches(docs, id_col, text_col), "near-sketches")
    # a number of its own for each sequence of words, fixed by being written
    classes = save(
        rows.groupBy("w1", "w2").agg(F.min("did").alias("rep"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature"))
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "near-classes",
    )
    met = save(plausible_edges(classes, threshold, plausible), "near-plausible")
    families = save(connected_components(met.select(F.col("node").alias("u"), F.col("root").alias("v"))), "near-families")
    families = families.withColumnRenamed("component", "family")
    wanted = families.join(classes.select("node", "t", "n", "signature"), "node")
    texts = docs.select(F.xxhash64(text_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal texts give theirs once
    members = save(texts.join(wanted.hint("merge"), "t").groupBy("node", "family").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("signature").alias("signature")), "near-members")
    partners = met.groupBy("node").agg(F.sum("partners").alias("partners"))
    most = F.max_by("node", F.struct("partners", F.col("node")))
    leaders = save(families.join(partners, "node").groupBy("family").agg(most.alias("node")), "near-leaders")
    judged = save(leader_links(members, leaders, threshold), "near-judged")
    others = save(rest_links(members, judged, threshold, plausible, FAMILY_BLOCK), "near-others")
    links = judged.where("linked").select(F.col("node").alias("u"), F.col("leader").alias("v")).unionByName(others.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = save(connected_components(links), "near-linked")
    named = classes.select("w1", "w2", "node", "rep").join(linked.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = save(named.groupBy("component").agg(F.min("rep").alias("class_id")), "near-ids")
    by_class = save(named.join(ids.hint("merge"), "component").select("w1", "w2", "component", "class_id"), "near-named")
    found = rows.select("did", "t", "w1", "w2").join(by_class.hint("merge"), ["w1", "w2"])
    return found.select("did", "t", "component", "class_id", F.col("did").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, of repeated rows of it any one.

    Texts that are not linked are classes of their own, whatever their ids."""
    found = near_duplicates(docs, id_col, text_col, threshold).where("kept").groupBy("component", "did").agg(F.min("t").alias("t"))
    chosen = found.select(F.col("did").alias("_did"), F.col("t").alias("_t"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("did"), F.xxhash64(text_col).alias("t"))
    # repeated rows and null ids meet in one partition with the row that stays
    one = keyed.join(chosen.hint("merge"), F.col("did").eqNullSafe(F.col("_did")) & (F.col("t") == F.col("_t"))).groupBy("did", "t").agg(F.first("_row").alias("_row"))
    return one.select("_row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("did").alias("doc_id"), "class_id", "kept")
