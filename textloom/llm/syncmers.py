"""Document fingerprints of closed syncmers, in SQL functions only.

A text is a sequence of tokens, short pieces of its words: a token ends after a vowel, a
digit of 0 3 6 9, a mark, any character beyond ASCII, where the word ends, or after
``LONGEST`` - 1 other characters.  So it is one unit at every length and in every script: about a
syllable in Latin letters, a character in others.  Where a token ends depends on the word
up to there alone.  A k-mer of tokens is an anchor if, of its inner s-mers, the one with
the smallest hash lies at its first or last place (a closed syncmer).  Whether a k-mer
is chosen depends on nothing around it, so a passage gives the same anchors wherever it
stands.  The fingerprint is the list of the anchors' 32-bit hashes in the order of the
text, eight hexadecimal digits each; likeness is the Jaccard index of two anchor sets.
A text with fewer tokens than k has one anchor, the hash of all its tokens, and one
without a token has none.

Neighbours: documents in descending id, ties by text hash; the one after the last is
the first.  Ranges of ids come from a range partitioning of the ids alone, written to the
shared folder; their limits (two numbers a partition) reach the driver.  Texts are then
shuffled once, to the range of their id, and a document sees its neighbour through a
window there; a copy of the first document of each range goes with the range before.

Edge cases: a null text is an empty one.  Null ids come last, after every other id.  Rows
that repeat an id and a text are one document with one neighbour, and each gives a row of
the result; rows that repeat an id with other texts are neighbours of each other.  A
single document is its own neighbour.  The likeness of two empty fingerprints is 1, that
of an empty and another is 0.  Other columns are not read.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, shuffle_partitions

K, S = 8, 3
LONGEST = 8
#: Characters inside a token, and all others but white space, which end one.
INSIDE = "\\x00-\\x08\\x0E-\\x1F\\x7F124578b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"
TOKEN = f"[{INSIDE}]{{1,{LONGEST - 1}}}+[^{INSIDE}\\x20\\x09-\\x0D]?|[^{INSIDE}\\x20\\x09-\\x0D]"
#: A document's place in the order: null ids last, then descending id, then descending hash.
PLACE = ["known", "did", "h"]


def token_hashes(text: Column) -> Column:
    """Hash of each token."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def inner_hashes(tokens: Column, s: int = S) -> Column:
    """Hash of the s-mer at each place of an array of token hashes."""
    places = F.sequence(F.lit(0), F.size(tokens) - s)
    smer = lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(s)])
    return F.when(F.size(tokens) < s, F.array().cast("array<bigint>")).otherwise(F.transform(places, smer))


def anchors(tokens: Column, inner: Column, k: int = K, s: int = S) -> Column:
    """The chosen k-mers' hashes in order, from token hashes and the hashes of s-mers."""
    width = k - s
    last = F.size(inner) - 1 - width

    def chosen(i: Column) -> Column:
        ends = F.least(F.get(inner, i), F.get(inner, i + width))
        middle = F.least(*[F.get(inner, i + j) for j in range(1, width)])
        return ends <= middle

    def kmer(i: Column) -> Column:
        cover = [*range(0, width, s), width]
        return F.shiftright(F.xxhash64(*[F.get(inner, i + j) for j in cover]), 32).cast("int")

    few = F.when(F.size(tokens) == 0, F.array().cast("array<int>")).otherwise(F.array(F.hash(tokens)))
    return F.when(last < 0, few).otherwise(F.transform(F.filter(F.sequence(F.lit(0), last), chosen), kmer))


def with_anchors(df: DataFrame, text_col: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the array of 32-bit anchors of a text column that holds no nulls."""
    # each array is a column of its own before a lambda reads it
    cut = df.withColumn("_tokens", token_hashes(F.col(text_col)))
    inner = cut.withColumn("_inner", inner_hashes(F.col("_tokens"), s))
    return inner.withColumn(out, anchors(F.col("_tokens"), F.col("_inner"), k, s)).drop("_tokens", "_inner")


def fingerprint(chosen: Column) -> Column:
    """Eight lower-case hexadecimal digits for each anchor, in the order of the text."""
    return F.lower(F.array_join(F.transform(chosen, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two anchor sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def range_of(limits: list[tuple], place: Column, low: int = 0) -> Column:
    """The number of the range that a document's place is in, by halving; ``limits`` are the last places of all ranges but one."""
    if not limits:
        return F.lit(low)
    middle = len(limits) // 2
    known, did, h = limits[middle]
    limit = F.struct(F.lit(known), F.lit(did).cast("long"), F.lit(h).cast("long"))
    # descending: a place at or above the limit is in the first half
    return F.when(place >= limit, range_of(limits[:middle], place, low)).otherwise(range_of(limits[middle + 1 :], place, low + middle + 1))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (did, text, edited, own_anchors, edited_anchors, next_anchors) per document row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    did = F.col(id_col).cast("long")
    keyed = docs.select(did.isNotNull().alias("known"), F.coalesce(did, F.lit(0)).alias("did"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = [F.col(c).desc() for c in PLACE]
    ids = keyed.select(*PLACE).distinct().repartitionByRange(shuffle_partitions(spark), *order).withColumn("range", F.spark_partition_id())
    place = F.struct(*PLACE)
    ranges = save(ids.groupBy("range").agg(F.max(place).alias("first"), F.min(place).alias("last")), "document-ranges")
    # a row per range: the number of shuffle partitions
    found = sorted(ranges.collect(), key=lambda r: r["range"])
    number = range_of([tuple(r["last"]) for r in found[:-1]], place)
    # the first document of each range stands in the range before too, ahead of all: it follows the last one there
    heads = F.broadcast(spark.createDataFrame([((i - 1) % len(found), *r["first"]) for i, r in enumerate(found)], "range int, known boolean, did long, h long") if found else ids.select("range", *PLACE).limit(0))
    placed = keyed.withColumn("range", number).withColumn("own", F.lit(1))
    ahead = keyed.join(heads, PLACE).withColumn("own", F.lit(0)).select(*placed.columns)
    dealt = placed.unionByName(ahead).repartitionById(max(1, len(found)), F.col("range"))
    once = dealt.groupBy("range", "own", *PLACE).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    # the grouping leaves each range in ascending order: the next document stands before
    by_place = W.partitionBy("range").orderBy("own", *PLACE)
    after = with_anchors(once, "text", "own_anchors").withColumn("next", F.lag(F.struct("text", "own_anchors")).over(by_place)).where("own = 1")
    joined = after.select(
        F.when(F.col("known"), F.col("did")).alias("did"), "text", "copies", "own_anchors", F.col("next.text").alias("next_text"), F.col("next.own_anchors").alias("next_anchors")
    )
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = with_anchors(joined.withColumn("edited", edited).drop("next_text"), "edited", "edited_anchors")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("did", "text", "edited", "own_anchors", "edited_anchors", "next_anchors")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint_edits(docs).select(
        F.col("did").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own_anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("own_anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("own_anchors"), F.col("next_anchors")).alias("near_next"),
    )
