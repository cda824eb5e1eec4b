"""Lexical features of ordered segments: names, repeated passages, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.rules import is_dialogue
from textloom.functions.text import bare_words, sentence_units, strip
from textloom.operators import ledger

NAME = r"\p{Lu}\p{Ll}{2,}(?:[’'-]\p{Lu}?\p{Ll}+)*"
TOKEN = r"[\p{L}\p{N}_]+(?:[’'-][\p{L}\p{N}_]+)*"
COMPOUND = r"\p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,}){1,2}"
# fixed values: words that no name holds, then articles and titles that may lead one
NAME_STOPS = (
    "a an and as at after although around before behind below between both but by can did do does down during each even every for from get got had has have "
    "he her here hers him his how i if in into is it its just keep like may me might more most must my near no nor not now of off on once one only or "
    "other our out over own said same she should so some such than that the their them then there these they this those through thus to too under until up upon"
).split()
ARTICLES = ["the", "a", "an"]
TITLES = "mr mrs ms miss dr prof sir lord lady captain capt".split()
#: Rows of digests and places that may be sent to every task.
SENT_ROWS = 1 << 17


def smallest(rows: DataFrame, group: list[str], order: str, k: int, spread: int = 64) -> DataFrame:
    """The ``k`` smallest of each group, first within hashed parts of it, so no task sorts a whole group."""
    part = F.pmod(F.xxhash64(order), F.lit(spread))
    first = W.partitionBy(*group, "_part").orderBy(order)
    few = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(order))).where(F.col("_n") <= k).drop("_n", "_part")


def name_tokens(text: Column) -> Column:
    """Whole tokens that are capitalised words of three letters or more."""
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(f"^{NAME}$"))


def name_core(surface: Column) -> Column:
    """The name without a leading article or leading titles."""
    words = F.split(surface, " ")
    plain = F.transform(words, lambda w: F.lower(F.replace(w, F.lit("."), F.lit(""))))
    article = (F.size(words) > 1) & F.element_at(plain, 1).isin(*ARTICLES)
    titles = F.size(words) - F.aggregate(F.reverse(plain), F.lit(0), lambda n, w: n + 1) + F.aggregate(plain, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + F.when(a["on"] & w.isin(*TITLES), 1).otherwise(0)).alias("n"), (a["on"] & w.isin(*TITLES)).alias("on")), lambda a: a["n"])
    lead = F.when(article, 1).otherwise(F.least(titles, F.size(words) - 1))
    return F.array_join(F.slice(words, lead + 1, F.size(words)), " ")


def name_allowed(surface: Column) -> Column:
    parts = F.split(name_core(surface), " ")
    plain = F.transform(parts, lambda w: F.lower(F.replace(w, F.lit("."), F.lit(""))))
    stops = F.array(*[F.lit(w) for w in NAME_STOPS])
    return ~F.arrays_overlap(plain, stops) & F.exists(parts, lambda p: F.char_length(p) >= 3)


def name_mentions(segments: DataFrame) -> DataFrame:
    """(segment, chapter, dialogue, name): a row per segment and distinct allowed name."""
    # beside an explode, an expression runs once per row that comes out: so one select for each
    judged = segments.select("segment", "chapter", is_dialogue(F.col("text")).alias("dialogue"), F.array_distinct(name_tokens(F.col("text"))).alias("names"))
    found = judged.select("segment", "chapter", "dialogue", F.explode("names").alias("name"))
    # a single token has no title to strip and three letters at least
    return found.where(~F.lower("name").isin(*NAME_STOPS))


def name_scores(mentions: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row per name with two segments or one in dialogue, scored by spread and use."""
    place = (F.col("segment") - low) / F.greatest(F.lit(1), high - low)
    region = F.when(place < 1 / 3, 0).when(place > 2 / 3, 2).otherwise(1)
    by = mentions.groupBy("name").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("chapter").alias("chapters"), F.count_if("dialogue").alias("dialogues"), F.count_distinct(region).alias("regions")
    )
    score = F.log2(F.col("mentions") + 1) + F.col("chapters") * 1.8 + F.col("dialogues") * 1.4 + F.col("regions") * 2.5
    return by.where("mentions >= 2 OR dialogues > 0").withColumn("score", F.floor(score * 100 + 0.5) / 100)


def sentences(segments: DataFrame) -> DataFrame:
    """(segment, chapter, position, sentence, words) of the sentences with three characters or more."""
    # made before the explode: behind it each filter on the words would make them again
    stripped = F.transform(sentence_units(F.col("text")), lambda s: strip(s))
    both = F.transform(stripped, lambda s: F.struct(s.alias("sentence"), bare_words(s).alias("words")))
    rows = segments.select("segment", "chapter", F.posexplode(both).alias("position", "unit"))
    return rows.select("segment", "chapter", "position", "unit.sentence", "unit.words").where(F.char_length("words") >= 3)


def passages(segments: DataFrame) -> DataFrame:
    """The sentences of three words and twelve characters as bare words, with a digest (k1, k2) of 128 bits."""
    # bare words leave out what is stripped from a sentence, so the sentences themselves are not made
    rows = segments.select("segment", "chapter", F.explode(F.transform(sentence_units(F.col("text")), lambda s: bare_words(s))).alias("words"))
    long = rows.where((F.char_length("words") >= 12) & (F.size(F.split("words", " ")) >= 3))
    return long.select(F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("passage"), F.col("words")).alias("k2"), "words", "segment", "chapter")


def repeated_passages(segments: DataFrame, top: int = 80, ids: int = 16) -> DataFrame:
    """Passages of three words and twelve characters in more than one segment, the most frequent first.

    Digests and places are counted; texts come back, from the first segment that holds each, to those that are among the
    first ``top`` or tie with the last of them, and decide there."""
    keyed = ledger.saved(passages(segments).drop("words").distinct())
    found = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chapter").alias("chapters"), F.min("segment").alias("first"), F.max("segment").alias("last"))
    counted = ledger.saved(found.where("n > 1"))
    lead = counted.select("n", "chapters").orderBy(F.col("n").desc(), F.col("chapters").desc()).limit(top).collect()  # top rows
    tied = counted.where((F.col("n") > lead[-1]["n"]) | ((F.col("n") == lead[-1]["n"]) & (F.col("chapters") >= lead[-1]["chapters"]))) if lead else counted
    # so many rows at most; with more, the texts go through the join
    sent = F.broadcast if tied.count() <= SENT_ROWS else lambda rows: rows
    # only these segments are cut into sentences again
    again = segments.join(sent(tied.select(F.col("first").alias("of")).distinct()), F.col("segment").eqNullSafe(F.col("of")), "left_semi")
    places = sent(tied.select(F.col("k1").alias("of1"), F.col("k2").alias("of2"), F.col("first").alias("of")))
    texts = passages(again).join(places, (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")) & F.col("segment").eqNullSafe(F.col("of"))).select("k1", "k2", "words").distinct()
    best = ledger.saved(tied.join(texts, ["k1", "k2"]).orderBy(F.col("n").desc(), F.col("chapters").desc(), "words").limit(top))
    few = smallest(keyed.join(F.broadcast(best.select("k1", "k2", "words")), ["k1", "k2"]), ["words"], "segment", ids)  # top rows
    listed = few.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list("segment")), lambda x: x.cast("string")), ",").alias("segments"))
    return best.drop("k1", "k2").join(listed, "words").select("words", "n", "chapters", "first", "last", "segments")


def chapters(segments: DataFrame) -> DataFrame:
    """A row per chapter in order of first appearance, with its first, middle and last segment."""
    slim = segments.select("chapter", "segment", F.char_length("text").alias("n"), is_dialogue(F.col("text")).alias("d"))
    whole = slim.groupBy("chapter").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("n").alias("n_chars"), F.count_if("d").alias("dialogues"), F.min("segment").alias("first"), F.max("segment").alias("last")
    )
    ranks = ledger.ranked(segments.select("chapter", "segment"), ["chapter"], ["segment"])
    sizes = whole.select(F.col("chapter").alias("of"), "segments")
    middle = ranks.join(sizes, F.col("chapter").eqNullSafe(F.col("of"))).where(F.col("rank") == F.floor((F.col("segments") - 1) / 2) + 1).select("of", F.col("segment").alias("middle"))
    return whole.join(middle, F.col("chapter").eqNullSafe(F.col("of"))).select("chapter", "segments", "n_chars", "dialogues", "first", "middle", "last")
