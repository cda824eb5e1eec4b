"""Fixed terms in texts: found by keys, masked by an automaton, restored.

Which terms stand in a text is an equi join: a term meets a text by its first tokens or, in scripts without spaces, by its first two
characters; so no list of terms is broadcast, and a text carries only the terms that may be its own.  What goes through the join are hashes
that a sieve of bounded size lets through.  Masking builds one automaton (a trie with
failure links) for the terms of a batch of texts, scans each text once, and takes matches from the left, of those that begin together the longest.

Edge cases: null and empty texts have no terms; terms that are null or have neither letter nor digit are not looked for; of terms that differ in
case or repeat, the first target in order counts.  A marker that stands in a text already stays as it is.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import graph, ledger
from textloom.sources import json_tree

c = F.col
# fixed values: how a mask looks, and its pattern
MARK, MARKS = "__TERM_{:03d}__", r"__TERM_[0-9]+__"
#: Tokens of a term that a text is asked for before the whole term is compared.
KEY_TOKENS = 4
#: Scripts that put no spaces between words.
UNSPACED = r"[\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}]"
PAIRS = "array<struct<source:string,target:string,marker:string>>"


def normal(text: Column) -> Column:
    """In lower case, what is neither letter nor digit as one space."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(words: Column, pairs: Column) -> Column:
    return F.concat(words, F.transform(pairs, lambda x: F.concat(F.lit("\x01"), F.lower(x))))


def keys_of_texts(texts: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    """(id, gram): the distinct hashes of runs of tokens, and of pairs of characters, that stand in the texts and may be among
    those of ``asked`` (first, gram).  A run is made only where its first unit may begin a term, so a text without one costs a pass over its units."""
    # the units have a column of their own: beside the explode they would be made again for each of them
    pairs = F.regexp_extract_all(text_col, F.lit(rf"(?=({UNSPACED}.|.{UNSPACED}))"), F.lit(1))
    cut = texts.select(c(id_col).alias("id"), _units(F.split(normal(c(text_col)), " "), pairs).alias("units"))
    # the outer form, since a filter on the size of the array would be pushed below the units
    each = cut.select("id", "units", F.posexplode_outer("units").alias("at", "unit")).where("unit IS NOT NULL").withColumn("first", F.xxhash64("unit"))
    begun = graph.sieved(each, asked.select("first"), "first")
    # a run over the end of the text is a shorter one, since hashes pass over nulls
    following = [F.get("units", c("at") + i) for i in range(1, KEY_TOKENS)]
    runs = begun.select("id", F.explode(F.array(*[F.xxhash64("unit", *following[:n]) for n in range(KEY_TOKENS)])).alias("gram"))
    return graph.sieved(runs, asked.select("gram"), "gram").distinct()


def units_of_term(term: Column) -> Column:
    """The units that a text is asked for: the first tokens or, in scripts without spaces, the first two characters."""
    bare = F.btrim(term)
    pair = F.substr(bare, F.lit(1), F.lit(2))
    unspaced = pair.rlike(UNSPACED) & (F.char_length(bare) >= 2)
    return F.when(unspaced, _units(F.array().cast("array<string>"), F.array(pair))).otherwise(F.slice(F.split(normal(term), " "), 1, KEY_TOKENS))


def terms_of_texts(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, terms): for the texts that may hold some the terms (source, target) of ``terms`` as an array, the longest first,
    each with its marker.  The array is as long as a text has distinct runs of words at most."""
    # one target a term and its copies of other case
    one = terms.where(normal(c("source")) != "").groupBy(F.lower("source")).agg(F.min(F.struct("source", "target")).alias("term")).select(units_of_term(c("term.source")).alias("units"), "term.source", "term.target")
    hashed = F.xxhash64(*[F.get("units", F.lit(i)) for i in range(KEY_TOKENS)])
    asked = ledger.saved(one.select(F.xxhash64(F.get("units", F.lit(0))).alias("first"), hashed.alias("gram"), "source", "target"))
    met = keys_of_texts(texts, id_col, text_col, asked).join(asked.drop("first"), "gram")
    found = met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.char_length("source")).alias("n"), "source", "target"))).alias("found"))
    marked = F.transform("found", lambda t, i: F.struct(t["source"].alias("source"), t["target"].alias("target"), F.format_string(MARK.replace("{:03d}", "%03d"), i + 1).alias("marker")))
    return found.select("id", marked.alias("terms"))


def _unspaced(x: str) -> bool:
    n = ord(x)
    return 0x2E80 <= n <= 0x9FFF or 0xF900 <= n <= 0xFAFF or 0xAC00 <= n <= 0xD7AF or 0x0E00 <= n <= 0x0EFF or 0x1000 <= n <= 0x109F or 0x1780 <= n <= 0x17FF


def bounded(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on beyond a match; a term that begins in a script without spaces has no such ends."""
    if any(map(_unspaced, text[begin : min(end, begin + 2)])):
        return True
    return not (begin > 0 and text[begin - 1].isalnum() and text[begin].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def lowered(text: str) -> str:
    """In lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)


def replaced(text: str, automaton: ahocorasick.Automaton, own: dict[str, str]) -> str:
    """``text`` with its own terms (by their lower case) replaced: from the left, the longest first."""
    low = lowered(text)
    found = []
    for last, word in automaton.iter(low):
        begin = last - len(word) + 1
        if word in own and bounded(text, begin, last + 1):
            found.append((begin, -(last + 1), word))
    out, at = [], 0
    for begin, end, word in sorted(found):
        if begin >= at:
            out += [text[at:begin], own[word]]
            at = -end
    return "".join([*out, text[at:]])


def _replace_all(texts: pd.Series, terms: pd.Series, name: str) -> pd.Series:
    own = [{} if t is None else {lowered(x[name]): x["marker"] for x in reversed(list(t)) if x[name]} for t in terms]
    automaton = ahocorasick.Automaton()
    for word in {w for words in own for w in words}:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return pd.Series([text if text is None or not words else replaced(text, automaton, words) for text, words in zip(texts, own, strict=True)], dtype=object)


def masked(text: Column, terms: Column, name: str) -> Column:
    """``text`` with what ``name`` (source or target) of its terms says replaced by their markers."""

    @F.pandas_udf("string")
    def replace(texts: pd.Series, own: pd.Series) -> pd.Series:
        return _replace_all(texts, own, name)

    return replace(text, terms)


def protected(segments: DataFrame, terms: DataFrame, id_col: str, source_col: str, draft_col: str | None = None) -> DataFrame:
    """``segments`` with the terms in their source masked, and in their draft the targets of those terms; ``terms`` has
    the terms that the source holds with their markers."""
    own = terms_of_texts(segments, id_col, source_col, terms).withColumnRenamed("id", id_col)
    return protected_by(segments.join(own, id_col, "left"), source_col, draft_col)


def protected_by(segments: DataFrame, source_col: str, draft_col: str | None = None) -> DataFrame:
    """``protected`` for segments that have what ``terms_of_texts`` gives for their source as a column ``terms``."""
    held = segments.withColumn(source_col, masked(c(source_col), c("terms"), "source"))
    used = held.withColumn("terms", F.coalesce(F.filter("terms", lambda t: F.contains(c(source_col), t["marker"])), F.array().cast(PAIRS)))
    return used if draft_col is None else used.withColumn(draft_col, masked(c(draft_col), c("terms"), "target"))


def restored(text: Column, terms: Column, mode: Column) -> Column:
    """A text with its markers replaced by the sources (``mode`` source) or the targets of their terms."""
    return F.aggregate(terms, text, lambda out, t: F.replace(out, t["marker"], F.when(mode == "source", t["source"]).otherwise(t["target"])))


def marker_counts_match(source: Column, translation: Column, terms: Column) -> Column:
    """Whether a masked translation holds every marker as often as its masked source."""
    times = lambda text, t: F.size(F.split(text, t["marker"], -1))
    return F.forall(terms, lambda t: times(source, t) == times(translation, t))


def restored_documents(documents: DataFrame, terms: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, json): markers in the strings of JSON documents at any depth restored to targets, those under a key
    ``sourceExcerpt`` to sources.  ``terms``: (id, terms) of each document."""
    found = json_tree.levels(documents, id_col, json_col)
    strings = json_tree.strings(found)
    mode = F.when(c("path").rlike(r"\.sourceExcerpt($|[.\[])"), "source").otherwise("target")
    edits = strings.where(c("text").rlike(MARKS)).join(terms.select(c(id_col).alias("id"), "terms"), "id").select("id", "path", restored(c("text"), c("terms"), mode).alias("text"))
    return json_tree.write_back(documents, edits, id_col, json_col, found)
