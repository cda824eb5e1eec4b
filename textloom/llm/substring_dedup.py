"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash, the sum of values of the last ``WINDOW`` code points shifted by their age,
rolls over a text, anew for each text; a chunk ends where its high bits are zero, about
every ``AVERAGE`` characters.  Where a chunk ends depends on the characters before it
alone, so an insertion moves the chunks after it but does not change them.  Where
there is no such place for ``CLEAR`` characters on either side, a chunk also ends where the
hash is the smallest of ``NEAR`` places on either side, ties at least ``NEAR`` apart: so a
passage of one word over and over is cut at the same place of its period wherever it
stands.  Chunks are told apart by a 128-bit digest of their code points, all ASCII
white space counting as a space.

A chunk is repeated if documents with different ids hold it.  Neighbouring repeated
chunks of a text are a span; spans of at least ``min_chars`` are reported (a passage of
fifty words covers that much after the part of a chunk lost at either end).  The
document with the smallest id holds a chunk first; a document keeps a span of which it
holds half the characters first or more (short chunks meet by chance) and loses others.

Digests are aggregated to one row each (smallest and largest id) before the join back,
which AQE may split where a chunk is very frequent.

Edge cases: a null text is an empty one and has no chunk.  A null id counts as the
smallest (that of the least long, if there is one).  Rows that repeat an id are one
document for the counting, and each text is reported by itself; a row that repeats an id
and a text is reported once.  Passages that repeat within one document only are left
alone.  A long text is cut ``GROUP_CHARS`` characters at a time, with the same result.
Columns of any name pass through ``drop_repeats``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.storage import save, small_batches

WINDOW, AVERAGE = 16, 32
CLEAR, NEAR = 48, 16
#: Characters before a stretch of a long text that decide where its chunks end.
LEAD = CLEAR + NEAR + WINDOW
MIN_CHARS = 100
#: Characters that are cut at once.
GROUP_CHARS = 300_000
SMALLEST_ID = -(2**63)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CHUNK_SCHEMA = "d1 long, d2 long, did long, row long, start long, size int, words int"
DIGEST = ["d1", "d2"]


def mixed(points: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit value of each code point."""
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def values(points: np.ndarray, seed: int) -> np.ndarray:
    """The same by a table, where no code point is beyond it."""
    return _table(seed)[points] if points.max() < len(_table(seed)) else mixed(points, seed)


@lru_cache(maxsize=2)
def _table(seed: int) -> np.ndarray:
    return mixed(np.arange(1 << 16), seed)


def _powers(base: int, n: int) -> np.ndarray:
    return _powers_upto(base, 1 << (n - 1).bit_length())[:n]


@lru_cache(maxsize=8)
def _powers_upto(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def smallest_places(rolled: np.ndarray, low: int, high: int, last: int) -> list[int]:
    """Where the hash of a text is the smallest around, of the places low..high-1; ties NEAR apart, from ``last`` on."""
    around = np.full(high - low + 2 * NEAR, np.uint32(2**32 - 1))
    begin, end = max(0, low - NEAR), min(len(rolled), high + NEAR)
    around[begin - low + NEAR : end - low + NEAR] = rolled[begin:end]
    found = np.flatnonzero(rolled[low:high] == np.lib.stride_tricks.sliding_window_view(around, 2 * NEAR + 1).min(axis=1)) + low
    kept = []
    for place in found.tolist():
        if place - last >= NEAR:
            kept.append(place)
            last = place
    return kept


def chunks(texts: list[str], lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, size, digest, second digest, words) of the chunks of all texts.

    ``lead``: characters before each text that the rolling hash sees, in no chunk."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").copy()
    points[(points >= 9) & (points <= 13)] = 32  # a passage may be wrapped anew
    n = len(points)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 6
    gear, rolled = (values(points, 2) >> np.uint64(32)).astype(np.uint32), np.zeros(n, dtype=np.uint32)
    bits = 32 - WINDOW
    with np.errstate(over="ignore"):
        for age in range(min(WINDOW, n)):
            rolled[age:] += (gear[: n - age] if age else gear) << np.uint32(bits + age)
        # the high half of the sum holds a shifted value of each of the last WINDOW characters
        # the hash starts anew with each text: its first characters do not see the text before it
        ends_of_texts = np.cumsum(lengths)
        offset = np.arange(n) - np.repeat(ends_of_texts - lengths, lengths)
        head = np.flatnonzero(offset < WINDOW - 1)
        anew = np.zeros(len(head), dtype=np.uint32)
        for age in range(WINDOW - 1):
            own = offset[head] >= age
            anew[own] += gear[head[own] - age] << np.uint32(bits + age)
        rolled[head] = anew
        cut = (rolled >> np.uint32(32 - AVERAGE.bit_length() + 1)) == 0
        # stretches without a cut, from one cut or text's end to the next
        bounds = np.unique(np.r_[np.flatnonzero(cut), ends_of_texts[lengths > 0] - 1])
        before = np.r_[-1, bounds[:-1]]
        owner = np.searchsorted(ends_of_texts, bounds, side="right")
        begin = (ends_of_texts - lengths)[owner]
        low = np.maximum(before + 1 + np.where((before >= begin) & cut[before], CLEAR, 0), begin + lead)
        high = bounds - np.where(cut[bounds], CLEAR, 1)
        for i in np.flatnonzero(low < high).tolist():
            first, end = int(begin[i]), int(ends_of_texts[owner[i]])
            places = smallest_places(rolled[first:end], int(low[i]) - first, int(high[i]) - first, lead - 1 if lead else -NEAR)
            cut[[first + x for x in places]] = True
        cut[offset < lead] = False
        cut[offset == lead - 1] = True
        ends = np.unique(np.r_[np.flatnonzero(cut) + 1, ends_of_texts[lengths > 0]])
        starts = np.r_[0, ends[:-1]]
        value = values(points, 1)
        digests = []
        for base in _BASES:
            sums = np.r_[np.uint64(0), np.cumsum(value * _powers(base, n), dtype=np.uint64)]
            digest = (sums[ends] - sums[starts]) * _powers(pow(base, -1, 2**64), n)[starts]
            digest ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            digest = (digest ^ (digest >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            digests.append(digest.view(np.int64))
    spaces = np.r_[0, np.cumsum(points == 32)]
    owner = np.searchsorted(ends_of_texts, starts, side="right")
    start = starts - (ends_of_texts - lengths)[owner] - lead
    found = (owner, start, ends - starts, *digests, spaces[ends] - spaces[starts])
    return tuple(x[start >= 0] for x in found) if lead else found


def long_chunks(text: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for one text, a stretch at a time; chunks that what follows may change are left to the next one."""
    at, size = 0, GROUP_CHARS
    while at < len(text):
        lead = min(at, LEAD)
        found = chunks([text[at - lead : at + size]], lead)
        rest = len(text) - at
        if size < rest:
            settled = found[1] + found[2] + CLEAR + NEAR < size
            if not settled.any():
                size *= 2
                continue
            rest = int((found[1] + found[2])[settled][-1])
            found = tuple(x[settled] for x in found)
        yield (found[0], found[1] + at, *found[2:])
        at, size = at + rest, GROUP_CHARS


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).where("text != ''")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            did, row = frame["did"].to_numpy(), frame["row"].to_numpy()
            texts = frame["text"].tolist()
            # groups of about GROUP_CHARS; a longer text alone, in stretches
            group = np.cumsum([len(t) for t in texts]) // GROUP_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
                long = [i for i in part.tolist() if len(texts[i]) > GROUP_CHARS]
                rest = np.array([i for i in part.tolist() if len(texts[i]) <= GROUP_CHARS], dtype=np.int64)
                for own, found in [(rest, chunks([texts[i] for i in rest]))] if len(rest) else []:
                    yield _chunk_frame(did[own[found[0]]], row[own[found[0]]], found)
                for i in long:
                    for found in long_chunks(texts[i]):
                        yield _chunk_frame(did[i], row[i], found)

    return keyed.mapInPandas(cut, CHUNK_SCHEMA)


def _chunk_frame(did, row, found: tuple[np.ndarray, ...]) -> pd.DataFrame:
    _, start, size, d1, d2, words = found
    return pd.DataFrame({"d1": d1, "d2": d2, "did": did, "row": row, "start": start, "size": size, "words": words})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, row, start, end, n_words, first_did, n_kept): spans that other documents hold too; offsets in code points.

    ``first_did``: the first holder of most of its characters; ``n_kept``: characters of the span
    whose first holder this document is."""
    cut = chunk_rows(docs, id_col, text_col)
    counted = cut.groupBy(*DIGEST).agg(F.min("did").alias("first"), F.max("did").alias("last"))
    # written, so that both sides of the join are shuffled and a chunk in very many documents can be split
    repeated = save(counted.where(F.col("first") < F.col("last")).select(*DIGEST, "first"), "repeated-chunks")
    found = cut.join(repeated.hint("merge"), DIGEST).dropDuplicates(["did", "row", "start"])
    w = W.partitionBy("did", "row").orderBy("start")
    fresh = F.when(F.lag(F.col("start") + F.col("size")).over(w) == F.col("start"), 0).otherwise(1)
    runs = found.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    by_first = runs.groupBy("did", "row", "run", "first").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"), F.sum("size").alias("chars"))
    spans = by_first.groupBy("did", "row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.max_by("first", F.struct("chars", F.bitwise_not("first"))).alias("first_did"),
        F.sum(F.when(F.col("first") == F.col("did"), F.col("chars")).otherwise(0)).alias("n_kept"),
    )
    return spans.where(F.col("end") - F.col("start") >= min_chars).drop("run")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with their text without the spans that others held first; a null stays one."""
    spans = repeated_spans(docs, id_col, text_col, min_chars).where("2 * n_kept < end - start").groupBy("did", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST_ID)).alias("did"), F.xxhash64(F.col(text_col)).alias("row"))
    joined = keyed.join(spans.hint("merge"), ["did", "row"], "left")
    text = F.col(f"_doc.`{text_col}`")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
    stops = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    kept = F.array_join(F.zip_with(begins, stops, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), "")
    return joined.withColumn("_doc", F.col("_doc").withField(f"`{text_col}`", F.when(F.col("_spans").isNull(), text).otherwise(kept))).select("_doc.*")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = lambda c: F.when(F.col(c) != SMALLEST_ID, F.col(c))
    return repeated_spans(docs).select(
        known("did").alias("doc_id"), "start", "end", "n_words", known("first_did").alias("first_doc_id"), "n_kept", (2 * F.col("n_kept") >= F.col("end") - F.col("start")).alias("kept")
    )
