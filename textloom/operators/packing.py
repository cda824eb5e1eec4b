"""Greedy packing of ordered items under budgets.

The packing of a document depends on its order alone: documents are dealt to partitions, sorted there and read as a
stream, of which only the open batch is held; so one document with very many items costs time in one task, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from textloom.functions.splitting import cut_rows, split_keeping_separators
from textloom.functions.text import estimate_tokens


def pack(rows: DataFrame, group: list[str], order: list[str], size: str, most_size: int, most_items: int, context: str | None = None, isolate: bool = False) -> DataFrame:
    """``rows`` with ``batch`` from 1: a new batch when the size or the number of items would pass its
    limit or, if given, the context changes; ``isolate`` closes a batch after an item above the limit."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, batch, held, total, was = None, 0, 0, 0, None
        for frame in frames:
            out = []
            contexts = frame[context] if context else [None] * len(frame)
            for own, n, c in zip(group_keys(frame, group), frame[size], contexts, strict=True):
                if own != key:
                    key, batch, held, total, was = own, 0, 0, 0, None
                if held == 0 or held >= most_items or total + n > most_size or (context and c != was):
                    batch, held, total = batch + 1, 0, 0
                held, total, was = held + 1, total + n, c
                out.append(batch)
                if isolate and n > most_size:
                    held = 0
            yield frame.assign(batch=out)

    return in_order(rows, group, order).mapInPandas(packed, _with(rows, "batch long"))


def in_order(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with each group in one partition and in order there, for a pass that reads it as a stream."""
    return rows.repartition(*group).sortWithinPartitions(*group, *order)


def group_keys(frame: pd.DataFrame, group: list[str]) -> list[tuple]:
    """The group of each row, with null keys equal to each other."""
    columns = [frame[g].astype(object).where(frame[g].notna(), None) for g in group]
    return list(zip(*columns, strict=True))


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [more])


def expand_long(blocks: DataFrame, id_col: str, text_col: str, most: int = 2400) -> DataFrame:
    """Blocks with long ones cut: ``piece`` from 0, ``pieces``, ``separator`` and the piece's own id."""
    rest = [c for c in blocks.columns if c != text_col]
    slim = blocks.select(*rest, text_col)
    schema = StructType([*(slim.schema[c] for c in rest), StructField("pieces", IntegerType()), StructField("piece", IntegerType()), StructField("_separator", StringType()), StructField("_text", StringType())])
    arrow = to_arrow_schema(schema)
    rows = slim.mapInArrow(lambda frames: cut_rows(frames, lambda t: split_keeping_separators(t, most), arrow), schema)
    own = F.when(F.col("pieces") > 1, F.concat(F.col(id_col).cast("string"), F.lit("__segment_"), (F.col("piece") + 1).cast("string"))).otherwise(F.col(id_col).cast("string"))
    return rows.select(*rest, "piece", "pieces", own.alias("piece_id"), F.col("_separator").alias("separator"), F.col("_text").alias(text_col))


def chunk(blocks: DataFrame, group: list[str], order: list[str], text_col: str, tag_col: str, target: int = 10000, hard: int = 500000, look: int = 5) -> DataFrame:
    """``blocks`` with ``tokens`` and ``chunk``: chunks of about ``target`` tokens that end before a heading,
    or go on to one that is fewer than ``look`` blocks away."""
    sized = blocks.withColumn("tokens", estimate_tokens(F.col(text_col)) + 20)

    def chunked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        tokens, heads = frame["tokens"].tolist(), frame[tag_col].str.fullmatch("h[1-6]").fillna(False).tolist()
        out, now, held, i = [0] * len(tokens), 1, 0, 0
        total = 0
        while i < len(tokens):
            if held and total + tokens[i] > hard:
                now, held, total = now + 1, 0, 0
            elif held and total + tokens[i] > target:
                ahead = next((j for j in range(i + 1, min(i + look, len(tokens))) if heads[j]), None)
                if not heads[i] and ahead is not None:
                    for j in range(i, ahead + 1):
                        out[j] = now
                    i, now, held, total = ahead + 1, now + 1, 0, 0
                    continue
                now, held, total = now + 1, 0, 0
            out[i] = now
            held, total, i = held + 1, total + tokens[i], i + 1
        return frame.assign(chunk=out)

    return sized.groupBy(*group).applyInPandas(chunked, _with(sized, "chunk long"))
