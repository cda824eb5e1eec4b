"""Lines and events of byte chunks that are cut anywhere, as a batch and as a stream.

A line ends with a line feed; what follows the last one waits for more.  Characters may be cut too, so chunks are
bytes and only whole lines are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import ledger

LINE_SCHEMA = "stream_id long, line long, text string"


def lines(chunks: DataFrame) -> DataFrame:
    """(stream_id, line, text) of chunks (stream_id, seq, chunk), a segmented scan.

    Each part of a chunk between line feeds belongs to the line whose number is that of the line feeds before it in
    the stream; the parts of a line are put together, and the line that no line feed has ended yet is left out."""
    # a character for each byte, so that text functions cut where bytes end
    parts = chunks.select("stream_id", "seq", F.split(F.decode("chunk", "ISO-8859-1"), "\n", -1).alias("parts")).withColumn("ends", (F.size("parts") - 1).cast("long"))
    placed = ledger.running_sum(parts, ["stream_id"], ["seq"], "ends", "before")
    cut = placed.select("stream_id", "seq", "ends", "before", F.posexplode("parts").alias("i", "part")).withColumn("line", F.col("before") + F.col("i"))
    # of equal places in one chunk there is one part
    whole = cut.groupBy("stream_id", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "part"))), lambda x: x["part"]), "").alias("bytes"), F.bool_or(F.col("i") < F.col("ends")).alias("ended")
    )
    return whole.where("ended").select("stream_id", "line", F.decode(F.encode("bytes", "ISO-8859-1"), "UTF-8").alias("text"))


def lines_as_they_come(chunks: DataFrame) -> DataFrame:
    """The same of a stream: per stream the state is the unfinished line, the number of lines and the next chunk's
    number; a chunk that comes again is passed over."""

    def frame(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        rest, done, last = state.get if state.exists else (b"", 0, None)
        found = []
        for seq, chunk in zip(rows["seq"].tolist(), rows["chunk"].tolist(), strict=True):
            if last is not None and seq <= last:
                continue
            *ended, rest = (bytes(rest) + bytes(chunk or b"")).split(b"\n")
            found += [x.decode("utf-8", "replace") for x in ended]
            last = int(seq)
        state.update((bytes(rest), done + len(found), last))
        yield pd.DataFrame({"stream_id": [key[0]] * len(found), "line": range(done, done + len(found)), "text": found})

    return chunks.select("stream_id", "seq", "chunk").groupBy("stream_id").applyInPandasWithState(frame, LINE_SCHEMA, "rest binary, done long, last long", "append", GroupStateTimeout.NoTimeout)


def event_data(text: Column) -> Column:
    """What an event line carries behind ``data:``; null for other lines and for the end mark."""
    body = F.when(text.startswith("data:"), F.btrim(F.substr(text, F.lit(6)), F.lit(" \r")))
    return F.when(body != "[DONE]", body)
