"""A keyed cache with a time to live, as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ANSWER = StructType([StructField("call_id", LongType()), StructField("key", StringType()), StructField("value", StringType())])


class Cache(StatefulProcessor):
    """Per key the last value put; a value is gone ``live_ms`` after it was put, and no read sees it then.

    The state store drops expired values by itself, so keys that nobody asks for do not stay."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", StructType([StructField("value", StringType())]), ttlDurationMs=self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values("call_id")
        ids, values = [], []
        for call, put in zip(calls["call_id"].tolist(), calls["put"].tolist(), strict=True):
            if put is not None and not pd.isna(put):
                self.entry.update((put,))
            else:
                ids.append(call)
                values.append(self.entry.get()[0] if self.entry.exists() else None)
        # plain objects: what a stream gives back may not hold strings in Arrow's own arrays
        yield pd.DataFrame({"call_id": ids, "key": pd.Series([key[0]] * len(ids), dtype=object), "value": pd.Series(values, dtype=object)})

    def close(self) -> None:
        pass


def answered(calls: DataFrame, live_ms: int) -> DataFrame:
    """(call_id, key, value) for each read of ``calls`` (call_id, key, put; put is null for a read): the value that
    was put last, null where there is none or it has expired.  Needs the state store that keeps expiry times
    (``spark.sql.streaming.stateStore.providerClass`` of RocksDB), and a trigger that ends: while time passes there is
    always another batch to run, so ``availableNow`` does not."""
    return calls.groupBy("key").transformWithStateInPandas(Cache(live_ms), ANSWER, "Append", "ProcessingTime")
