"""Trailing velocity on a stream (J3, T2, T5): W2's count, kept current.

Per key one structured value holds the distinct times of the last day with
their counts. Every call on a state store goes from Python to the JVM and back,
so a key costs a micro-batch one read and one write, however many times it has.
Times that no row can reach any more, given the watermark, leave the value; an
event-time timer, set with a key's first rows and set on when it finds newer ones,
clears a key that has been silent for the whole span. The state of a key is thus
bounded by its distinct times within ``seconds`` plus the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: settings that a query with this operator needs at its start
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class TrailingTimes(StatefulProcessor):
    """Counts rows of a key within ``seconds`` up to each row's time, both ends included."""

    def __init__(self, time_col: str, seconds: int, name: str):
        self.time_col, self.name = time_col, name
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<long>, n array<long>")
        self.untimed = handle.getValueState("untimed", "n long")

    def _times(self, b: pd.DataFrame) -> np.ndarray:
        """Microseconds, NaT as the smallest number."""
        return pd.to_datetime(b[self.time_col]).to_numpy("datetime64[us]").astype("int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        none = np.iinfo("int64").min
        chunks = [b for b in rows if len(b)]
        times = [self._times(b) for b in chunks]
        new = np.concatenate(times) if times else np.zeros(0, "int64")
        missing = int((new == none).sum())
        if missing:
            missing += self.untimed.get()[0] if self.untimed.exists() else 0
            self.untimed.update((missing,))
        new, new_n = np.unique(new[new != none], return_counts=True)
        at, n = new, new_n
        if len(new):
            held = self.held.get()
            if held is not None:
                old, old_n = (np.array(v, "int64") for v in held)
                at, where = np.unique(np.concatenate([old, new]), return_inverse=True)
                n = np.zeros(len(at), "int64")
                np.add.at(n, where, np.concatenate([old_n, new_n]))
            else:
                self._set_timer(at)
            self._store(at, n, timerValues.getCurrentWatermarkInMs())
        before = np.concatenate([[0], np.cumsum(n)])
        for b, t in zip(chunks, times):
            count = before[np.searchsorted(at, t, "right")] - before[np.searchsorted(at, np.maximum(t, none + self.span) - self.span, "left")]
            yield b.assign(**{self.name: np.where(t == none, missing, count)})

    def _store(self, at: np.ndarray, n: np.ndarray, watermark_ms: int) -> None:
        """Keep what a later row can reach."""
        if watermark_ms > 0:
            keep = at >= min(int(at[-1]), watermark_ms * 1000) - self.span
            at, n = at[keep], n[keep]
        self.held.update((at.tolist(), n.tolist()))

    def _due(self, at) -> int:
        """Milliseconds at which no row can reach the last time any more."""
        return (int(at[-1]) + self.span) // 1000 + 1

    def _set_timer(self, at) -> None:
        self.handle.registerTimer(self._due(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is not None:
            # newer rows have come since it was set
            if self._due(held[0]) > expiredTimerInfo.getExpiryTimeInMs():
                self._set_timer(held[0])
            else:
                self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def trailing_count_stream(stream: DataFrame, key: str = "customer_id", time_col: str = "ts", seconds: int = 86400,
                          name: str = "tx_freq_24h", watermark: str = "1 hour") -> DataFrame:
    """Every row with the number of its key's rows in ``[t - seconds, t]``, as
    ``features.trailing_count`` (W2) gives it in batch: rows that arrived before or
    with it count. Start the query with :data:`STATE_CONF`. Rows later than the
    watermark are dropped by Spark; rows without a time count the rows of their
    key without one; a null key is a key. One key's rows of a micro-batch are held by one task
    (``maxFilesPerTrigger`` bounds a micro-batch)."""
    out = T.StructType([*stream.schema.fields, T.StructField(name, T.LongType())])
    # as text, so that a null key is a key like any other
    keyed = stream.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    return (keyed.withWatermark(time_col, watermark).groupBy("_key")
            .transformWithStateInPandas(TrailingTimes(time_col, seconds, name), out, "Append", "EventTime"))
