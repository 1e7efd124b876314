"""Custom stateful stream operators (T6, T7 on a buffer, X2).

Both use ``applyInPandasWithState`` with plain fields as state. State per key is
bounded: the last N predictions, or a detector's few numbers (Page-Hinkley) or
logarithmically many (ADWIN's exponential histogram). A detector is sequential
by nature: one key's rows of a micro-batch are folded by one task, in order,
vectorised; ``maxFilesPerTrigger`` bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskframe import schema as S
from riskframe.operators.prefix import decayed_sums

BUFFER_STATE = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("preds", T.ArrayType(T.IntegerType())), T.StructField("seen", T.LongType())])


def _key_column(k, dtype: T.DataType) -> pd.Series:
    """One-row column of the group key, null kept."""
    whole = {T.LongType: "Int64", T.IntegerType: "Int32", T.ShortType: "Int16", T.ByteType: "Int8"}
    v = k[0]
    missing = v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v))
    if type(dtype) in whole:
        return pd.Series([pd.NA if missing else int(v)], dtype=whole[type(dtype)])
    return pd.Series([None if missing else v], dtype="object")


def last_n_buffer(scored: DataFrame, key: str = "merchant_id", n: int = 1000, n_windows: int = 10,
                  order: str = "transaction_id") -> DataFrame:
    """T6 (+T7 on the buffer): keep the ``n`` most recent predictions per
    key (most recent = largest ``order`` value, so the result does not
    depend on how rows were cut into micro-batches); emit per key the
    buffer's size, fraud rate, mean probability and the first/last of
    ``n_windows`` equal windows' fraud rates (remainder dropped, as W4). A null
    key is a key; rows with a null order value are the oldest. At most ``n`` rows
    and one Arrow batch are held."""
    dtype = scored.schema[key].dataType
    out_schema = T.StructType([
        T.StructField(key, dtype), T.StructField("seen", T.LongType()),
        T.StructField("buffered", T.IntegerType()), T.StructField("fraud_rate", T.DoubleType()),
        T.StructField("avg_probability", T.DoubleType()), T.StructField("first_window_rate", T.DoubleType()),
        T.StructField("last_window_rate", T.DoubleType())])

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState):
        ids, probs, preds, seen = state.get if state.exists else ([], [], [], 0)
        i, p, y = np.array(ids, "int64"), np.array(probs, "float64"), np.array(preds, "float64")
        for b in batches:
            seen += len(b)
            oldest = np.iinfo("int64").min
            i = np.r_[i, pd.array(b[order], "Int64").fillna(oldest).to_numpy("int64")]
            p = np.r_[p, pd.to_numeric(b["fraud_probability"]).to_numpy("float64", na_value=np.nan)]
            y = np.r_[y, pd.to_numeric(b["prediction"]).to_numpy("float64", na_value=np.nan)]
            top = np.argsort(i, kind="stable")[-n:]
            i, p, y = i[top], p[top], y[top]
        state.update((i.tolist(), [None if np.isnan(x) else float(x) for x in p], [None if np.isnan(x) else int(x) for x in y], int(seen)))
        length = len(y) // n_windows

        def mean(x):
            x = x[~np.isnan(x)]
            return float(x.mean()) if len(x) else None

        first = mean(y[:length])
        last = mean(y[(n_windows - 1) * length:n_windows * length])
        yield pd.DataFrame({key: _key_column(k, dtype), "seen": [int(seen)], "buffered": [len(y)], "fraud_rate": [mean(y)],
                            "avg_probability": [mean(p)], "first_window_rate": [first], "last_window_rate": [last]})

    return scored.select(key, order, "fraud_probability", "prediction").groupBy(key).applyInPandasWithState(
        fold, out_schema, BUFFER_STATE, "update", GroupStateTimeout.NoTimeout)


#: values that a detector folds at a time: at first, and at most
CHUNK = (256, 1 << 16)


class PageHinkleyDetector:
    """X2 detector protocol: ``update_many(x)`` folds values in order and
    returns the positions (1-based, over all values so far) at which drift was
    detected; ``numbers()`` / ``from_numbers()`` turn the state into a flat list
    of doubles and back. Page-Hinkley in both directions with the forgetting
    factor ``alpha``; a detection starts the statistics afresh."""

    def __init__(self, delta: float = 0.005, threshold: float = 50.0, min_instances: int = 30, alpha: float = S.PH_ALPHA):
        self.delta, self.threshold, self.min_instances, self.alpha = delta, threshold, min_instances, alpha
        self.seen = 0
        self._reset()

    def _reset(self) -> None:
        self.n, self.sum, self.m, self.u, self.min_m, self.min_u = 0, 0.0, 0.0, 0.0, np.inf, np.inf

    def update_many(self, x: np.ndarray) -> list[int]:
        found, at, size = [], 0, CHUNK[0]
        while at < len(x):
            # what lies behind a detection is computed again, so a chunk is no longer than what held none before it
            part = x[at:at + size]
            t = self.n + np.arange(1, len(part) + 1)
            total = np.cumsum(np.r_[self.sum, part])[1:]
            mean = total / t
            m = decayed_sums(part - mean - self.delta, self.alpha, self.m)
            u = decayed_sums(mean - part - self.delta, self.alpha, self.u)
            min_m = np.minimum(self.min_m, np.minimum.accumulate(m))
            min_u = np.minimum(self.min_u, np.minimum.accumulate(u))
            hit = np.flatnonzero((t >= self.min_instances) & ((m - min_m > self.threshold) | (u - min_u > self.threshold)))
            if len(hit):
                done = int(hit[0]) + 1
                self.seen += done
                found.append(self.seen)
                self._reset()
                size = CHUNK[0]
            else:
                done = len(part)
                self.seen += done
                self.n, self.sum = int(t[-1]), float(total[-1])
                self.m, self.u, self.min_m, self.min_u = float(m[-1]), float(u[-1]), float(min_m[-1]), float(min_u[-1])
                size = min(2 * size, CHUNK[1])
            at += done
        return found

    def numbers(self) -> list[float]:
        return [float(x) for x in (self.seen, self.n, self.sum, self.m, self.u, self.min_m, self.min_u)]

    def from_numbers(self, v: list[float]) -> None:
        self.seen, self.n = int(v[0]), int(v[1])
        self.sum, self.m, self.u, self.min_m, self.min_u = v[2:]


class AdwinDetector:
    """X2 detector: ADWIN (Bifet & Gavalda 2007) with its exponential
    histogram. The window is a list of buckets (n, sum, sum of squares), oldest
    first; the newest hold ``grain`` values, and when more than ``per_level``
    buckets have one size the two oldest of them merge. The window itself has no
    limit; its state grows with the logarithm of its length. After every
    ``grain`` values all cuts between buckets are tested, and while one is
    significant the oldest bucket goes."""

    def __init__(self, delta: float = 0.002, grain: int = 32, per_level: int = 5, min_window: int = 5):
        self.delta, self.grain, self.per_level, self.min_window = delta, grain, per_level, min_window
        self.seen = 0
        self.pending = np.zeros(0)
        self.buckets: list[tuple[float, float, float]] = []

    def _insert(self, x: np.ndarray) -> None:
        self.buckets.append((float(len(x)), float(x.sum()), float(np.square(x).sum())))
        size = float(self.grain)
        while True:
            same = [i for i, b in enumerate(self.buckets) if b[0] == size]
            if len(same) <= self.per_level:
                break
            i, j = same[0], same[1]
            self.buckets[i:j + 1] = [tuple(a + b for a, b in zip(self.buckets[i], self.buckets[j], strict=True))]
            size *= 2

    def _drifts(self) -> bool:
        b = np.array(self.buckets)
        if len(b) < 2:
            return False
        total = b.sum(axis=0)
        n0, s0 = np.cumsum(b[:-1, 0]), np.cumsum(b[:-1, 1])
        n1 = total[0] - n0
        var = max(0.0, total[2] / total[0] - (total[1] / total[0]) ** 2)
        m = 1.0 / n0 + 1.0 / n1
        d = np.log(2.0 * np.log(total[0]) / self.delta)
        eps = np.sqrt(2.0 * m * var * d) + 2.0 / 3.0 * d * m
        ok = (n0 >= self.min_window) & (n1 >= self.min_window)
        return bool((ok & (np.abs(s0 / n0 - (total[1] - s0) / n1) > eps)).any())

    def update_many(self, x: np.ndarray) -> list[int]:
        x = np.r_[self.pending, x]
        start = self.seen - len(self.pending)
        whole = len(x) // self.grain * self.grain
        found = []
        for i in range(0, whole, self.grain):
            self._insert(x[i:i + self.grain])
            if self._drifts():
                found.append(start + i + self.grain)
                while self._drifts():
                    self.buckets.pop(0)
        self.pending = x[whole:]
        self.seen = start + len(x)
        return found

    def width(self) -> int:
        """Values in the window."""
        return int(sum(b[0] for b in self.buckets)) + len(self.pending)

    def numbers(self) -> list[float]:
        return [float(self.seen), float(len(self.pending)), *map(float, self.pending), *(v for b in self.buckets for v in b)]

    def from_numbers(self, v: list[float]) -> None:
        self.seen, n = int(v[0]), int(v[1])
        self.pending = np.array(v[2:2 + n])
        rest = v[2 + n:]
        self.buckets = [tuple(rest[i:i + 3]) for i in range(0, len(rest), 3)]


DETECTOR_STATE = T.StructType([T.StructField("numbers", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()),
                               T.StructField("detections", T.LongType()), T.StructField("first_at", T.LongType())])


def fold_detector(stream: DataFrame, key: str, value: str, order: str = "transaction_id",
                  factory=PageHinkleyDetector) -> DataFrame:
    """Fold a pluggable detector over each key's values in ``order`` within
    a micro-batch (micro-batches arrive in order). Emits per key the number of
    values, the number of detections and the first detecting position. Null and
    NaN values are left out; a null key is a key."""
    dtype = stream.schema[key].dataType
    out = T.StructType([T.StructField(key, dtype), T.StructField("n", T.LongType()),
                        T.StructField("detections", T.LongType()), T.StructField("first_at", T.LongType())])

    def fold(k, batches, state: GroupState):
        d = factory()
        n = det = 0
        first = None
        if state.exists:
            numbers, n, det, first = state.get
            d.from_numbers(list(numbers))
        # the order holds over all Arrow batches of the micro-batch
        rows = [b[[order, value]] for b in batches]
        pdf = pd.concat(rows).sort_values(order, kind="stable") if rows else pd.DataFrame({order: [], value: []})
        x = pd.to_numeric(pdf[value]).to_numpy("float64", na_value=np.nan)
        x = x[~np.isnan(x)]
        found = d.update_many(x)
        n, det = int(n + len(x)), int(det + len(found))
        first = first if first is not None else (found[0] if found else None)
        state.update((d.numbers(), n, det, first))
        yield pd.DataFrame({key: _key_column(k, dtype), "n": [n], "detections": [det], "first_at": pd.Series([first], dtype="Int64")})

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        fold, out, DETECTOR_STATE, "update", GroupStateTimeout.NoTimeout)
