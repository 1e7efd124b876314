"""Operator 6: language identification by sparse multinomial logistic
regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text's code points (with a
boundary mark at both ends), hashed into ``2 ** BITS`` slots; a slot's value is
its share of the text's n-grams times its inverse document frequency. Document
frequencies cover all training rows. The weights are learned on a bounded,
hash-chosen sample of the training rows (``train_rows``, spread evenly over the
labels) with follow-the-regularised-leader (per-coordinate steps) under an
elastic net, whose l1 part keeps most weights zero; a temperature fitted on the
part of the sample left out of the fit calibrates the scores.

A null text or one without a letter is ``und`` with score 0. With no training
rows at all, every row is ``und``. Training rows need a text with a letter and a
non-null label. Ties between labels go to the alphabetically first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from riskframe.llm.common import blocks, small_batches

BITS = 16
#: code point that marks the ends of a text: the last one, which no writing uses
EDGE = 0x10FFFF
#: odd multipliers of the three places of an n-gram, and of the final mix
PLACE = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
MIX = np.uint32(0x27D4EB2F)
#: slot of what belongs to no text
NONE = 1 << BITS
#: text bytes whose n-grams are hashed at a time
CHARS_AT_ONCE = 500_000
#: learning-rate, smoothing and elastic-net parameters of the learner
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 0.002, 0.0005, 4


def ngram_slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots of all 1-, 2- and 3-grams of the joined ``texts`` (an array for
    each order; NONE where one would reach over a text's end), and where each
    text's slots start in them."""
    edge = chr(EDGE)
    buf = np.frombuffer((edge + edge.join(t.lower().replace(edge, " ") for t in texts) + edge)
                        .encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = np.flatnonzero(buf == EDGE)  # one before each text and one after the last
    a, b, c = buf[:-1] * PLACE[0], buf * PLACE[1], buf * PLACE[2]
    grams = [a, a + b[1:], a + b[1:] + np.r_[c[2:], np.uint32(0)]]
    out = []
    for n, g in enumerate(grams):
        g = g + np.uint32(n + 1)
        g ^= g >> np.uint32(15)
        out.append((g * MIX >> np.uint32(32 - BITS)).astype(np.int64))
    out[0][marks[:-1]] = NONE  # the mark itself
    out[2][marks[1:] - 1] = NONE  # over the mark into the next text
    return out, marks[:-1]


def slots_by_text(texts: list[str]) -> Iterator[np.ndarray]:
    """All slots of each text, NONE among them."""
    grams, starts = ngram_slots(texts)
    ends = [*starts[1:].tolist(), len(grams[0])]
    for i, j in zip(starts.tolist(), ends, strict=True):
        yield np.concatenate([g[i:j] for g in grams])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Fitted model: labels, one weight row per label on TF (idf folded in, 0 for NONE),
    biases and temperature. Its size depends on BITS and the labels only."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        grams, starts = ngram_slots(texts)
        n = 3 * np.diff(np.r_[starts, len(grams[0])]) - 2  # all but the mark and the gram over the end
        out = np.empty((len(texts), len(self.labels)))
        for k, w in enumerate(self.weights):
            out[:, k] = sum(np.add.reduceat(w[g], starts) for g in grams) / n + self.bias[k]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text."""
        labels, scores = ["und"] * len(texts), np.zeros(len(texts))
        good = [i for i, t in enumerate(texts) if self.labels and has_letter(t)]
        for a, b in blocks([texts[i] for i in good], CHARS_AT_ONCE):
            z = self.logits([texts[i] for i in good[a:b]]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for row, i in enumerate(good[a:b]):
                labels[i], scores[i] = self.labels[best[row]], p[row, best[row]]
        return labels, scores


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of ``texts`` (one string column) each slot occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(NONE, np.int64), np.zeros(NONE + 1, bool), 0
        for b in batches:
            rows = [t for t in b.column(0).to_pylist() if has_letter(t)]
            for i, j in blocks(rows, CHARS_AT_ONCE):
                for own in slots_by_text(rows[i:j]):
                    seen[:] = False
                    seen[own] = True
                    df += seen[:NONE]
            n += len(rows)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["slot", "n"])

    # at most one row per slot and partition, then one per slot: bounded by BITS
    rows = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()  # slot -1 is the last entry: the row count
    return out


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (k, slots) and biases by follow-the-regularised-leader on
    sparse rows (slot, value)."""
    d = (1 << BITS) + 1  # the last coordinate is the bias, without penalty
    z, n = np.zeros((k, d)), np.zeros((k, d))

    def solve(at):
        zz, step = z[:, at], (BETA + np.sqrt(n[:, at])) / ALPHA
        w = -(zz - np.sign(zz) * L1) / (step + L2)
        w[np.abs(zz) <= L1] = 0.0
        w[:, -1] = -zz[:, -1] / step[:, -1]
        return w

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.r_[at, d - 1], np.r_[x, 1.0]
            w = solve(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            g = p[:, None] * x[None, :]
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    full = solve(np.arange(d))
    return full[:, :-1], full[:, -1]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, on a fixed grid."""
    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 20, 121).tolist(), key=loss) if len(y) else 1.0


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", train_rows: int = 4000,
        max_labels: int = 1000) -> LanguageModel:
    """Fit on the rows of ``train`` that have a label and a letter. The weights
    see at most about ``train_rows`` rows, the same share of each label's rows
    up to ``train_rows / labels``, chosen by a hash; document frequencies and
    label counts see all rows."""
    small_batches(train)
    rows = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("y")).where(
        "t is not null and y is not null")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().limit(max_labels + 1).collect()}
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros((0, NONE + 1)), np.zeros(0), 1.0)
    df = document_frequencies(rows.select("t"))
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0

    # a row is in the sample if its text's hash is in the lowest part, by label
    each = max(1, train_rows // len(labels))
    limit = F.lit(0)
    for y in labels:
        limit = F.when(F.col("y") == y, F.lit(int(min(1.0, each / counts[y]) * 1_000_000))).otherwise(limit)
    pick: Column = F.pmod(F.xxhash64("t", F.lit("sample")), F.lit(1_000_000)) < limit
    index = {y: i for i, y in enumerate(labels)}

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, val, keep = [], [], []
            for t, y in zip(texts, ys, strict=True):
                if has_letter(t):
                    own = next(slots_by_text([t]))
                    slots, n = np.unique(own[own != NONE], return_counts=True)
                    at.append(slots.astype(np.int32).tobytes())
                    val.append((n / n.sum()).astype(np.float32).tobytes())
                    keep.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.binary()), pa.array(val, pa.binary()), pa.array(keep, pa.string())], ["at", "tf", "y"])

    # bounded: train_rows rows of at most 2**BITS slots each; equal texts share a hash and so come or go together
    sample = rows.where(pick).dropDuplicates(["t", "y"]).mapInArrow(featurise, "at binary, tf binary, y string")
    got = sorted((r["y"], bytes(r["at"]), bytes(r["tf"])) for r in sample.limit(4 * train_rows).collect())
    x, y = [], []
    for label, at, tf in got:
        at = np.frombuffer(at, np.int32)
        x.append((at, np.frombuffer(tf, np.float32).astype(np.float64) * idf[at]))
        y.append(index[label])
    y = np.array(y, np.int64)
    out = np.arange(len(x)) % 5 == 4  # for the temperature
    fit_at, cal_at = np.flatnonzero(~out), np.flatnonzero(out)
    w, bias = fit_ftrl([x[i] for i in fit_at], y[fit_at], len(labels))
    z = np.array([[float(w[k][x[i][0]] @ x[i][1]) + bias[k] for k in range(len(labels))] for i in cal_at])
    weights = np.pad(w * idf, ((0, 0), (0, 1)))  # NONE weighs nothing
    return LanguageModel(labels, weights, bias, _temperature(z, y[cal_at]))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text",
            label_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted label and its probability; all columns stay
    (two new names that clash are an error)."""
    if {label_out, score_out} & set(docs.columns):
        raise ValueError("output column exists already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS x labels floats
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(label_out, StringType()), StructField(score_out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(label, pa.string()), pa.array(score, pa.float64())],
                [*b.schema.names, label_out, score_out])

    return docs.mapInArrow(run, schema)
