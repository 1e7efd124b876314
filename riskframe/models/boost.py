"""Second-order boosted trees on histograms (M5; Chen & Guestrin 2016).

The rows are binned once (quantile edges, a byte a feature) and written as
blocks with label, weight and margin. A tree grows level by level: every task
walks its blocks through the tree so far and adds up gradients and Hessians by
(node, feature, bin), one small table a task; Spark sums these tables, a window
over a feature's bins gives the gain of every cut, and the best cut of each node (at
most ``2^depth`` rows) comes back to the driver. Rows never move. Margins are
written anew every FLUSH trees; between two writes the newest trees are walked
again.

Gradients are whole numbers (a 2^30th of the largest weight), so sums don't
depend on how rows are dealt, and a tree is the same on any number of tasks.

Objective: logistic loss; gain ``(GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) / 2 - gamma``
with at least ``min_child`` of Hessian on both sides, leaves ``-rate G/(H+l)``; rows and columns
are sampled per tree. NaN and null values go to the lowest bin. Rows without a label
are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import drop_path, materialize

BINS, FLUSH = 64, 10
UNIT = float(1 << 30)
_BLOCK = "block long, n int, bins binary, y binary, w binary, margin binary"


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i+1, 2i+2): feature (-1 at a leaf),
    last bin that goes left, and leaf value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row of ``bins`` (features, rows) in the tree so far."""
        at = np.zeros(bins.shape[1], np.int64)
        rows = np.arange(bins.shape[1])
        while True:
            f = self.feature[at]
            live = f >= 0
            if not live.any():
                return at
            r, n = rows[live], at[live]
            at[live] = 2 * n + 1 + (bins[f[live], r] > self.cut[n])


@dataclass
class BoostModel:
    """Fitted trees; ``score`` adds ``p_<name>``."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins (features, rows) of values (rows, features): 0 for NaN, else one
        more than the number of edges below."""
        out = np.zeros((len(self.edges), len(x)), np.uint8)
        for f, e in enumerate(self.edges):
            v = x[:, f]
            out[f] = np.where(np.isnan(v), 0, np.searchsorted(e, v, "left") + 1)
        return out

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1])
        for t in self.trees:
            out += t.value[t.nodes(bins)]
        return out

    def score(self, df: DataFrame, name: str = "boost") -> DataFrame:
        """Probability of class 1 (vectorised; the model is of fixed size)."""
        model = self

        @F.pandas_udf("double")
        def probability(*cols: pd.Series) -> pd.Series:
            x = np.stack([pd.to_numeric(c).to_numpy("float64", na_value=np.nan) for c in cols], 1)
            return pd.Series(1.0 / (1.0 + np.exp(-model.margin(model.bin(x)))))

        return df.withColumn(f"p_{name}", probability(*[F.col(c).cast("double") for c in self.features]))

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges],
                           "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> BoostModel:
        d = json.loads(text)
        return BoostModel(d["features"], [np.array(e, float) for e in d["edges"]],
                          [Tree(np.array(f, np.int64), np.array(c, np.int64), np.array(v, float)) for f, c, v in d["trees"]])


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins - 2`` edges a feature, from quantile sketches (columns x
    ``bins`` numbers); the largest value is no edge, as nothing lies beyond it."""
    probs = [i / (bins - 1) for i in range(1, bins)]
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    return [np.unique(q)[:-1] if q else np.zeros(0) for q in clean.approxQuantile(features, probs, 0.1 / bins)]


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in whole UNITs of the largest weight."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * w / top * UNIT).astype(np.int64), np.rint(p * (1.0 - p) * w / top * UNIT).astype(np.int64)


def _blocks(train: DataFrame, model: BoostModel, label: str, weight: str | None) -> tuple[DataFrame, str]:
    d = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.num_rows:
                cols = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]
                row = [(part << 32) + k, b.num_rows, model.bin(np.stack(cols[:d], 1)).tobytes(), cols[d].astype(np.uint8).tobytes(),
                       cols[d + 1].tobytes(), np.zeros(b.num_rows).tobytes()]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int32()] + [pa.binary()] * 4)],
                                                 ["block", "n", "bins", "y", "w", "margin"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double") for c in model.features],
                                                        F.col(label).cast("double").alias("_y"), w.alias("_w"))
    return materialize(rows.mapInArrow(run, _BLOCK), "boost-blocks")


def _open(b: pa.RecordBatch, r: int, d: int):
    block, n = b.column(0)[r].as_py(), b.column(1)[r].as_py()
    bins = np.frombuffer(b.column(2)[r].as_py(), np.uint8).reshape(d, n)
    y, w, m = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in ((3, np.uint8), (4, np.float64), (5, np.float64)))
    return block, bins, y, w, m


def _histograms(blocks: DataFrame, d: int, recent: list[Tree], tree: Tree, level: list[int], columns: list[int], top: float,
                subsample: float, seed: tuple[int, int]) -> DataFrame:
    """(node, feature, bin, g, h): sums of one level's nodes, a small table a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[level] = np.arange(len(level))
        total = np.zeros((2, len(level), len(columns), 256), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                block, bins, y, w, margin = _open(b, r, d)
                margin = margin + sum((t.value[t.nodes(bins)] for t in recent), np.zeros(len(y)))
                at = place[tree.nodes(bins)]
                if subsample < 1.0:
                    at[np.random.default_rng((*seed, block)).random(len(at)) >= subsample] = -1
                some = at >= 0
                gh = gradients(y[some], w[some], margin[some], top)
                for k, f in enumerate(columns):
                    cell = at[some] * 256 + bins[f, some]
                    for which in (0, 1):  # sums below 2^53 in a block: exact in doubles
                        total[which, :, k] += np.bincount(cell, gh[which], len(level) * 256).astype(np.int64).reshape(-1, 256)
        node, k, cell = np.nonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(level)[node], pa.int32()), pa.array(np.array(columns)[k], pa.int32()),
                                          pa.array(cell, pa.int32()), *[pa.array(t[node, k, cell]) for t in total]],
                                         ["node", "feature", "bin", "g", "h"])

    parts = blocks.mapInArrow(run, "node int, feature int, bin int, g long, h long")
    wide = "decimal(38,0)"
    return parts.groupBy("node", "feature", "bin").agg(*[(F.sum(F.col(c).cast(wide)).cast("double") * (top / UNIT)).alias(c) for c in "gh"])


def _best_cuts(hist: DataFrame, min_child: float, reg: float) -> list:
    """Of each node its sums and best cut: (node, gain, -feature, -bin, G, H)."""
    order = Window.partitionBy("node", "feature").orderBy("bin")  # at most 256 rows
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")
    gl, hl, g, h = (F.sum(c).over(w) for w in (upto, whole) for c in ("g", "h"))
    c = hist.select("node", "feature", "bin", gl.alias("gl"), hl.alias("hl"), g.alias("gt"), h.alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    gain = F.col("gl") * F.col("gl") / (F.col("hl") + reg) + gr * gr / (hr + reg) - F.col("gt") * F.col("gt") / (F.col("ht") + reg)
    ok = (F.col("hl") >= min_child) & (hr >= min_child)
    # ties go to the first feature and bin
    best = F.struct(F.when(ok, F.round(gain, 9)).otherwise(F.lit(float("-inf"))).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
                    F.col("gt").alias("G"), F.col("ht").alias("H"))
    return c.groupBy("node").agg(F.max(best).alias("x")).select("node", "x.*").collect()


def fit(train: DataFrame, features: list[str], label: str = "Class", weight: str | None = "weight", rounds: int = 1000, depth: int = 6,
        rate: float = 0.1, subsample: float = 0.9, colsample: float = 0.9, min_child: float = 3.0, gamma: float = 0.0, reg: float = 1.0,
        bins: int = BINS, seed: int = 42) -> BoostModel:
    """M5 with the reference's parameters by default. ``depth + 1`` jobs a tree."""
    if not 3 <= bins <= 256:
        raise ValueError("3 to 256 bins")
    spark, d = train.sparkSession, len(features)
    model = BoostModel(list(features), bin_edges(train, features, bins), [])
    blocks, path = _blocks(train, model, label, weight)
    top = train.where(F.col(label).isNotNull()).agg(F.max(F.col(weight).cast("double")) if weight else F.lit(1.0)).first()[0]
    if not top:
        drop_path(spark, path)
        return model
    flushed = 0
    for number in range(rounds):
        rng = np.random.default_rng((seed, number))
        columns = sorted(rng.choice(d, max(1, round(colsample * d)), replace=False).tolist())
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
        level = [0]
        for deep in range(depth + 1):
            hist = _histograms(blocks, d, model.trees[flushed:], tree, level, columns if deep < depth else columns[:1], top, subsample, (seed, number))
            nxt = []
            for node, gain, f, b, g, h in _best_cuts(hist, min_child, reg):
                if deep < depth and gain / 2.0 - gamma > 0.0:
                    tree.feature[node], tree.cut[node] = -f, -b
                    nxt += [2 * node + 1, 2 * node + 2]
                else:
                    tree.value[node] = -rate * g / (h + reg)
            level = sorted(nxt)
            if not level:
                break
        model.trees.append(tree)
        if len(model.trees) - flushed >= FLUSH and number + 1 < rounds:
            blocks, new = _flush(blocks, d, model.trees[flushed:])
            drop_path(spark, path)
            path, flushed = new, len(model.trees)
    drop_path(spark, path)
    return model


def _flush(blocks: DataFrame, d: int, recent: list[Tree]) -> tuple[DataFrame, str]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in range(b.num_rows):
                _, bins, _, _, margin = _open(b, r, d)
                made.append((margin + sum((t.value[t.nodes(bins)] for t in recent), np.zeros(len(margin)))).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(made, pa.binary())], b.schema.names)

    return materialize(blocks.mapInArrow(run, _BLOCK), "boost-blocks")
