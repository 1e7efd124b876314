"""Isolation forest (M9; Liu, Ting & Zhou 2008).

* Sampling: from a pool of ``trees * max_samples`` rows with the smallest hash
  (all rows where there are fewer), every tree takes exactly ``max_samples``
  distinct rows, those with the smallest hash of (id, tree).
* Fitting: ``groupBy(tree).applyInPandas`` grows one tree per group (groups
  are bounded by ``max_samples`` rows) and emits its nodes.
* Scoring: the node table (at most ``trees * (2 * max_samples - 1)`` rows)
  is broadcast; ``mapInPandas`` walks all trees for each Arrow batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators import stats
from riskframe.session import materialize

EULER = 0.5772156649015329
NODE_SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in [
    ("tree", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()),
    ("threshold", T.DoubleType()), ("left", T.IntegerType()), ("right", T.IntegerType()),
    ("size", T.IntegerType())]])


def avg_path_length(n):
    """c(n): mean path length of an unsuccessful search in a BST of n."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []
    stack = [(0, np.arange(len(x)), 0)]
    feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(x))
    while stack:
        node, idx, depth = stack.pop()
        size[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= t
        ids = []
        for part in (idx[go_left], idx[~go_left]):
            ids.append(len(feat))
            feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(part))
            stack.append((ids[-1], part, depth + 1))
        feat[node], thr[node], left[node], right[node] = f, t, ids[0], ids[1]
    return feat, thr, left, right, size


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame          # tree, node, feature, threshold, left, right, size
    features: list[str]
    max_samples: int
    offset: float | None = None  # score cut-off for the -1/1 flag (contamination)

    def _arrays(self):
        trees = []
        for _, g in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            trees.append(tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size")))
        return trees

    def score(self, df: DataFrame, name: str = "score_samples") -> DataFrame:
        """``score_samples``: the negated anomaly score ``-2^(-E[h]/c(psi))``
        (higher is more normal), like the reference's library."""
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(self._arrays())
        feats, psi = list(self.features), self.max_samples
        norm = float(avg_path_length([psi])[0]) or 1.0

        def run(batches):
            trees = bc.value
            for pdf in batches:
                x = pdf[feats].to_numpy(dtype="float64")
                total = np.zeros(len(x))
                for feat, thr, left, right, size in trees:
                    node = np.zeros(len(x), dtype=np.int64)
                    depth = np.zeros(len(x))
                    active = feat[node] >= 0
                    while active.any():
                        rows = np.flatnonzero(active)
                        nd = node[rows]
                        go_left = x[rows, feat[nd]] <= thr[nd]
                        node[rows] = np.where(go_left, left[nd], right[nd])
                        depth[rows] += 1.0
                        active = feat[node] >= 0
                    total += depth + avg_path_length(size[node])
                pdf[name] = -np.power(2.0, -(total / len(trees)) / norm)
                yield pdf

        schema = T.StructType(list(df.schema.fields) + [T.StructField(name, T.DoubleType(), True)])
        return df.mapInPandas(run, schema)

    def flag(self, scored: DataFrame, score_col: str = "score_samples", name: str = "anomaly_flag") -> DataFrame:
        """-1 (anomaly) when the score is below the contamination offset."""
        return scored.withColumn(name, F.when(F.col(score_col) < F.lit(self.offset), F.lit(-1)).otherwise(F.lit(1)))


def fit(df: DataFrame, features: list[str], trees: int = 200, max_samples: int = 256,
        contamination: float | None = 0.01, seed: int = 42, id_col: str = "transaction_id") -> IsolationForestModel:
    """M9 fit. ``contamination`` sets the flag offset to that quantile of the
    training scores (exact, distributed)."""
    n = df.count()
    psi = int(min(max_samples, max(n, 1)))
    size = min(n, trees * psi)
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000_007))
    pool = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(id_col), h.alias("_h"))
    if size < n:  # a hash filter first, with room to spare; then exactly ``size`` rows
        share = (size + 8 * math.sqrt(size) + 8) / n
        pool = pool.where(F.col("_h") < F.lit(int(min(1.0, share) * 1_000_000_007) + 1))
    pool, _ = materialize(pool.orderBy("_h", id_col).limit(size), "iforest-pool")  # trees * psi rows at most
    # a tree's candidates by a hash filter, then its psi smallest
    room = 1.0 if size <= 4 * psi else min(1.0, (psi + 8 * math.sqrt(psi) + 8) / size)
    pick = F.pmod(F.xxhash64(F.col(id_col), F.col("tree"), F.lit(seed + 1)), F.lit(1_000_000_007))
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_order", pick)
    each = each.where(F.col("_order") <= F.lit(int(room * 1_000_000_007)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_order", id_col))
    assigned = each.withColumn("_rank", rank).where(F.col("_rank") <= psi).select(*features, "tree", "_order")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    feats = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_order")
        rng = np.random.default_rng([seed, t])
        feat, thr, left, right, size = _grow(pdf[feats].to_numpy(dtype="float64"), rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(feat), dtype="int32"), "feature": feat,
                             "threshold": thr, "left": left, "right": right, "size": size}).astype(
            {"tree": "int32", "feature": "int32", "left": "int32", "right": "int32", "size": "int32"})

    nodes = assigned.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = IsolationForestModel(nodes=nodes, features=feats, max_samples=psi)
    if contamination is not None:
        s = model.score(df.select(id_col, *features))
        q = stats.exact_quantiles(s, "score_samples", [contamination], tiebreak=id_col)
        model.offset = q.first()[0]
    return model


def save(model: IsolationForestModel, spark, path: str) -> None:
    """Node table as parquet plus a one-row parameter table."""
    spark.createDataFrame(model.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(",".join(model.features), model.max_samples, model.offset)],
                          "features string, max_samples int, offset double").write.mode("overwrite").parquet(
        f"{path}/params")


def load(spark, path: str) -> IsolationForestModel:
    p = spark.read.parquet(f"{path}/params").first()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    return IsolationForestModel(nodes=nodes, features=p["features"].split(","), max_samples=p["max_samples"],
                                offset=p["offset"])
