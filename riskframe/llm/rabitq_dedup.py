"""Operator 9: embedding near-duplicates with randomised-rotation binary codes.

Equal vectors are one class. A class's unit vector is padded, rotated by a
seeded random rotation and reduced to its signs; the stored correction factor is
the inner product of the code with the vector it stands
for. Code times query over factor is an unbiased estimate of the cosine, whose
error is below ``EPSILON * sqrt((1 - f^2) / f^2 / (size - 1))`` but with a
probability that falls as exp(-EPSILON^2). The query side is the other vector in
8-bit steps, whose rounding error adds to the bound.

Pairs to look at come from an index over all classes: ``bands`` samples of
``k`` code bits each, where k follows the logarithm of the number of classes
and the number of bands is the least at which a pair at the threshold misses in
all bands with a chance of at most MISS. As the bands read the same code bits,
that chance is summed over the number of bits on which the pair agrees; the code
is as long as makes the whole index smallest. Vectors that share a band's bits
meet in one bucket. A pair counts in the first band that it shares only, and is
dropped if the bound from either side shows its cosine below the threshold. What
goes on from a bucket are not pairs but its vectors that are in any: their exact
vectors are fetched once for the bucket, its pairs recomputed in double precision,
and each vector's number of links and a spanning forest of the links written. So
a group of n near copies costs n rows, not n^2. Buckets above CELL rows are
cut into chunks that meet two by two, so no task gathers a large bucket and no
pair is lost.

Null vectors, zero vectors and those with null or non-finite components link
with nothing; vectors of different length don't link. Rows with a null id count
as links of others but give a component no name. Repeated rows are copies. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import local_forest
from riskframe.llm.components import connected_components
from riskframe.session import materialize

BITS = 256
EPSILON = 4.0
#: rows of a bucket that meet at once
CELL = 1024
MISS = 0.02
#: unions of links of so many vector lengths are written at once
LENGTHS = 100


def code_sizes(dim: int) -> list[int]:
    """Code bits that vectors of length ``dim`` may have."""
    least = max(BITS, -(-dim // 64) * 64)
    return [least * m for m in (1, 2, 3, 4)]


def rotation(dim: int, size: int | None = None) -> np.ndarray:
    """(size, dim), of BITS rows or more: the columns of a seeded random rotation that act on
    the vector's own coordinates (the padding is zero)."""
    size = size or code_sizes(dim)[0]
    q, r = np.linalg.qr(np.random.default_rng(20240717).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def band_bits(bands: int, k: int, size: int) -> np.ndarray:
    """(bands, k): which code bits each band reads."""
    rng = np.random.default_rng(99)
    return np.stack([rng.choice(size, k, replace=False) for _ in range(bands)])


def miss(bands: int, k: int, size: int, agree: float) -> float:
    """Chance that a pair whose code bits agree with chance ``agree`` each
    shares no band of k out of ``size`` bits."""
    def choose(n: int, m: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1)
    out = 0.0
    for m in range(size + 1):  # bits that agree
        at = math.exp(choose(size, m) + m * math.log(agree) + (size - m) * math.log1p(-agree))
        out += at * (1.0 - (math.exp(choose(m, k) - choose(size, k)) if m >= k else 0.0)) ** bands
    return out


def plan_bands(n: int, threshold: float, dim: int = 1) -> tuple[int, int, int]:
    """(bands, k, code bits) for n classes of length ``dim``: of the code sizes
    the one whose index, a packed code for each class and band, is smallest."""
    k = max(4, round(math.log2(max(2, n))))
    agree = min(1.0 - math.acos(threshold) / math.pi, 1.0 - 1e-9)
    plans = []
    for size in code_sizes(dim):
        low, high = 0, math.ceil(math.log(1.0 / MISS) / agree ** k)
        while miss(high, k, size, agree) > MISS:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if miss(mid, k, size, agree) <= MISS else (mid, high)
        plans.append((high * (size // 8 + 24 + dim), high, k, size))
    return min(plans)[1:]


def encode(vec: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors (n, dim): code bits (n, size) bool, factor, query steps
    int8 (n, dim), step width, and the bound of the query's rounding error."""
    turned = vec @ rot.T
    bits = turned > 0
    factor = np.abs(turned).sum(axis=1) / math.sqrt(rot.shape[0])
    step = np.abs(vec).max(axis=1) / 127.0
    q = np.rint(vec / step[:, None]).astype(np.int8)
    lost = np.linalg.norm(vec - q * step[:, None], axis=1)
    return bits, factor, q, step, lost


class Codes:
    """Codes of a bucket's vectors, from their packed form."""

    def __init__(self, packed: list[bytes], dim: int, rot: np.ndarray):
        size = rot.shape[0]
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        self.words = np.ascontiguousarray(raw[:, : size // 8]).view(np.uint64)
        num = np.ascontiguousarray(raw[:, size // 8: size // 8 + 24]).view(np.float64)
        self.factor, step, self.lost = num[:, 0], num[:, 1], num[:, 2]
        self.query = raw[:, size // 8 + 24:].view(np.int8)[:, :dim] * step[:, None]
        signs = np.unpackbits(raw[:, : size // 8], axis=1).astype(np.float64) * 2 - 1
        # the code, turned back into the vector's own coordinates
        self.back = signs @ rot / math.sqrt(size)
        self.error = EPSILON * np.sqrt(np.maximum(0, 1 - self.factor ** 2) / self.factor ** 2 / (size - 1))

    @staticmethod
    def pack(bits, factor, q, step, lost) -> list[bytes]:
        num = np.stack([factor, step, lost], 1).astype(np.float64)
        body = np.concatenate([np.packbits(bits, axis=1), num.view(np.uint8), q.view(np.uint8)], axis=1)
        return [r.tobytes() for r in body]

    def upper(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the cosine of (own, other), the code taken of ``own``."""
        est = self.back[own] @ self.query[other].T / self.factor[own][:, None]
        norm = np.linalg.norm(self.back[own], axis=1) / self.factor[own]
        return est + self.error[own][:, None] + norm[:, None] * self.lost[other][None, :]


def bucket_pairs(codes: Codes, side: np.ndarray, masks: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket (or of two chunks of one: ``side`` 0 and 1) that meet
    first in ``band`` and may reach the threshold."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    square = not len(right)
    right = left if square else right
    may = (codes.upper(left, right) >= threshold) & (codes.upper(right, left).T >= threshold)
    i, j = np.nonzero(np.triu(may, 1) if square else may)
    a, b = left[i], right[j]
    new = np.ones(len(a), bool)
    for m in masks[:band]:  # bands before this one
        at = np.flatnonzero(new)
        if not len(at):
            break
        new[at] = (((codes.words[a[at]] ^ codes.words[b[at]]) & m) != 0).any(axis=1)
    return a[new], b[new]


_CELL_KEY = ["band", "key", "ci", "cj"]


def by_cell(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work`` on the whole rows of a cell, for sorted batches whose first four
    columns are the cell's key and the fifth the side: ``work(key, side, rows)``
    gives record batches. Cells with one row, or one side of two, are passed over."""
    def cells(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k4 = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
        first = np.flatnonzero(np.r_[True, (k4[1:] != k4[:-1]).any(axis=1)])
        ends = np.r_[first[1:], len(k4)]
        side = t.column(4).to_numpy()
        for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
            if k4[a, 2] == k4[a, 3] or side[a:b].min() != side[a:b].max():
                yield from work(k4[a], side[a:b], t.slice(a, b - a))

    kept = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        if not t.num_rows:
            continue
        last = [t.column(i)[-1].as_py() for i in range(4)]
        tail = np.logical_and.reduce([t.column(i).to_numpy() == last[i] for i in range(4)])
        cut = int(np.argmax(tail))  # the last cell may go on in the next batch
        if cut:
            yield from cells(t.slice(0, cut))
        kept = t.slice(cut)
    if kept is not None and kept.num_rows:
        yield from cells(kept)


def band_links(classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """Links of ``classes`` (rid long, vec array of length ``dim``, copies long),
    as rows (a, b, n): with n, a part of the number of rows that ``a`` is linked
    to (b null); without, a link of the spanning forest of a cell."""
    bands, k, size = plan_bands(n, threshold, dim)
    rot = rotation(dim, size)
    bits_of = band_bits(bands, k, size)
    masks = np.zeros((bands, size), bool)
    np.put_along_axis(masks, bits_of, True, axis=1)
    masks = np.packbits(masks, axis=1).view(np.uint64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits, *rest = encode(matrix(b.column(1), dim), rot)
                weight = 1 << np.arange(k, dtype=np.int64)
                keys = [(bits[:, own] * weight).sum(axis=1) for own in bits_of]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(Codes.pack(bits, *rest), pa.binary()), pa.array(list(np.stack(keys, 1)))],
                    ["rid", "code", "keys"])

    coded, _ = materialize(classes.select("rid", "vec").mapInArrow(code, "rid long, code binary, keys array<long>"), "rabitq-codes")
    rows = coded.select("rid", "code", F.posexplode("keys").alias("band", "key"))
    large, _ = materialize(coded.select(F.posexplode("keys").alias("band", "key")).groupBy("band", "key").count()
                           .where(F.col("count") > CELL), "rabitq-large")
    if large.isEmpty():
        cells = rows.select("*", F.lit(0).alias("ci"), F.lit(0).alias("cj"), F.lit(0).alias("side"))
    else:  # chunk c meets chunk j in cell (min, max); its own cell is (c, c)
        m = F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1)).cast("int")
        cells = (rows.join(large, ["band", "key"], "left").withColumn("m", m)
                 .withColumn("c", F.pmod(F.xxhash64("rid"), F.col("m")).cast("int"))
                 .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
                 .select("rid", "code", "band", "key", F.least("c", "j").alias("ci"), F.greatest("c", "j").alias("cj"),
                         (F.col("c") > F.col("j")).cast("int").alias("side")))

    def dealt(df: DataFrame, *cols: str) -> DataFrame:
        return df.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY, "rid").select(*_CELL_KEY, "side", *cols)

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(key, side, t):
            i, j = bucket_pairs(Codes(t.column(6).to_pylist(), dim, rot), side, masks, int(key[0]), threshold - 1e-9)
            if len(i):
                yield t.select(range(6)).take(np.unique(np.r_[i, j])).combine_chunks().to_batches()[0]

        return by_cell(batches, work)

    members = dealt(cells, "rid", "code").mapInArrow(involved, "band int, key long, ci int, cj int, side int, rid long")
    members, _ = materialize(members, "rabitq-members")
    known = members.join(coded.select("rid", "code"), "rid").join(classes.select("rid", "vec", "copies"), "rid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(key, side, t):
            i, j = bucket_pairs(Codes(t.column(6).to_pylist(), dim, rot), side, masks, int(key[0]), threshold - 1e-9)
            rid, copies = t.column(5).to_numpy(), t.column(8).to_numpy()
            vec = matrix(t.column(7).combine_chunks(), dim)
            ok = np.zeros(len(i), bool)
            for s in range(0, len(i), 100_000):
                ok[s:s + 100_000] = np.einsum("ij,ij->i", vec[i[s:s + 100_000]], vec[j[s:s + 100_000]]) >= threshold
            i, j = i[ok], j[ok]
            if not len(i):
                return
            n = np.bincount(i, weights=copies[j], minlength=len(rid)) + np.bincount(j, weights=copies[i], minlength=len(rid))
            some = np.flatnonzero(n)
            node, root = local_forest(rid[i], rid[j])
            node, root = node[node != root], root[node != root]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[rid[some], root]), pa.array([None] * len(some) + node.tolist(), pa.int64()),
                 pa.array(n[some].astype(np.int64).tolist() + [None] * len(node), pa.int64())], ["a", "b", "n"])

        return by_cell(batches, work)

    return dealt(known, "rid", "code", "vec", "copies").mapInArrow(verify, "a long, b long, n long")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors (rows, dim) of an Arrow list column, in double precision."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def unit(vec: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision and without overflow."""
    vec = vec / np.abs(vec).max(axis=1, keepdims=True)
    return vec / np.linalg.norm(vec, axis=1, keepdims=True)


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``table``."""
    spark = table.sparkSession
    # single precision stays as it is; everything else is compared as doubles
    kind = "float" if table.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    good = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        "vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(good, F.transform("vec", lambda x: x + F.lit(0).cast(kind))))  # -0.0 is 0.0
    classes, _ = materialize(rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("copies"),
                                                                              F.min("vec_id").alias("low"))
                             .withColumn("rid", F.monotonically_increasing_id()), "rabitq-classes")
    sizes = classes.groupBy(F.size("vec").alias("dim")).count().where("count > 1").collect()  # a row for each length
    links = [spark.createDataFrame([], "a long, b long, n long")]
    for r in sorted(sizes, key=lambda r: r["dim"]):
        links.append(band_links(classes.where(F.size("vec") == r["dim"]), r["dim"], r["count"], threshold))
        if len(links) > LENGTHS:
            links = [materialize(reduce(DataFrame.unionByName, links), "rabitq-links")[0]]
    links, _ = materialize(reduce(DataFrame.unionByName, links), "rabitq-links")
    degree = links.where("n is not null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("outer"))
    roots = connected_components(links.where("n is null"), "a", "b").select(F.col("node").alias("rid"), "root")
    named = classes.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    info = (named.join(low, "root").join(degree, "rid", "left")
            .select("vec", (F.col("copies") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.join(info, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
