"""Operator 10: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a point within half the radius of
both. Every fingerprint therefore stands for all variants with at most
``radius // 2`` flipped bits, and fingerprints that share a variant are at most
``radius`` apart; the colliding pairs are verified by their bit distance.

The shuffle on variants is done in two steps, so that 2081 variants for each
fingerprint needn't be written out: the key is the variant's leading ``t``
bits (a fingerprint goes to 1 + t + t(t-1)/2 keys), and the task that gets a
key makes the variants with that prefix, sorts them and links the collisions.
``t`` grows with the number of fingerprints, so that a key's share stays the
same size. A key that still gets too many (many near copies) writes out its
whole variants instead; at most 1 + 64 + 2016 fingerprints share one of those.

Nulls and texts without words have fingerprint zero and link like any other.
Rows with a null id get the component of their fingerprint; repeated rows are
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import local_forest, small_batches, text_bytes
from riskframe.llm.components import connected_components
from riskframe.session import materialize

#: fingerprints that a key is meant to get, and beyond which its variants are written out
KEY_ROWS, KEY_ROWS_MAX = 32_000, 96_000
#: variants that a task makes and sorts at a time
VARIANTS_AT_ONCE = 1_000_000
#: shingles whose bits are counted at a time
HASHES_AT_ONCE = 65_536


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text: A-Z lower-cased, words between ASCII
    white space, space-joined word shingles (repeats count), XXH64; a bit is
    set if more than half of the hashes have it. No word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    m = len(starts)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, m, HASHES_AT_ONCE):
        at = zip(starts[i:i + HASHES_AT_ONCE], ends[i:i + HASHES_AT_ONCE], strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in at], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long): one row for each row of ``docs``."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _masks(bits: int, flips: int) -> list[int]:
    """All masks over the lowest ``bits`` bits with at most ``flips`` set."""
    return [sum(1 << i for i in c) for k in range(flips + 1) for c in itertools.combinations(range(bits), k)]


def prefix_bits(n: int, flips: int) -> int:
    """Smallest prefix for which ``n`` spread fingerprints give a key no more
    than KEY_ROWS of them."""
    for t in range(4, 49):
        if n * sum(math.comb(t, k) for k in range(flips + 1)) / 2 ** t <= KEY_ROWS:
            return t
    return 48


def _link_key(fps: np.ndarray, key: int, t: int, flips: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger; a spanning forest) between the fingerprints of
    one key, from the variants whose leading ``t`` bits are ``key``."""
    fps = np.unique(fps)
    low = 64 - t
    apart = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(key)).astype(int)
    suffix = fps & np.uint64((1 << low) - 1)
    by_flips = {d: np.array(_masks(low, flips - d), np.uint64) for d in range(flips + 1)}
    total = sum(int((apart == d).sum()) * len(m) for d, m in by_flips.items())
    s = max(0, math.ceil(math.log2(max(1, total / VARIANTS_AT_ONCE))))
    # a linear hash of s bits splits the variants: hash(x ^ m) = hash(x) ^ hash(m)
    taps = np.random.default_rng(7).integers(0, 1 << low, size=s, dtype=np.uint64)

    def linear(x):
        out = np.zeros(len(x), np.int64)
        for i, tap in enumerate(taps):
            out |= (np.bitwise_count(x & tap).astype(np.int64) & 1) << i
        return out

    class_f, class_m = linear(suffix), {d: linear(m) for d, m in by_flips.items()}
    left, right = [], []
    for part in range(1 << s):
        var, who = [], []
        for d, m in by_flips.items():
            for c in range(1 << s):
                own = np.flatnonzero((apart == d) & (class_f == c))
                use = m[class_m[d] == (part ^ c)]
                if len(own) and len(use):
                    var.append((suffix[own][:, None] ^ use[None, :]).ravel())
                    who.append(np.repeat(own, len(use)))
        if not var:
            continue
        var, who = np.concatenate(var), np.concatenate(who)
        order = np.argsort(var, kind="stable")
        var, who = var[order], who[order]
        first = np.flatnonzero(np.r_[True, var[1:] != var[:-1]])
        run = np.diff(np.r_[first, len(var)])
        shared = np.repeat(run > 1, run)
        if not shared.any():
            continue
        head = np.repeat(np.minimum.reduceat(who, first), run)
        pair = np.unique(np.stack([head[shared], who[shared]], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        near = np.bitwise_count(fps[pair[:, 0]] ^ fps[pair[:, 1]]) <= radius  # verify
        left.append(pair[near, 0])
        right.append(pair[near, 1])
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    node, root = local_forest(np.concatenate(left), np.concatenate(right))
    keep = node != root
    return fps[root[keep]], fps[node[keep]]


def ball_links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints ``fps`` (column
    fp, ``n`` rows, long) that are at most ``radius`` bits apart, directly or
    through others; each link is verified or follows from verified ones."""
    flips = radius // 2
    t = prefix_bits(n, flips)
    near = F.array(*[F.lit(m).cast("long") for m in _masks(t, flips)])
    keyed = fps.select("fp", F.explode(near).alias("m")).select(
        F.shiftrightunsigned("fp", 64 - t).bitwiseXOR(F.col("m")).alias("key"), "fp")
    sizes = keyed.groupBy("key").count()
    hot = [r["key"] for r in sizes.where(F.col("count") > KEY_ROWS_MAX)
           .orderBy(F.desc("count")).limit(2 ** 16).collect()] if n > KEY_ROWS_MAX else []

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _link_key(pdf["fp"].to_numpy().view(np.uint64), int(key[0]), t, flips, radius)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    plain = keyed.where(~F.col("key").isin(hot)) if hot else keyed
    links = plain.groupBy("key").applyInPandas(run, "src long, dst long")
    if not hot:
        return links
    # a hot key's variants, written out: no more than 1 + 64 + 2016 fingerprints share one
    low = 64 - t
    suffix = F.array(*[F.lit(m).cast("long") for m in _masks(low, flips)])
    head = F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("key"))
    hot_rows = keyed.where(F.col("key").isin(hot)).withColumn("used", F.bit_count(head))
    var = (hot_rows.select("fp", "key", "used", F.explode(suffix).alias("m"))
           .where(F.bit_count("m") + F.col("used") <= flips)
           .select("key", "fp", F.expr(f"(fp & {(1 << low) - 1}L)").bitwiseXOR(F.col("m")).alias("variant")))
    groups = var.groupBy("key", "variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = groups.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst")
    pairs = pairs.distinct().where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)
    return links.unionByName(pairs)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint 16 hex digits, component_id): one row for each row
    of ``docs``. component_id is the smallest id reachable over links of at
    most ``radius`` bits, the row's own included."""
    small_batches(docs)
    rows, _ = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct, _ = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    edges, _ = materialize(ball_links(distinct.select("fp"), distinct.count(), radius), "simhash-links")
    roots = connected_components(edges).select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    groups = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp, _ = materialize(labelled.join(groups, "root").select("fp", "component_id"), "simhash-map")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the
    smallest id stays (one of them if the id repeats). Rows with a null id
    can't be told apart and stay. All columns are kept."""
    comp = simhash_components(docs, id_col, text_col, shingle, radius)
    key = "__keep_id"
    keep = comp.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    cols = docs.columns
    known = docs.where(F.col(id_col).isNotNull()).withColumn(key, F.col(id_col).cast("long"))
    once = known.join(keep, key, "left_semi").dropDuplicates([key]).select(*cols)
    return once.unionByName(docs.where(F.col(id_col).isNull()))
