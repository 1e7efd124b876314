"""Operator 12: ranked lexical search by the no-random-access algorithm.

Documents are indexed in shards, one row of a written table for each block of
texts: the documents' lengths and, for the terms of the queries, the documents
that hold them and how often. Document count, total length and document
frequencies are sums over the shards.

A shard orders each term's postings by impact. A query then reads the lists of
its terms side by side, the strongest postings first, and keeps an interval for
each document's score: below, what has been read of it; above, that plus, for
every list where it has not been met, the impact at which that list stands. Reading
goes on until the best k are certain: their intervals are closed, and no other
document can reach the last of them, or only ties with it and has a larger id.
The k best of all shards are then ranked over all, first in parts.

Queries go over all documents in blocks of at most ``QUERY_BYTES`` of text (a longer
one is a block of its own), so that what a task must know of them is bounded.

A null text has no terms, a document without terms counts for nothing, a query
without known terms has no results. Repeated rows are documents (and queries) of
their own; documents without an id rank behind others of the same score. Other
columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, text_bytes
from riskframe.session import drop_path, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: text of the queries that are searched together, and of the documents in a shard
QUERY_BYTES, SHARD_BYTES = 4_000_000, 4_000_000
#: postings that a query reads from each list before the first look; each later look comes after four times as many
FIRST_DEPTH, DEEPER = 64, 4
#: parts in which an item's best documents of all shards are ranked first
RANK_PARTS = 64

INDEX = "n_terms long, n_docs long, ids array<long>, no_id int, lengths array<long>, term array<int>, doc array<int>, tf array<long>"


def terms(text: bytes | None) -> list[str]:
    """The terms of a text: A-Z lower-cased (as ``bytes.lower`` does), nothing else."""
    return re.findall(TERM, text.lower().decode("utf-8", "replace")) if text else []


def shards(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index (see INDEX): one row for each block of documents, which are in
    it by ascending id, the ``no_id`` ones without an id last. ``vocabulary``: a
    broadcast dict from term to number."""
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [f.split(" ")[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for b in batches:
            all_ids, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in blocks(all_texts, shard_bytes):
                order = sorted(range(i, j), key=lambda x: (all_ids[x] is None, all_ids[x] or 0))
                ids, lengths, post = [], [], []
                for x in order:
                    found = Counter(terms(all_texts[x]))
                    if found:
                        d = len(ids)
                        ids.append(all_ids[x])
                        lengths.append(found.total())
                        post += [(number[t], d, n) for t, n in found.items() if t in number]
                cols = list(zip(*post, strict=True)) or [(), (), ()]
                row = [sum(lengths), len(ids), [x or 0 for x in ids], ids.count(None), lengths, *map(list, cols)]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, INDEX)


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, first: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The k documents of highest total impact above 0, with their totals, best
    first, equal ones by number; and how many postings were read. ``lists``: of
    each term the documents and impacts, impacts descending, no document twice."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    size = np.array([len(d) for d, _ in lists], np.int64)
    doc = np.concatenate([d for d, _ in lists])
    impact = np.concatenate([x for _, x in lists])
    start = np.cumsum(size) - size
    which = np.repeat(np.arange(len(lists)), size)
    rank = np.arange(len(doc)) - start[which]
    turn = np.argsort(rank, kind="stable")  # the order of reading: first of each list, second of each list, ...
    by_turn = rank[turn]
    lower, met = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    read, depth = 0, first
    while True:
        upto = int(np.searchsorted(by_turn, depth))
        new = turn[read:upto]
        np.add.at(lower, doc[new], impact[new])
        read = upto
        # where each list stands: the impact of its next posting, 0 at its end
        stands = np.where(size > depth, impact[np.minimum(start + depth, len(impact) - 1)], 0)
        open_ = int(stands.sum())
        top = _top(lower, k)
        if open_ == 0:
            return top, lower[top], read
        if len(top) == k and open_ <= lower[top[-1]]:
            met[:] = 0
            np.add.at(met, doc[turn[:read]], stands[which[turn[:read]]])
            upper, last = lower + open_ - met, top[-1]
            beat = (upper > lower[last]) | ((upper == lower[last]) & (np.arange(n_docs) < last))
            beat[top] = upper[top] != lower[top]
            if not beat.any():
                return top, lower[top], read
        depth *= DEEPER


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores above 0, equal ones by number."""
    some = np.flatnonzero(score > 0)
    if len(some) > k:
        cut = np.partition(score[some], len(some) - k)[len(some) - k]
        some = some[score[some] >= cut]
    return some[np.lexsort((some, -score[some]))][:k]


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[str]]], base: int, k: int, id_col: str, text_col: str,
                  shard_bytes: int) -> DataFrame | None:
    """Results of one block of queries (number, item_id, doc_id, score): the
    best k of each shard, written."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, q in items for t in q}))}
    index, path = materialize(shards(docs, spark.sparkContext.broadcast(number), id_col, text_col, shard_bytes), "nra-index")
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not number or not total[0]:
        drop_path(spark, path)
        return None
    n_docs, n_terms = total
    # at most one row for each term of the block
    df = {r["term"]: r["df"] for r in index.select(F.explode("term").alias("term")).groupBy("term")
          .agg(F.count(F.lit(1)).alias("df")).toLocalIterator()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    asked = [(base + i, item, [(number[t], n * weight[number[t]]) for t, n in sorted(Counter(q).items())
                               if weight.get(number[t], 0) > 0]) for i, (item, q) in enumerate(items)]
    given = spark.sparkContext.broadcast([a for a in asked if a[2]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, lengths, term, doc, tf = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (2, 4, 5, 6, 7))
                no_id = len(ids) - b.column(3)[r].as_py()
                if not len(term):
                    continue
                share = 25 + (75 * lengths.astype(np.int64) * n_docs) // n_terms
                part = (1_000_000_000 * tf) // (1000 * tf + 8 * share[doc])
                order = np.lexsort((doc, -part, term))
                term, doc, part = term[order], doc[order], part[order]
                known, at = np.unique(term, return_index=True)
                span = dict(zip(known.tolist(), zip(at.tolist(), [*at[1:].tolist(), len(term)], strict=True), strict=True))
                rows: list[tuple] = []
                for no, item, query in given.value:
                    lists = [(doc[slice(*span[t])], part[slice(*span[t])] * w) for t, w in query if t in span]
                    top, score, _ = best(lists, len(ids), k)
                    rows += [(no, item, None if d >= no_id else int(ids[d]), int(s)) for d, s in zip(top, score, strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["number", "item_id", "doc_id", "score"])

    found, _ = materialize(index.mapInArrow(run, "number long, item_id long, doc_id long, score long"), "nra-found")
    drop_path(spark, path)
    return found


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", query_bytes: int = QUERY_BYTES,
           shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query."""
    found: list[DataFrame] = []
    items: list[tuple[int | None, list[str]]] = []
    held = done = 0

    def flush():
        nonlocal items, held, done
        if items:
            got = _search_block(docs, items, done, k, id_col, text_col, shard_bytes)
            if got is not None:
                found.append(got)
            done += len(items)
            items, held = [], 0

    for r in queries.select(F.col(item_col).cast("long").alias("i"), text_bytes(query_col).alias("t")).toLocalIterator():
        size = len(r["t"]) + 100
        if held + size > query_bytes:
            flush()
        items.append((r["i"], terms(bytes(r["t"]))))
        held += size
    flush()
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(RANK_PARTS))
    rows = rows.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("number", "part").orderBy(*order)))
    rows = rows.where(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
