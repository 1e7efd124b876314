"""Operator 2: best-fit sequence packing by a grouping genetic algorithm.

Documents become token ids plus an end id; only longer ones than ``max_tokens``
are cut, into full pieces after a first piece that may be shorter. Full pieces
are sequences of their own. The others are dealt by a hash into blocks of about
``BLOCK`` pieces, and each block's packing evolves on ISLANDS islands from
groupings in random order: a chromosome is a grouping of the pieces into bins;
crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold duplicates, and best-fits the displaced pieces; mutation dissolves
the emptiest and some other bins. After an epoch every island gets the elite of
its neighbour (a join on block and island). An island rests once its best grouping
has no more bins than the pieces' total length needs. The best island's packing is
taken. Blocks cost at most one part-filled bin each, whatever the input's size.

A null text is empty: its one piece is the end id. Repeated rows and null ids
are pieces of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, parts_for, small_batches
from riskframe.llm.tokens import byte_bpe
from riskframe.session import materialize

BLOCK, ISLANDS, EPOCHS = 8192, 2, 3
POPULATION = 3
#: an epoch makes at least so many children, or so many that about WORK pieces are dealt anew
CHILDREN, WORK = 12, 100_000
#: share of the other parent's well-filled bins that a crossover injects, and shares of a child's bins dissolved: any, and the emptiest
INJECT, ANY, EMPTIEST = 0.2, 0.05, 0.2


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]): the pieces
    of all documents; ``tokenizer`` is the path of a byte-level BPE file."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(tokenizer)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in blocks(texts):
                rows: list[tuple] = []
                for doc, got in zip(ids[i:j], enc.encode(texts[i:j]), strict=True):
                    got += end
                    n = len(got) // 4
                    at, size = 0, n if n <= max_tokens else (n % max_tokens or max_tokens)
                    k = 0
                    while at < n:
                        part = got[4 * at:4 * (at + size)]
                        rows.append((doc, k, at, size, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
                        at, size, k = at + size, max_tokens, k + 1
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def best_fit(lengths: list[int], fills: list[int], cap: int) -> list[int]:
    """Bin of each length in turn: the open bin with the least room that still
    takes it, or a new one. ``fills`` (content of the bins) is extended."""
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for b, f in enumerate(fills):
        if f < cap:
            by_room[cap - f].append(b)
            rooms |= 1 << (cap - f)
    out = []
    for n in lengths:
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            b, r = len(fills), cap
            fills.append(0)
        fills[b] += n
        r -= n
        if r:
            by_room[r].append(b)
            rooms |= 1 << r
        out.append(b)
    return out


def _complete(lengths: np.ndarray, assign: np.ndarray, cap: int) -> np.ndarray:
    """Best-fit the pieces without a bin (-1), longest first, into ``assign``."""
    kept = assign >= 0
    _, dense = np.unique(assign[kept], return_inverse=True)
    out = np.full(len(assign), -1)
    out[kept] = dense
    fills = np.bincount(dense, weights=lengths[kept]).astype(int).tolist() if kept.any() else []
    loose = np.flatnonzero(~kept)  # pieces are in descending order
    out[loose] = best_fit(lengths[loose].tolist(), fills, cap)
    return out


def fitness(lengths: np.ndarray, assign: np.ndarray, cap: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the sum of squared fills)."""
    fill = np.bincount(assign, weights=lengths)
    return -len(fill), float(np.square(fill / cap).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``a`` with whole well-filled bins of ``b``: bins of ``a`` that
    hold any of their pieces go, and what these held besides is best-fitted."""
    fill = np.bincount(b, weights=lengths)
    good = fill >= np.quantile(fill, 0.5)
    inject = good & (rng.random(len(fill)) < INJECT)
    given = inject[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[given]] = True
    child = np.where(hit[a], -1, a)
    child[given] = a.max() + 1 + b[given]
    return _complete(lengths, child, cap)


def mutate(a: np.ndarray, lengths: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bins and a few others."""
    fill = np.bincount(a, weights=lengths)
    gone = (rng.random(len(fill)) < ANY) | (fill <= np.quantile(fill, EMPTIEST))
    return _complete(lengths, np.where(gone[a], -1, a), cap)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], cap: int, seed: int, trace: list[int] | None = None) -> np.ndarray:
    """Best grouping after one epoch on an island, from ``elites`` (its own and
    its neighbour's) and best-fit groupings in random order. ``lengths`` descend.
    Stops early where the lower bound is met. ``trace`` gets the number of bins of
    the best grouping at the start and after each child."""
    rng = np.random.default_rng(seed)
    bound = -(-int(lengths.sum()) // cap)
    pop = list(elites)
    score = [fitness(lengths, p, cap) for p in pop]
    while len(pop) < POPULATION and (not pop or -max(score)[0] > bound):
        order = rng.permutation(len(lengths))
        bins = np.empty(len(lengths), np.int64)
        bins[order] = best_fit(lengths[order].tolist(), [], cap)
        pop.append(bins)
        score.append(fitness(lengths, bins, cap))
    trace = [] if trace is None else trace
    trace.append(-max(score)[0])
    for _ in range(max(CHILDREN, WORK // max(1, len(lengths)))):
        if trace[-1] <= bound:
            break
        i, j = rng.choice(len(pop), 2, replace=False)
        if score[i] < score[j]:
            i, j = j, i
        child = mutate(crossover(pop[i], pop[j], lengths, cap, rng), lengths, cap, rng)
        s, worst = fitness(lengths, child, cap), min(range(len(pop)), key=score.__getitem__)
        if s > score[worst]:
            pop[worst], score[worst] = child, s
        trace.append(-max(score)[0])
    return _complete(lengths, pop[max(range(len(pop)), key=score.__getitem__)], cap)


def offsets(lengths: np.ndarray, assign: np.ndarray) -> np.ndarray:
    """Place of each piece in its bin, in the order given."""
    order = np.argsort(assign, kind="stable")
    size = lengths[order]
    before = np.cumsum(size) - size
    first = np.flatnonzero(np.r_[True, np.diff(assign[order]) != 0])
    out = np.empty(len(lengths), np.int64)
    out[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(order)]))
    return out


def pack(items: DataFrame, length_col: str = "length", max_tokens: int = 2048, block: int = BLOCK) -> DataFrame:
    """``items`` (pieces no longer than ``max_tokens``) with ``sequence_id`` and
    ``offset``: in no sequence are there more than ``max_tokens`` tokens."""
    spark = items.sparkSession
    cols = items.columns
    held, _ = materialize(items.withColumn("__pid", F.monotonically_increasing_id()), "pack-items")
    full = held.where(F.col(length_col) == max_tokens).select(
        *cols, (F.col("__pid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = held.where(F.col(length_col) < max_tokens)
    n = parts_for(part.count(), block)
    # by the first place of the block's hash: a block gathers about ``block`` narrow rows, ordered by length
    grouped = (part.select("__pid", F.col(length_col).alias("len"), F.pmod(F.xxhash64("__pid"), F.lit(n)).alias("block"))
               .groupBy("block").agg(F.sort_array(F.collect_list(F.struct((-F.col("len")).alias("neg"), "__pid"))).alias("items")))
    grouped, _ = materialize(grouped.repartition(parts_for(n, 1), "block"), "pack-blocks")
    start = grouped.select("block", F.transform("items", lambda x: (-x["neg"]).cast("int")).alias("lengths"),
                           F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = start.select("*", F.lit(None).cast("array<int>").alias("own"), F.lit(None).cast("array<int>").alias("other"))
    schema = "block long, island int, lengths array<int>, bins int, fit double, assign array<int>"

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    size = np.array(r.lengths, np.int64)
                    elites = [np.array(e, np.int64) for e in (r.own, r.other) if e is not None]
                    best = evolve(size, elites, max_tokens, (r.block * 1009 + r.island) * 101 + number)
                    bins, fit = fitness(size, best, max_tokens)
                    out.append((r.block, r.island, r.lengths, -bins, fit, best.astype(np.int32)))
                yield pd.DataFrame(out, columns=["block", "island", "lengths", "bins", "fit", "assign"])
        return run

    for k in range(EPOCHS):
        work = state.repartition(n * ISLANDS, "block", "island").select("block", "island", "lengths", "own", "other")
        done, _ = materialize(work.mapInPandas(epoch(k), schema), "pack-epoch")
        near = done.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
                           F.col("assign").alias("other"))  # the elite migrates to the next island
        state = done.withColumnRenamed("assign", "own").join(near, ["block", "island"])
    best = done.groupBy("block").agg(F.max_by("assign", F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("assign"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                assign = np.array(r.assign, np.int64)
                yield pd.DataFrame({"__pid": r.pids, "sequence_id": (r.block * 2 ** 20 + assign) * 2,
                                    "offset": offsets(np.array(r.lengths, np.int64), assign)})

    placed = (grouped.join(best, "block").select("block", F.transform("items", lambda x: x["__pid"]).alias("pids"),
                                                 F.transform("items", lambda x: -x["neg"]).alias("lengths"), "assign")
              .mapInPandas(place, "__pid long, sequence_id long, offset long"))
    return part.join(placed, "__pid").select(*cols, "sequence_id", "offset").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    small_batches(docs)
    return pack(pieces(docs, tokenizer, id_col, text_col, max_tokens, end_id, with_ids), max_tokens=max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from pieces with ids; a
    sequence's rows are at most ``max_tokens``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten(F.transform("rows", lambda r: r["ids"])).alias("ids"))
