"""Operator 4: language-model scores by deleted interpolation.

A bigram model mixes three estimates, with weights by how often the context
(the token before, or the end token at a text's beginning) was seen:
``w2 * c(context, token) / c(context) + w1 * c(token) / N + w0 / (V + 1)``.
The weights come from expectation-maximisation on a part of the training
documents that is deleted from the counts (``DELETED`` of the ten parts by
crc32 of the id); the final counts are those of all training documents.

Counts are taken over all texts. Each task gathers blocks of about BLOCK_TEXT
bytes, and sends every distinct word and word pair of a block once, with its
number of occurrences in training texts, to the task that sums it over the
corpus (a range of the hash space, ``bucket``); the answers go back to the
block, which has its tokens as indices. So a frequent word is one entry for
each block, and no task holds more than a bucket or a block. Words are known by
their 64-bit XXH64, pairs by a 56-bit mix; a chance collision of pairs (one in
10^8 at a billion pairs) adds up two counts.

Tokens are the words of the text with A-Z in lower case, then one end token.
Null and empty texts are the end token alone. With no training text, N and V
are 0 and every token has probability 1. A null id counts as the empty string
(held out); repeated rows are kept and counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import crc_bucket, parts_for, text_bytes
from riskframe.session import materialize

#: text bytes of a block, and text bytes for each bucket of the hash space
BLOCK_TEXT, BUCKET_TEXT = 10_000_000, 12_000_000
#: which of the ten parts is held out from the counts to learn the weights, and which is never learned from
DELETED, HELD_OUT = 1, 0
#: hash of the end token: no word has it but by chance
END = np.uint64(0x2545F4914F6CDD1D)
PAIR_BITS = 56
#: context-frequency classes (0: never seen; else one for each doubling), and steps of a doubling in the held-out table
CLASSES, STEPS = 32, 4
WORD, PAIR, TOKENS, STATS = 0, 1, 2, 3


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an unsigned array, byte planes apart."""
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, its first value included."""
    return np.diff(a, prepend=np.uint64(0))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's tokens, the end token last."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_hashes(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the end token stands before a text's first."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[start] = END
    h = (before * np.uint64(0x9E3779B97F4A7C15) ^ word) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - PAIR_BITS)


def bounds(n: int, bits: int) -> np.ndarray:
    """Beginnings of ``n`` equal ranges of the hash space, without the first."""
    return np.array([(i << bits) // n for i in range(1, n)], np.uint64)


class Block:
    """Texts of one kind that a task has gathered."""

    def __init__(self, number: int, deleted: bool):
        self.number, self.deleted = number, deleted
        self.ids, self.learn, self.words, self.size = [], [], [], 0

    def add(self, doc_id, part: int, text: bytes) -> None:
        self.ids.append(doc_id)
        self.learn.append(part != HELD_OUT)
        self.words.append(word_hashes(text))
        self.size += len(text)

    def rows(self, buckets: int) -> Iterator[tuple]:
        """(bucket, block, deleted, kind, keys, values): a row for each bucket
        and kind, and one with the tokens."""
        length = np.array([len(w) for w in self.words], np.uint32)
        word = np.concatenate(self.words)
        self.words = []
        start = np.cumsum(length) - length
        learn = np.repeat(np.array(self.learn), length)
        distinct, code = np.unique(word, return_inverse=True)
        for kind, bits, keys, at in ((WORD, 64, distinct, code),
                                     (PAIR, PAIR_BITS, *np.unique(pair_hashes(word, start), return_inverse=True))):
            n = np.bincount(at[learn], minlength=len(keys)).astype(np.uint32)
            cut = np.r_[0, np.searchsorted(keys, bounds(buckets, bits)), len(keys)]
            for b in range(buckets):
                i, j = cut[b], cut[b + 1]
                if i < j:
                    yield b, self.number, self.deleted, kind, squeeze(gaps(keys[i:j])), squeeze(n[i:j])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        none = np.array([i is None for i in self.ids], np.uint8)
        meta = [squeeze(x) for x in (length, ids.view(np.uint64), none, np.array(self.learn, np.uint8), gaps(distinct))]
        head = b"".join(len(m).to_bytes(8, "little") + m for m in meta)
        yield self.number % buckets, self.number, self.deleted, TOKENS, head, squeeze(code.astype(np.uint32))


ROW = "bucket int, block long, deleted boolean, kind int, keys binary, vals binary"


def gather(docs: DataFrame, buckets: int) -> DataFrame:
    """The blocks' rows (doc_id, part, text in, ROW out)."""
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "deleted", "kind", "keys", "vals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[bool, Block] = {}

        def flush(block):
            rows = list(block.rows(buckets))
            for i in range(0, len(rows), 64):
                cols = zip(*rows[i:i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for b in batches:
            for doc_id, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = part == DELETED
                if kind not in open_:
                    open_[kind] = Block(number, kind)
                    number += 1
                open_[kind].add(doc_id, part, text)
                if open_[kind].size >= BLOCK_TEXT:
                    yield from flush(open_.pop(kind))
        for block in open_.values():
            yield from flush(block)

    return docs.mapInArrow(run, ROW)


def sum_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of one bucket, sent back to the blocks that asked: for
    each of their keys the count without the deleted part (deleted blocks
    only) and the full one. Token rows pass through."""
    out = [r for r in pdf.itertuples(index=False) if r.kind == TOKENS]
    out = [(r.bucket, r.block, r.deleted, r.kind, r.keys, r.vals) for r in out]
    stats = np.zeros(4, np.uint64)  # N and V without the deleted part, and of all training texts
    bucket = int(pdf["bucket"].iloc[0])
    for kind in (WORD, PAIR):
        rows = [r for r in pdf.itertuples(index=False) if r.kind == kind]
        if not rows:
            continue
        keys = [np.cumsum(unsqueeze(r.keys, np.uint64), dtype=np.uint64) for r in rows]
        size = [len(k) for k in keys]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([unsqueeze(r.vals, np.uint32) for r in rows]).astype(np.float64)
        gone = np.repeat([r.deleted for r in rows], size)
        every = np.bincount(at, weights=n, minlength=len(distinct))
        kept = every - np.bincount(at[gone], weights=n[gone], minlength=len(distinct))
        if kind == WORD:
            stats += np.array([kept.sum(), (kept > 0).sum(), every.sum(), (every > 0).sum()], np.uint64)
        for r, a in zip(rows, np.split(at, np.cumsum(size)[:-1]), strict=True):
            out.append((bucket, r.block, r.deleted, kind, squeeze(kept[a].astype(np.uint64)) if r.deleted else b"",
                        squeeze(every[a].astype(np.uint64))))
    out.append((bucket, -1, False, STATS, squeeze(stats), b""))
    return pd.DataFrame(out, columns=["bucket", "block", "deleted", "kind", "keys", "vals"])


class Tokens:
    """A block's texts with the corpus counts of each token: of the token
    (c1), its context (c0) and both together (c2)."""

    def __init__(self, pdf: pd.DataFrame, without_deleted: bool):
        col = "keys" if without_deleted else "vals"
        row = pdf[pdf["kind"] == TOKENS].iloc[0]
        meta, p = [], 0
        while p < len(row["keys"]):
            n = int.from_bytes(row["keys"][p:p + 8], "little")
            meta.append(row["keys"][p + 8:p + 8 + n])
            p += 8 + n
        self.length = unsqueeze(meta[0], np.uint32).astype(np.int64)
        self.ids, self.none = unsqueeze(meta[1], np.uint64).view(np.int64), unsqueeze(meta[2], np.uint8).astype(bool)
        self.learn = unsqueeze(meta[3], np.uint8).astype(bool)
        distinct = np.cumsum(unsqueeze(meta[4], np.uint64), dtype=np.uint64)
        code = unsqueeze(row["vals"], np.uint32)
        self.start = np.cumsum(self.length) - self.length

        def counts(kind):
            own = pdf[pdf["kind"] == kind].sort_values("bucket")
            return np.concatenate([unsqueeze(b, np.uint64) for b in own[col]]).astype(np.float64)

        word = counts(WORD)
        self.c1 = word[code]
        self.c0 = np.empty_like(self.c1)
        self.c0[1:] = self.c1[:-1]
        end = np.flatnonzero(distinct == END)[0]
        self.c0[self.start] = word[end]
        _, at = np.unique(pair_hashes(distinct[code], self.start), return_inverse=True)
        self.c2 = counts(PAIR)[at]

    def context_class(self) -> np.ndarray:
        return np.minimum(np.frexp(self.c0)[1], CLASSES - 1)  # 0 for no context, else 1 + floor(log2)

    def estimates(self, n: float, v: float) -> tuple[np.ndarray, np.ndarray, float]:
        p2 = np.divide(self.c2, self.c0, out=np.zeros_like(self.c2), where=self.c0 > 0)
        return p2, self.c1 / max(n, 1.0), 1.0 / (v + 1.0)


def _steps(p: np.ndarray) -> np.ndarray:
    """Probability as whole steps of a fraction of a doubling below 1; -1 for none."""
    out = np.full(len(p), -1)
    some = p > 0
    out[some] = np.round(-np.log2(p[some]) * STEPS)
    return out


def learn_weights(cells: pd.DataFrame, v: float, rounds: int = 200) -> np.ndarray:
    """(CLASSES, 3) weights of the pair, word and uniform estimates by
    expectation-maximisation on the held-out table (class, s2, s1, n)."""
    weights = np.tile([0.0, 0.9, 0.1], (CLASSES, 1))
    pooled = cells.groupby(["s2", "s1"], as_index=False)["n"].sum().assign(cls=-1)
    groups = {int(c): g for c, g in cells.groupby("cls")}
    fallback = None
    for c in [-1, *range(CLASSES)]:
        g = pooled if c == -1 else groups.get(c)
        if g is None or not len(g):
            if c > 0 and fallback is not None:
                weights[c] = fallback
            continue
        p = np.stack([np.where(g["s2"] < 0, 0.0, 2.0 ** (-g["s2"] / STEPS)),
                      np.where(g["s1"] < 0, 0.0, 2.0 ** (-g["s1"] / STEPS)), np.full(len(g), 1.0 / (v + 1.0))], 1)
        n, w = g["n"].to_numpy(float), np.array([0.4, 0.4, 0.2])
        if c == 0:
            p[:, 0], w = 0.0, np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            done = np.abs(new - w).max() < 1e-7
            w = new
            if done:
                break
        w[2] = max(w[2], 1e-4)  # no token may get probability zero
        w[1] = max(w[1], 1e-6)
        w /= w.sum()
        if c == -1:
            fallback = w
        else:
            weights[c] = w
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score):
    one row for each row of ``docs``; scores are log10 probabilities."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), crc_bucket(id_col, 10).cast("int").alias("part"),
                       text_bytes(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    buckets = parts_for(total, BUCKET_TEXT) * 4
    counted, _ = materialize(gather(rows, buckets).groupBy("bucket").applyInPandas(sum_bucket, ROW), "lm-counts")
    stats = np.zeros(4)
    for r in counted.where(F.col("kind") == STATS).select("keys").toLocalIterator():  # four numbers for each bucket
        stats += unsqueeze(bytes(r["keys"]), np.uint64).astype(float)
    n_kept, v_kept, n_all, v_all = stats
    blocks = counted.where(F.col("kind") != STATS)

    def held_out_table(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(pdf, without_deleted=True)
        p2, p1, _ = t.estimates(n_kept, v_kept)
        cells = pd.DataFrame({"cls": t.context_class(), "s2": _steps(p2), "s1": _steps(p1)})
        return cells.groupby(["cls", "s2", "s1"], as_index=False).size().rename(columns={"size": "n"})

    # bounded by classes and steps of a doubling, not by the corpus
    cells = (blocks.where("deleted").groupBy("block").applyInPandas(held_out_table, "cls int, s2 int, s1 int, n long")
             .groupBy("cls", "s2", "s1").agg(F.sum("n").alias("n")).toPandas())
    weights = learn_weights(cells, v_kept)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(pdf, without_deleted=False)
        p2, p1, p0 = t.estimates(n_all, v_all)
        w = weights[t.context_class()]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0 if n_all else np.ones(len(p1))
        base = np.log10((t.c1 + 0.1) / (n_all + 0.1 * (v_all + 1)))
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(t.ids.copy(), t.none.copy()), "held_out": ~t.learn, "n_tokens": t.length,
            "n_known": np.add.reduceat((t.c1 > 0).astype(np.int64), t.start), "train_tokens": int(n_all),
            "base_score": np.add.reduceat(base, t.start), "score": np.add.reduceat(np.log10(p), t.start)})

    return blocks.groupBy("block").applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
