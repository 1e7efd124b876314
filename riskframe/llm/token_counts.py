"""Operator 7: token counts from distinct pre-tokens.

A pre-token is what stands between single ASCII spaces. The vocabulary drops
white space and never joins pieces across it, so a text's count is the sum of
its pre-tokens' counts, and no ids are needed.

First the distinct pre-tokens of all texts are gathered, with the number of
times each occurs (combined in each task before the shuffle), and the pieces of
each are counted once. Then the documents' pre-token frequencies are joined with
these counts and summed by document. Frequencies are spread very unevenly over
pre-tokens, so the join is in two parts: the most frequent ones (at most HOT, none
longer than SHORT characters: a table of fixed size) are looked up where the
frequencies are taken; the others go to the table of counts, by a 95-bit hash of
the pre-token.

Special strings inside a text count as the library takes them by default (one
token each); pre-tokens with one are encoded like any other. Null and empty
texts have no tokens. Repeated rows and null ids are kept. Other columns don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import blocks
from riskframe.session import materialize

#: pre-tokens whose counts are sent to all tasks
HOT = 200_000
#: pre-tokens encoded in one call, and characters up to which they are encoded together
AT_ONCE, SHORT = 512, 64


class PieceCounter:
    """Numbers of pieces by pre-token for a ``tokenizer.json`` that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        #: a special token that stands between pre-tokens encoded together
        self.mark, self.mark_id = next(iter(special.items()), (None, None))
        self.special = tuple(special)

    def count(self, new: list[str]) -> dict[str, int]:
        """Number of pieces of each of some different pre-tokens."""
        out: dict[str, int] = {}
        joint = [p for p in new if len(p) <= SHORT and not any(s in p for s in self.special)] if self.mark else []
        alone = list(set(new).difference(joint))
        for i in range(0, len(alone), AT_ONCE):
            part = alone[i:i + AT_ONCE]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[p] = len(e.ids)
        groups = [joint[i:i + AT_ONCE] for i in range(0, len(joint), AT_ONCE)]
        for i in range(0, len(groups), 16):
            some = groups[i:i + 16]
            joined = [self.mark.join(g) for g in some]
            for g, e in zip(some, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids)
                at = np.flatnonzero(ids == self.mark_id)
                out.update(zip(g, (np.diff(np.r_[-1, at, len(ids)]) - 1).tolist(), strict=True))
        return out


_loaded: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter for ``path``, loaded once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def distinct_pre_tokens(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(pre, times, n, h, g): the distinct pre-tokens of a column ``text``, their
    occurrences, numbers of pieces, and hashes."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in blocks([t or "" for t in texts]):
                found: Counter[str] = Counter()
                for t in texts[i:j]:
                    found.update((t or "").split(" "))
                found.pop("", None)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pre", "times"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            pre = b.column(0).to_pylist()
            n = c.count(pre)
            h, g = zip(*map(hashes, pre), strict=True) if pre else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n[p] for p in pre], pa.int64()),
                                              pa.array(h, pa.int64()), pa.array(g, pa.int32())], ["pre", "times", "n", "h", "g"])

    seen = rows.select("text").mapInArrow(gather, "pre string, times long").groupBy("pre").agg(F.sum("times").alias("times"))
    return seen.mapInArrow(encode, "pre string, times long, n long, h long, g int")


def hashes(pre: str) -> tuple[int, int]:
    """Two parts, of 64 and 31 bits, of a pre-token's hash."""
    h = xxhash.xxh3_128_intdigest(pre.encode())
    return (h & (2 ** 64 - 1)) - 2 ** 63, h >> 97


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    known, _ = materialize(distinct_pre_tokens(rows, tokenizer), "token-counts")
    top = known.where(F.length("pre") <= SHORT).orderBy(F.desc("times"), "pre").limit(hot).select("pre", "n")
    near = docs.sparkSession.sparkContext.broadcast({r["pre"]: r["n"] for r in top.toLocalIterator()})  # at most HOT short strings

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = near.value
        for b in batches:
            all_texts = b.column(2).to_pylist()
            for i, j in blocks([t or "" for t in all_texts]):
                here, size, h, g, times = [], [], [], [], []
                for t in all_texts[i:j]:
                    found = Counter((t or "").split(" "))
                    found.pop("", None)
                    total, before = 0, len(times)
                    for pre, k in found.items():
                        n = lookup.get(pre)
                        if n is None:
                            x, y = hashes(pre)
                            h.append(x)
                            g.append(y)
                            times.append(k)
                        else:
                            total += n * k
                    here.append(total)
                    size.append(len(times) - before)
                parts = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(times, pa.int32())], ["h", "g", "times"])
                rest = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(here, pa.int64()), rest],
                                                 ["doc_id", "n_bytes", "here", "rest"])

    freq = rows.mapInArrow(frequencies, "doc_id long, n_bytes long, here long, rest array<struct<h:bigint,g:int,times:int>>")
    freq = freq.withColumn("rid", F.monotonically_increasing_id())
    # a document's own figures go with its first row only; without others it joins nothing, spread by its number
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    pairs = freq.select("rid", "doc_id", "n_bytes", "here", F.posexplode_outer("rest").alias("pos", "x")).select(
        "rid", F.coalesce("x.h", F.xxhash64("rid")).alias("h"), F.coalesce("x.g", F.lit(-1)).alias("g"), F.col("x.times").alias("times"),
        *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "here")])
    counted = pairs.join(known.select("h", "g", "n"), ["h", "g"], "left")
    out = counted.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                     (F.max("here") + F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0))).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
