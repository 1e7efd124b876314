"""Operator 8: substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes decides the cuts: after white space
where the hash falls in one part of 6, and after any character where it falls
in one part of 1024; line ends and sentence ends always cut, and for NEAR bytes
after them the hash does not. In scripts that
write no spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer) it cuts after one
character in 10, and further than STRETCH bytes from any white space after one
byte in 32. Cuts depend on the
bytes just before them only, so an insertion moves no cut beyond its own
neighbourhood. A chunk's digest is the XXH64 of its bytes without outer white
space. Chunks are short, so they are compared in passages: the fewest adjoining
chunks that hold ``min_words`` words, from each chunk on, and up to each chunk
at which none of those ends. Two characters of a script without spaces count as
a word, and so do six bytes beyond STRETCH of any other unspaced text. A passage's digest is made of its chunks' digests.
Of the occurrences of a passage the first (smallest doc_id, then place) stays,
and the chunks of later ones are removed. Every chunk of a longer repeat is in
a passage within it, so all of it but the parts of chunks at its ends goes.
Shorter repeats (stock phrases, licence lines) stay.

Null and empty texts pass through, and so do rows with a null id (they can't be
ordered). Rows that repeat an id with the same text count as one document. A
chunk is at most MAX_CHUNK bytes long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from riskframe.llm.common import BLOCK_BYTES, blocks, free_name, small_batches, text_bytes
from riskframe.session import materialize

#: random values of the gear hash, one for each byte value, from a seeded generator
GEAR = np.random.default_rng(2024).integers(0, 2 ** 32, size=256, dtype=np.uint32)
WINDOW, MAX_CHUNK = 16, 4096
#: a passage's place is start << LENGTH_BITS | length, each below 2^31 as a text's bytes are: rows of three longs, and
#: aggregates without structs, keep the shuffles small
LENGTH_BITS = 32
#: of the polynomial over the chunks' digests, modulo 2^64, that is a passage's digest
MULTIPLIER = np.uint64(0x9E3779B97F4A7C17)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C17, -1, 2 ** 64))
#: what a word counts, a character of a script without spaces, and a byte beyond STRETCH of other unspaced text
WORD, CHARACTER, BYTE = 6, 3, 1
#: bytes since white space from which text counts as unspaced, and the parts of the hash range that cut in it
STRETCH = 32
#: bytes after a line or sentence end in which the hash does not cut
NEAR = 32
AT_CHARACTER, IN_STRETCH = np.uint32(2 ** 32 // 10), np.uint32(2 ** 32 // 32)
#: parts of the hash range that cut after white space, and anywhere
AT_SPACE, ANYWHERE = np.uint32(2 ** 32 // 6), np.uint32(2 ** 32 // 1024)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def unspaced(buf: np.ndarray, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the joined texts ``buf``: whether it ends a character of
    a script without spaces, whether it ends a full stop, exclamation or question
    mark of one, and whether it lies beyond STRETCH bytes from white space (or
    from the text's beginning)."""
    script, stop = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    lead = np.flatnonzero(buf[:-2] >= 0xE0)  # of characters of three or four bytes
    if len(lead):
        a, b, c = buf[lead], buf[lead + 1], buf[lead + 2]
        three = ((a >= 0xE3) & (a <= 0xE9)  # kana and Han
                 | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)  # Thai, Lao
                 | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F)))  # Burmese, Khmer
        script[lead[three] + 2] = True
        script[lead[(a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)] + 3] = True  # rare Han
        full = (a == 0xE3) & (b == 0x80) & (c == 0x82) | (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F))
        stop[lead[full] + 2] = True
    far = np.zeros(len(buf), bool)
    edge = SPACE[buf]
    edge[doc_start] = True
    edge = np.flatnonzero(edge)
    gap = np.diff(np.r_[edge, len(buf)])
    for p, g in zip(edge[gap > STRETCH + 1].tolist(), gap[gap > STRETCH + 1].tolist(), strict=True):
        far[p + STRETCH + 1:p + g] = True
    return script, stop, far


def cut_points(buf: np.ndarray, doc_start: np.ndarray, marks: tuple[np.ndarray, ...]) -> np.ndarray:
    """Cuts (index of the first byte after) in the joined texts ``buf``, whose
    texts begin at ``doc_start``; the beginnings are cuts too. ``marks``: of
    :func:`unspaced`."""
    n = len(buf)
    h = GEAR[buf]
    for k in (1, 2, 4, 8):  # h covers 2k bytes after this step
        h[k:] += h[:-k] << np.uint32(k)
    h *= np.uint32(0x9E3779B1)
    space = SPACE[buf]
    nxt = np.r_[buf[1:], np.uint8(32)]
    script, stop, far = marks
    always = (buf == 10) | STOP[buf] & SPACE[nxt] | stop
    ends = np.cumsum(always, dtype=np.int32)
    near = ends - always > 0  # an end among the NEAR bytes before
    near[NEAR + 1:] = (ends - always)[NEAR + 1:] > ends[:-NEAR - 1]
    cut = space & (h < AT_SPACE) & ~near
    cut |= (h < ANYWHERE) & ((nxt & 0xC0) != 0x80)
    if far.any():
        cut |= far & (h < IN_STRETCH) & ((nxt & 0xC0) != 0x80)
    if script.any():
        cut |= script & (h < AT_CHARACTER) & ~near
    for s in doc_start.tolist():  # the window isn't full yet, or reaches into the text before
        cut[s:s + WINDOW - 1] = False
    cut |= always
    if n:
        cut[-1] = False
    begin = np.r_[False, cut[:-1]]
    begin[doc_start] = True
    at = np.flatnonzero(begin)
    gap = np.diff(np.r_[at, n])
    if (gap > MAX_CHUNK).any():
        extra = []
        for a, g in zip(at[gap > MAX_CHUNK].tolist(), gap[gap > MAX_CHUNK].tolist(), strict=True):
            p = a
            while p + MAX_CHUNK < a + g:
                p += MAX_CHUNK
                while p > a and buf[p] & 0xC0 == 0x80:
                    p -= 1
                extra.append(p)
        at = np.unique(np.r_[at, extra])
    return at


def measure(buf: np.ndarray, doc_start: np.ndarray, marks: tuple[np.ndarray, ...]) -> np.ndarray:
    """What each byte of the joined texts ``buf`` adds to the length of a
    passage: WORD at the first byte of a word, CHARACTER at the last byte of a
    character of a script without spaces, BYTE beyond STRETCH in other text. ``marks``: of :func:`unspaced`."""
    first = ~SPACE[buf]
    first[1:] &= SPACE[buf[:-1]]
    first[doc_start] = ~SPACE[buf[doc_start]]
    script, _, far = marks
    whole = ~script  # not a byte of such a character, which counts already
    for k in (1, 2):
        whole[:-k] &= ~script[k:]
    out = first.astype(np.int32) * WORD
    if script.any() or far.any():
        out += script * np.int32(CHARACTER) + (far & whole) * np.int32(BYTE)
    return out


def measured_chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of non-empty texts: index of each chunk's text, its start
    and length in it, its digest (int64), and its measure in words times WORD. Blank
    chunks are left out."""
    digest = xxhash.xxh64_intdigest
    full = [i for i, t in enumerate(texts) if t]
    for i, j in blocks([texts[k] for k in full], BLOCK_BYTES):
        own = np.array(full[i:j])
        size = np.array([len(texts[k]) for k in own])
        start = np.cumsum(size) - size
        joined = b"".join(texts[k] for k in own)
        buf = np.frombuffer(joined, np.uint8)
        marks = unspaced(buf, start)
        at = cut_points(buf, start, marks)
        end = np.r_[at[1:], len(joined)]
        body = [joined[a:b].strip() for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        h = np.fromiter(map(digest, body), np.uint64, len(body)).view(np.int64)
        some = np.fromiter(map(len, body), np.int64, len(body)) > 0
        doc = np.searchsorted(start, at, side="right") - 1
        words = np.add.reduceat(measure(buf, start, marks), at, dtype=np.int64)
        yield own[doc][some], (at - start[doc])[some], (end - at)[some], h[some], words[some]


def chunk_texts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`measured_chunks` without the measure."""
    for *chunk, _ in measured_chunks(texts):
        yield tuple(chunk)


def passages(texts: list[bytes], min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: index of each passage's text, its place in it
    (start << LENGTH_BITS | length), and its digest (int64)."""
    need = min_words * WORD
    for row, start, length, h, words in measured_chunks(texts):
        n = len(row)
        upto = np.r_[0, np.cumsum(words)]
        lo = np.searchsorted(row, row, side="left")  # first chunk of the same text, and the one after its last
        hi = np.searchsorted(row, row, side="right")
        i = np.arange(n)
        j = np.searchsorted(upto, upto[:-1] + need, side="left")  # the passage from i on is i..j-1
        i, j = i[j <= hi], j[j <= hi]
        rest = np.setdiff1d(np.arange(1, n + 1), j, assume_unique=False)  # ends that no passage has
        back = np.searchsorted(upto, upto[rest] - need, side="right") - 1
        ok = (upto[rest] >= need) & (back >= lo[rest - 1])
        i, j = np.r_[i, back[ok]], np.r_[j, rest[ok]]
        with np.errstate(over="ignore"):
            up = np.cumprod(np.r_[np.uint64(1), np.full(n, MULTIPLIER)], dtype=np.uint64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE)], dtype=np.uint64)
            total = np.r_[np.uint64(0), np.cumsum(h.view(np.uint64) * up[:n], dtype=np.uint64)]
            digest = (total[j] - total[i]) * down[i]
        size = start[j - 1] + length[j - 1] - start[i]
        yield row[i], start[i].astype(np.int64) << LENGTH_BITS | size, digest.view(np.int64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16) -> DataFrame:
    """(digest, doc_id, place): the passages of all texts with an id; place is
    start << LENGTH_BITS | length, both in UTF-8 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for row, place, h in passages(b.column(1).to_pylist(), min_words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(ids[row]), pa.array(place)],
                    ["digest", "doc_id", "place"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"),
                                                        text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "digest long, doc_id long, place long")


def later_occurrences(ch: DataFrame) -> DataFrame:
    """(doc_id, dups): for each document the chunks whose digest is repeated,
    as structs (place, digest, first_doc); a document's own share only. Those
    of first_doc itself are among them (its smallest place stays). ``ch`` is
    used twice; a digest's rows are never gathered. The repeated digests are
    written, so that the join stands alone in its stage and the adaptive skew
    join can split a digest that very many documents share."""
    first = (ch.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
             .where("n > 1").select("digest", "first_doc"))
    first, _ = materialize(first, "cdc-first")
    dup = ch.join(first, "digest")
    return dup.groupBy("doc_id").agg(F.collect_list(F.struct("place", "digest", "first_doc")).alias("dups"))


def removable(doc_id: int | None, text: bytes, dups: list[tuple[int, int, int]],
              own: set[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
    """Runs (start, end, first_doc) of ``text`` that later occurrences cover.
    ``dups``: (place, digest, first_doc) of the document's id; ``own``: (place,
    digest) of the text itself, where other texts have its id too."""
    first: dict[int, int] = {}
    for place, h, f in dups:
        if f == doc_id:
            first[h] = min(place, first.get(h, place))
    out: list[list[int]] = []
    for place, h, f in sorted(set(dups)):
        if first.get(h) == place or own is not None and (place, h) not in own:
            continue
        start = place >> LENGTH_BITS
        end = start + (place & (1 << LENGTH_BITS) - 1)
        if out and (start <= out[-1][1] or not text[out[-1][1]:start].strip()):
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, f])
    return [(a, b, f) for a, b, f in out]


def removed_columns(docs: DataFrame) -> tuple[str, str]:
    """Names of the two columns that :func:`dedup_substrings` adds to ``docs``."""
    return free_name(docs, "removed_words"), free_name(docs, "removed_spans")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16) -> DataFrame:
    """``docs`` with the later occurrences cut out of the text, plus
    ``removed_words`` and ``removed_spans`` (start and end in characters of
    the old text, first_doc: the document that keeps the passage); where ``docs`` has
    such columns, the new ones' names end in ``_``."""
    small_batches(docs)
    ch = chunks(docs, id_col, text_col, min_words)
    dups, _ = materialize(later_occurrences(ch), "cdc-dups")
    cols = docs.columns
    key, found, mixed_ids = (free_name(docs, c) for c in ("__cdc_id", "__cdc_dups", "__cdc_shared"))
    words_out, spans_out = removed_columns(docs)
    # ids that different texts share: their passages must be told apart
    hashes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"))
    shared = hashes.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("shared"))
    dups = dups.join(shared, "doc_id", "left")
    rows = docs.withColumn(key, F.col(id_col).cast("long"))
    dups = dups.select(F.col("doc_id").alias(key), F.col("dups").alias(found), F.col("shared").alias(mixed_ids))
    joined = rows.join(dups, key, "left").select(*cols, found, key, mixed_ids)
    at = cols.index(text_col)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                       StructField("first_doc", LongType())])
    schema = StructType([*docs.schema.fields, StructField(words_out, IntegerType()), StructField(spans_out, ArrayType(span))])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first_doc", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, words, spans = [], [], []
            texts, ids, mixed = (b.column(i).to_pylist() for i in (at, len(cols) + 1, len(cols) + 2))
            lists = b.column(len(cols))
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            to = np.cumsum(size)
            flat = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            dups = [list(zip(*(x[k - n:k].tolist() for x in flat), strict=True)) if n else [] for k, n in zip(to.tolist(), size.tolist(), strict=True)]
            full = [t.encode() if t and d else b"" for t, d in zip(texts, dups, strict=True)]
            has: dict[int, set[tuple[int, int]]] = {i: set() for i, m in enumerate(mixed) if m}
            again = list(has)
            for row, place, h in passages([full[i] for i in again], min_words):
                for i, own in zip(row.tolist(), zip(place.tolist(), h.tolist(), strict=True), strict=True):
                    has[again[i]].add(own)
            for i, (t, d, raw) in enumerate(zip(texts, dups, full, strict=True)):
                if not t or not d:
                    text.append(t)
                    words.append(0)
                    spans.append([])
                    continue
                cut = removable(ids[i], raw, d, has.get(i))
                keep, p, said, chars = [], 0, [], 0
                for a, e, first in cut:
                    keep.append(raw[p:a])
                    chars += len(raw[p:a].decode())
                    inner = len(raw[a:e].decode())
                    said.append({"start": chars, "end": chars + inner, "first_doc": first})
                    chars, p = chars + inner, e
                keep.append(raw[p:])
                text.append(b"".join(keep).decode())
                words.append(sum(len(raw[a:e].split()) for a, e, _ in cut))
                spans.append(said)
            arrays = list(b.columns[: len(cols)])
            arrays[at] = pa.array(text, arrays[at].type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(words, pa.int32()), pa.array(spans, span_type)],
                                             [*cols, words_out, spans_out])

    return joined.mapInArrow(run, schema)
