"""Operator 13: spelling variants by a relational trie frontier.

Words are the distinct letter runs of all texts that occur often enough. They
are held as two tries, one of the words and one of the words read backwards, as
a distributed edge table (node, label, child): only places where words part,
end, or start their search are nodes, so a label holds all characters between
two of them and a word of any length has few levels.

A word's search starts at the node of its first half in either trie, as the
state (word, position, node, no edit). A level joins all states with the edges
of their node: a label that equals the word's next characters keeps the edits;
one that is a single edit away moves on with one edit, if its node is
followed by the word's next character and has a word of the near word's length
below. A state whose edit is spent joins
by its next character too. A state that has used up its word at a node where
another word ends, with one edit, is a pair of neighbours. An edit in the first half of a word is
one in the second half of its mirror image, so each pair is found in one trie or
the other, while the crowded tops of the tries are never searched. Levels go on
until no state is left.

Nodes are known by 64-bit hashes of their prefixes; equal hashes of different
prefixes can only add states, and every pair is compared again at the end.
Levels are as many as the nodes on a path, so only long families of words that
are each other's prefixes take many.

Null and empty texts have no runs; a null id counts as the empty string; repeated
rows count again; other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, text_bytes
from riskframe.session import drop_path, materialize

RUN = "[A-Za-zÀ-ÿ]"
#: a form's count is at least twice its variant's, so 2^63 rows give no longer chain than 63 forms
DOUBLINGS = 6
#: distinct words that a task counts before it hands them on
COUNTED = 200_000


def altered(run: str, doc: int) -> str:
    """``run``, or the run without one code point where 97 divides its hash;
    ``doc`` is the crc32 of the document's id and a colon."""
    h = zlib.crc32(run.encode(), doc)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): the words and their occurrences overall."""
    # whole runs only: from its first letter on a run is matched to its end; a shorter one gives no word, as letters only go
    runs = re.compile(f"{RUN}{{{max(1, min_length)},}}")

    def counted(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32, total = zlib.crc32, {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = crc32(f"{doc}:".encode())
                for w, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                    if crc32(w.encode(), start) % 97 == 0:
                        w = altered(w, start)
                        if len(w) < min_length:
                            continue
                    total[w] = total.get(w, 0) + n
                if len(total) >= COUNTED:
                    yield counted(total)
                    total = {}
        yield counted(total)

    # bytes.lower() knows A-Z only
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_bytes(text_col).alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _start(n: int) -> int:
    """Position at which a word of ``n`` characters starts its search."""
    return n // 2 if n > 2 else 0


def _prefix_rows(words: list[str], side: int) -> tuple[np.ndarray, ...]:
    """Of all words, from the depth at which a word one shorter starts its search
    to their ends: index of the word, depth, hash of the prefix (a polynomial, then
    mixed), the next character's code point (-1 at the end), whether the word's own search
    starts there, and the word's length."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<i4")
    code = chars.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
    power = np.cumprod(np.full(int(size.max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
    at = np.arange(len(chars)) - np.repeat(first, size)
    upto = np.r_[np.uint64(0), np.cumsum(code * power[at])]
    lo = np.array([_start(n - 1) for n in size.tolist()], np.int64)
    rows = size - lo + 1
    which = np.repeat(np.arange(len(words)), rows)
    depth = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows) + lo[which]
    place = first[which] + depth
    h = upto[place] - upto[first[which]] + np.uint64(side + 1) * np.uint64(0x94D049BB133111EB)
    h = (h + depth.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    end = depth == size[which]
    following = np.where(end, -1, np.r_[chars, [-1]][place]).astype(np.int32)
    starts = depth == np.array([_start(n) for n in size.tolist()], np.int64)[which]
    return which, depth.astype(np.int32), (h ^ (h >> np.uint64(32))).view(np.int64), following, starts, size[which]


def _prefixes(words: DataFrame) -> DataFrame:
    """(side, wid, depth, node, next, starts, length): the prefixes of each word
    and of its mirror image (side 1); see :func:`_prefix_rows`."""
    names = ["side", "wid", "depth", "node", "next", "starts", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = b.column(0).to_numpy(), b.column(1).to_pylist()
            for i, j in blocks([w.encode() for w in got], 100_000):
                for side in (0, 1):
                    which, depth, node, following, starts, size = _prefix_rows([w[::-1] if side else w for w in got[i:j]], side)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(which), side, np.int32)), pa.array(ids[i:j][which]), pa.array(depth), pa.array(node),
                         pa.array(following), pa.array(starts), pa.array(size.astype(np.int32))], names)

    return words.select("wid", "word").mapInArrow(run, "side int, wid long, depth int, node long, next int, starts boolean, length int")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The start states (side, word, position, node, edits, target) and the edge
    table (node, label, child, ends, onward, lengths) of both tries, and the paths
    they are written to. ``onward`` holds the characters that follow the child,
    ``lengths`` the lengths modulo 64 of the words below it, as bits. ``word`` and
    ``ends`` (the words that end at the child: none or one, unless hashes are equal)
    are spelt in their trie's direction."""
    words, path0 = materialize(words.select("word", F.monotonically_increasing_id().alias("wid")), "trie-ids")
    pre, path1 = materialize(_prefixes(words), "trie-prefixes")
    # a node: words part or end here, or a search starts
    nodes = (pre.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.max("starts").alias("s"),
                                     F.bit_or(F.expr("shiftleft(1L, length % 64)")).alias("lengths"))
             .where("a <> b or a < 0 or s").select("node", "lengths"))
    nodes, path2 = materialize(nodes, "trie-nodes")
    spelt = F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    path = Window.partitionBy("wid", "side").orderBy("depth")  # one word's nodes: no more than it has characters
    marks = (pre.join(nodes.select("node"), "node").select("side", "wid", "depth", "node", "starts").join(words, "wid")
             .select("side", spelt.alias("word"), "depth", "node", "starts", F.lead("node").over(path).alias("child"),
                     (F.lead("depth").over(path) - F.col("depth")).alias("by")))
    marks = marks.select("side", "depth", "node", "starts", "child", F.when(F.col("starts"), F.col("word")).alias("word"),
                         F.expr("substring(word, depth + 1, by)").alias("label"),
                         F.when(F.col("depth") + F.col("by") == F.length("word"), F.col("word")).alias("ends"))
    marks, path3 = materialize(marks, "trie-marks")
    start = marks.where("starts").select("side", "word", F.col("depth").alias("position"), "node", F.lit(0).alias("edits"),
                                         F.length("word").alias("target"))
    edges = marks.where("child is not null").groupBy("node", "child", "label").agg(F.collect_set("ends").alias("ends"))
    edges, path4 = materialize(edges, "trie-edges")
    # the characters that may follow a child: no more than the alphabet has
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("onward"))
    edges = edges.join(nodes.withColumnRenamed("node", "child"), "child").join(onward, "child", "left")
    edges, path5 = materialize(edges.withColumn("onward", F.coalesce("onward", F.lit(""))), "trie-onward")
    return start, edges, [path0, path1, path2, path3, path4, path5]


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words that differ by exactly one
    inserted, deleted or replaced code point."""
    spark = words.sparkSession
    frontier, edges, paths = trie(words)
    found = []
    size = F.length("label")

    def ahead(more: int):
        return F.expr(f"substring(word, position + 1, greatest(length(label) + ({more}), 0))")

    same = F.col("label") == ahead(0)
    # a node's labels start differently: but for one, an edit can only be of the first character, and the rest is compared as it is
    first = F.substring("label", 1, 1) == F.expr("substring(word, position + 1, 1)")
    rest = {0: F.expr("substring(label, 2) = substring(word, position + 2, length(label) - 1)"),
            -1: F.expr("substring(label, 2) = substring(word, position + 1, length(label) - 1)"),
            1: F.expr("label = substring(word, position + 2, length(label))")}
    # lengths fix the kind of the edit: replaced (0), inserted in the near word (-1), deleted from it (1)
    kinds = {k: (F.length("word") - F.col("position") >= size + k) & (
        ((size == 1) & F.lit(k < 1)) | F.when(first, F.levenshtein("label", ahead(k), 1) == 1).otherwise(rest[k])) for k in (0, -1, 1)}

    def below(k: int):
        """Whether a word of the near word's length is below the child."""
        return F.expr(f"shiftright(lengths, (target - ({k})) % 64) & 1L") == 1

    table = [[(k, 1) for i, k in enumerate(kinds) if held >> i & 1] for held in range(1 << len(kinds))] + [[(0, 0)]]
    moves = F.from_json(F.lit(json.dumps([[{"k": k, "edits": e} for k, e in some] for some in table])), "array<array<struct<k:int,edits:int>>>")

    while True:
        # no edit yet: every edge of the node
        fresh = frontier.where("edits = 0").join(edges, "node")
        # most edges lead nowhere, which is found out once: a move is looked up by the kinds that hold
        bits = [F.when(below(k) & ok, F.lit(1 << i)).otherwise(0) for i, (k, ok) in enumerate(kinds.items())]
        held = F.when(same, len(table) - 1).otherwise(bits[0] + bits[1] + bits[2])
        fresh = fresh.select("side", "word", "position", "target", size.alias("size"), "child", "ends", "onward", F.explode(F.get(moves, held)).alias("m"))
        fresh = fresh.select("side", "word", (F.col("position") + F.col("size") + F.col("m.k")).alias("position"), "child", "m.edits",
                             (F.col("target") - F.col("m.k")).alias("target"), "ends", "onward")
        # the edit is spent: the one edge that goes on with the word
        spent = frontier.where("edits = 1").withColumn("c", F.expr("substring(word, position + 1, 1)"))
        spent = spent.join(edges.withColumn("c", F.substring("label", 1, 1)), ["node", "c"]).where(same & below(0))
        spent = spent.select("side", "word", (F.col("position") + size).alias("position"), "child", "edits", "target", "ends", "onward")
        step = fresh.unionByName(spent).withColumn("left", F.length("word") - F.col("position"))
        # the whole word with one edit, or all but its last character with none
        step = step.withColumn("hit", (F.size("ends") > 0) & (F.col("left") == 1 - F.col("edits")))
        alive = F.when(F.col("edits") == 0, F.col("onward") != "").otherwise(
            (F.col("left") > 0) & F.expr("instr(onward, substring(word, position + 1, 1)) > 0"))
        step = step.select("side", "word", "position", F.col("child").alias("node"), "edits", "target", F.when(F.col("hit"), F.col("ends")).alias("ends"),
                           alive.alias("alive")).where("alive or ends is not null")
        step, path = materialize(step, "trie-level")
        paths.append(path)
        found.append(step.where("ends is not null").select("side", "word", F.explode("ends").alias("near")))
        frontier = step.where("alive").drop("ends", "alive")
        if frontier.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    there = F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    back = F.when(F.col("side") == 1, F.reverse("near")).otherwise(F.col("near"))
    pairs = pairs.select(there.alias("word"), back.alias("near")).where(F.levenshtein("word", "near", 1) == 1).distinct()
    out, _ = materialize(pairs, "trie-pairs")
    for p in paths:
        drop_path(spark, p)
    return out


def variant_forms(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct
    words: the form is the near word of largest count (ties: the smallest), if
    it has at least twice the word's count; the root is where the forms end."""
    words, _ = materialize(words.select("word", "n"), "trie-words")
    pairs = near_words(words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (pairs.join(counts, "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("b")))
    out = words.join(best, "word", "left")
    strong = -F.col("b.neg") >= 2 * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(strong, F.col("b.near")).alias("form"), F.when(strong, -F.col("b.neg")).alias("form_n"))
    out, _ = materialize(out, "trie-forms")
    jump = out.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(DOUBLINGS):
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = jump.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        if k % 2:
            jump, _ = materialize(jump, "trie-roots")
    return out.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
