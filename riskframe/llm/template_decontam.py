"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become words (letters and digits; a decimal mark inside a number stays).
A word with a leading digit is ``<num>``, one with a leading capital ``<name>``,
a unit of measure ``<unit>``; other words stay, in lower case. Benchmark items
are cut into windows of ``window`` template words (a shorter item is one
window). A window is looked up by its anchor, its longest plain word: the
documents' words are hash-joined with the anchors, and around each match the
document's window must have the same template hash. Each window then must be
filled consistently with those that it overlaps at the same offset: the same
word of the item is always the same word of the document, and within the window
itself they map one to one. A conflict elsewhere in the item does not void it.
A window whose words
are literally the same, but for case, needs no such check. Windows with fewer
than ``min_plain`` plain words are too vague for the template path and must match
literally; a window without any plain word (names, numbers and units only) is
anchored on its longest word, and matches literally too.

Null and empty texts hold nothing; items that are null or without words match
nothing. Everything is DataFrame functions; documents are never
shuffled to find matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: units of measure that count as <unit>
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "sec",
         "seconds", "min", "minutes", "h", "hr", "hours", "days", "weeks", "months", "years", "meters", "metres",
         "kilometers", "miles", "grams", "kilograms", "liters", "litres", "dollars", "euros", "cents", "percent")
#: separators: anything but letters and digits, except a decimal mark between digits
SEPARATOR = r"[^\p{L}\p{N}.,]+|(?<!\p{N})[.,]+|[.,]+(?!\p{N})"
#: window rows up to which the benchmark side is broadcast (at most about 100 MB)
BROADCAST_ROWS = 300_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR), "")


def kind(word: Column) -> Column:
    """Placeholder of a word, or null for a plain one."""
    first = F.substring(word, 1, 1)
    return (F.when(first.between("0", "9"), "<num>").when(first != F.lower(first), "<name>")
            .when(word.isin(*UNITS), "<unit>"))


def canonical(word: Column) -> Column:
    return F.coalesce(kind(word), F.lower(word))


def template(ws: Column) -> Column:
    return F.transform(ws, canonical)


def slots(ws: Column) -> Column:
    """Words in the placeholders, in order."""
    return F.transform(F.filter(ws, lambda w: kind(w).isNotNull()), F.lower)


def lower_all(ws: Column) -> Column:
    return F.transform(ws, F.lower)


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """All windows of the benchmark: (item_id, version (its text), at (place in the
    item), n, anchor, before (words before the anchor), template, literal, filled, plain)."""
    ws = bench.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))
    win = ws.select("item_id", F.xxhash64("ws").alias("version"), "ws", F.explode(starts).alias("at")).select(
        "item_id", "version", "at", F.slice("ws", F.col("at"), window).alias("w"))
    ranked = F.transform("w", lambda x, i: F.struct(kind(x).isNull().alias("plain"), F.length(x).alias("size"),
                                                    F.lower(x).alias("word"), (-i).alias("i")))
    win = win.select("item_id", "version", "at", "w", ranked.alias("p"))
    best = F.array_max("p")  # the longest plain word, or the longest of all where none is plain
    return win.select("item_id", "version", "at", F.size("w").alias("n"), best["word"].alias("anchor"), (-best["i"]).alias("before"),
                      F.xxhash64(template(F.col("w"))).alias("template"), F.xxhash64(lower_all(F.col("w"))).alias("literal"),
                      slots(F.col("w")).alias("filled"), F.size(F.filter("p", lambda s: s["plain"])).alias("plain")).distinct()


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = 8, min_plain: int = 4) -> DataFrame:
    """(doc_id, item_ids, n_windows): one row for each document id with a
    benchmark window in it; n_windows counts matches, over rows that repeat the
    id. A null id stands for all rows without one."""
    win = windows(bench, window=window)
    tok = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                      words(F.col(text_col)).alias("ws"))
    tok = tok.select("doc_id", "row", "ws", F.posexplode("ws").alias("pos", "word")).withColumn("anchor", F.lower("word"))
    if win.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        win = F.broadcast(win)
    near = tok.join(win, "anchor").where("pos >= before and pos - before + n <= size(ws)")
    # a generated column keeps the checks below out of the join: with their lambdas in its condition the join could
    # not be compiled together with the explode, and every word's row would carry a copy of its text
    own = near.select("doc_id", "row", "item_id", "version", "at", "pos", "before", "template", "literal", "filled", "plain",
                      F.explode(F.array(F.slice("ws", F.col("pos") - F.col("before") + 1, F.col("n")))).alias("w"))
    own = own.withColumn("same", F.xxhash64(lower_all(F.col("w"))) == F.col("literal")).where(
        F.col("same") | ((F.col("plain") >= min_plain) & (F.xxhash64(template(F.col("w"))) == F.col("template"))))
    # a literal match has no slots to check (its case may differ, and with it its placeholders)
    pairs = F.when(F.col("same"), F.array().cast("array<struct<b:string,d:string>>")).otherwise(
        F.zip_with("filled", slots(F.col("w")), lambda b, d: F.struct(b.alias("b"), d.alias("d"))))
    found = own.select("doc_id", "row", "item_id", "version", (F.col("pos") - F.col("before") - F.col("at")).alias("offset"),
                       F.struct("at", "same", pairs.alias("pairs")).alias("w"))
    # what one place of one document shares with one item: bounded by the item's length, one window for each ``at``
    place = found.groupBy("doc_id", "row", "item_id", "version", "offset").agg(F.sort_array(F.collect_list("w")).alias("w"))

    def consistent(x: Column, i: Column) -> Column:
        around = F.slice("w", F.greatest(F.lit(1), i + 2 - window), 2 * window - 1)
        overlap = F.filter(around, lambda y: F.abs(y["at"] - x["at"]) < window)
        pooled = F.array_distinct(F.flatten(F.transform(overlap, lambda y: y["pairs"])))
        inner = F.array_distinct(x["pairs"])
        function = F.size(F.array_distinct(F.transform(pooled, lambda z: z["b"]))) == F.size(pooled)
        return x["same"] | (function & (F.size(F.array_distinct(F.transform(inner, lambda z: z["d"]))) == F.size(inner)))

    hits = place.select("doc_id", "item_id", F.size(F.filter("w", consistent)).alias("n")).where("n > 0")
    return hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("n").alias("n_windows"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 8, min_plain: int = 4) -> DataFrame:
    """``docs`` without the rows whose id is contaminated."""
    bad = contaminated(docs, bench, id_col, text_col, window, min_plain).select(F.col("doc_id").alias("__bad_id"))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["__bad_id"]), "left_anti")
