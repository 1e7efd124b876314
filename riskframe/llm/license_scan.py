"""Operator 11: licence notices within a bounded number of edits.

A text is lower-cased (A-Z only) and its words joined by single spaces, so that
line breaks and marks inside a notice don't matter. A notice of ``m`` characters
with at most ``k`` edits is split into ``k + 1`` pieces: of any place within
``k`` edits at least one piece is left exactly as it is, at most ``k`` characters
off its place. One automaton holds the pieces of all notices and finds these
seeds in one pass; around each seed a window of ``m + 2k`` characters, cut to
whole words, goes to the regex library's bounded-error matching, which gives
span and edits. Exact places come straight from the automaton, which also holds
the whole notices.

A place starts and ends at a word's ends. Every exact place is given; of
inexact ones of one notice that overlap each other or an exact one, that with
the fewest edits stays (ties: the earliest). ``keep`` names words that no edit may
touch (in "mit license" the name is a third of the notice).

Rows need no others: nothing is shuffled, the automaton is a fixed table, and a
task holds one block of texts. Null and empty texts have no words and no places;
repeated rows and null ids are kept as they are; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import blocks, text_bytes

#: what stands between words, once A-Z is lower-cased
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: windows whose outcome a worker remembers; it starts afresh beyond that
MEMO = 50_000


class Notice(NamedTuple):
    """A short notice: its label, words, most edits and words that stay whole."""

    label: str
    text: str
    errors: int = 0
    keep: tuple[str, ...] = ()


#: fixed values: wordings of common licence notices (lower case, single spaces)
NOTICES = (
    Notice("mit", "mit license", 1, ("mit",)),
    Notice("mit", "spdx license identifier mit", 2, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache", "apache license", 2),
    Notice("apache", "spdx license identifier apache 2 0", 3),
    Notice("apache", "you may not use this file except in compliance with the license", 6),
    Notice("gpl", "general public license", 3),
    Notice("gpl", "spdx license identifier gpl", 2, ("gpl",)),
    Notice("lgpl", "lesser general public license", 3),
    Notice("agpl", "affero general public license", 3),
    Notice("bsd", "bsd license", 1, ("bsd",)),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license", 3),
    Notice("epl", "eclipse public license", 3),
    Notice("isc", "isc license", 1, ("isc",)),
    Notice("cc", "creative commons attribution", 3),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 7),
    Notice("proprietary", "all rights reserved", 2),
)

PLACES = "array<struct<label:string,notice:string,word:bigint,start:bigint,end:bigint,edits:int,text:string>>"


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length, with their places."""
    cuts = [i * len(text) // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeFinder:
    """Places of ``notices`` in normalised texts."""

    def __init__(self, notices: tuple[Notice, ...]):
        import ahocorasick
        import regex

        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}  # piece -> (notice, place in it; -1: the whole notice)
        for i, n in enumerate(notices):
            if n.text != re.sub(GAP, " ", n.text).strip() or not n.text:
                raise ValueError(f"notice not in normal form: {n.text!r}")
            if len(n.text) <= 4 * n.errors:
                raise ValueError(f"too many errors for {n.text!r}: a window could hold two places")
            seeds.setdefault(n.text, []).append((i, -1))
            for at, piece in pieces(n.text, n.errors) if n.errors else ():
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        if seeds:
            self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}(?!\S)")
                         for n in notices]
        self.memo: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def best(self, i: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of notice ``i``'s best place in a window."""
        key = (i, window)
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            m = self.patterns[i].search(window)
            if m and not set(self.notices[i].keep) <= set(m.group().split(" ")):
                m = None
            self.memo[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
        return self.memo[key]

    def places(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in a normalised text, in order."""
        exact: set[tuple[int, int, int]] = set()
        near: dict[tuple[int, int, int], int] = {}
        looked: set[tuple[int, int, int]] = set()
        for last, (size, uses) in self.automaton.iter(norm):
            at = last + 1 - size
            for i, place in uses:
                n = self.notices[i]
                if place < 0:
                    if (at == 0 or norm[at - 1] == " ") and (last + 1 == len(norm) or norm[last + 1] == " "):
                        exact.add((i, at, last + 1))
                    continue
                lo, hi = at - place - n.errors, at - place + len(n.text) + n.errors
                # whole words only: a place never starts or ends inside one
                lo = 0 if lo <= 0 else norm.find(" ", lo - 1, hi) + 1
                hi = len(norm) if hi >= len(norm) else norm.rfind(" ", lo, hi + 1)
                if hi <= lo or (lo == 0 and at - place - n.errors > 0) or (i, lo, hi) in looked:
                    continue
                looked.add((i, lo, hi))
                got = self.best(i, norm[lo:hi])
                if got and got[2]:
                    near[i, lo + got[0], lo + got[1]] = got[2]
        out = [(s, e, i, 0) for i, s, e in exact]
        taken: dict[int, list[tuple[int, int]]] = {}
        for i, s, e in exact:
            taken.setdefault(i, []).append((s, e))
        for spans in taken.values():
            spans.sort()
        out += self._apart(near, taken)
        return sorted(out)

    @staticmethod
    def _apart(near: dict[tuple[int, int, int], int], exact: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
        """Inexact places that overlap no better one of their notice."""
        from bisect import bisect_left, insort

        out = []
        for (i, s, e), edits in sorted(near.items(), key=lambda x: (x[1], x[0])):
            spans = exact.setdefault(i, [])
            k = bisect_left(spans, (s, e))
            if (k < len(spans) and spans[k][0] < e) or (k and spans[k - 1][1] > s):
                continue
            insort(spans, (s, e))
            out.append((s, e, i, edits))
        return out


_finders: dict[tuple[Notice, ...], NoticeFinder] = {}


def finder(notices: tuple[Notice, ...]) -> NoticeFinder:
    """The finder for ``notices``, built once in a Python worker."""
    if notices not in _finders:
        _finders[notices] = NoticeFinder(notices)
    return _finders[notices]


def scan_text(text: str, f: NoticeFinder) -> tuple[int, list[dict]]:
    """Number of words of a text, and its places with their spans in it."""
    low = text.encode("utf-8", "replace").lower().decode()  # A-Z only, places stay
    norm = re.sub(GAP, " ", low).strip(" ")
    if not norm:
        return 0, []
    found, out, seen, word = f.places(norm), [], 0, 0
    if found:
        spans, it, k = [], re.finditer(WORD, low), -1
        for s, e, i, edits in found:
            word += norm.count(" ", seen, s)
            seen = s
            spans.append((word, word + norm.count(" ", s, e), i, edits))
        need = sorted({w for a, b, _, _ in spans for w in (a, b)})
        where: dict[int, tuple[int, int]] = {}
        for w in need:
            while k < w:
                m, k = next(it), k + 1
            where[w] = m.span()
        for a, b, i, edits in spans:
            n, start, end = f.notices[i], where[a][0], where[b][1]
            out.append({"label": n.label, "notice": n.text, "word": a, "start": start, "end": end, "edits": edits,
                        "text": text[start:end]})
    return norm.count(" ") + 1, out


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places): one row for each row of ``docs``. A place has
    the notice's label and words, the word it starts at, its span in the text's
    code points, the number of edits and the text itself."""
    notices = tuple(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(notices)
        types = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("word", pa.int64()), ("start", pa.int64()),
                                    ("end", pa.int64()), ("edits", pa.int32()), ("text", pa.string())]))
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, j in blocks(texts):
                got = [scan_text(t.decode("utf-8", "replace"), f) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([n for n, _ in got], pa.int64()),
                                                  pa.array([p for _, p in got], types)], ["doc_id", "n_words", "places"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, places {PLACES}")
