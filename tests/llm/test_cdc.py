import random

import numpy as np

from riskframe.llm import cdc_dedup as C


def text(rng, words):
    out = []
    for i in range(words):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 10)))
        out.append(w + (". " if rng.random() < 0.1 else " "))
    return "".join(out).strip()


def test_cuts_resist_shifts():
    rng = random.Random(1)
    body = text(rng, 400).encode()
    whole = {h for _, _, _, hs in C.chunk_texts([body]) for h in hs.tolist()}
    moved = {h for _, _, _, hs in C.chunk_texts([b"some new words " + body[:700] + b" inserted " + body[700:]]) for h in hs.tolist()}
    assert len(whole & moved) >= len(whole) - 4
    # a text is cut alike alone and among others
    both = list(C.chunk_texts([b"first one. ", body]))
    own = np.concatenate([h[r == 1] for r, _, _, h in both])
    assert set(own.tolist()) == whole


def test_chunks_cover_and_keep_characters():
    rng = random.Random(2)
    for t in (text(rng, 300), "é" * 9000, "x" * 10000, "a\nb\n\n c. d! e"):
        raw = t.encode()
        for _, start, length, _ in C.chunk_texts([raw]):
            for s, n in zip(start.tolist(), length.tolist(), strict=True):
                raw[s:s + n].decode()
                assert n <= C.MAX_CHUNK
            covered = b" ".join(raw[s:s + n] for s, n in zip(start.tolist(), length.tolist(), strict=True))
            assert b"".join(covered.split()) == b"".join(raw.split())


def test_planted_passages(spark):
    rng = random.Random(3)
    passages = [text(rng, n) for n in (51, 55, 60, 80, 120) for _ in range(20)]
    stock = text(rng, 9)
    rows, want = [], {}
    for i in range(600):
        own = text(rng, rng.randint(60, 300))
        if i % 3 == 0:
            p = passages[i // 3 % len(passages)]
            cut = own.find(" ", len(own) // 2)
            own = own[:cut] + " " + p + " " + own[cut:]
            want.setdefault(p, []).append(i)
        elif i % 3 == 1:
            own = stock + "\n" + own
        rows.append((i, own))
    out = {r["doc_id"]: r for r in C.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    texts = dict(rows)
    missed = 0
    for p, ids in want.items():
        assert out[min(ids)]["text"] == texts[min(ids)]
        for i in ids:
            if i != min(ids):
                missed += out[i]["removed_words"] < 16
                assert out[i]["removed_words"] <= len(p.split()) + 2
                for s in out[i]["removed_spans"]:
                    assert texts[i][s["start"]:s["end"]].strip() in p and s["first_doc"] == min(ids)
    later = sum(len(ids) - 1 for ids in want.values())
    assert later == 100 and missed <= 2
    for i in range(600):
        if i % 3:
            assert out[i]["text"] == texts[i] and out[i]["removed_spans"] == []


def test_odd_rows(odd, empty):
    out = C.dedup_substrings(odd)
    assert out.columns == [*odd.columns, "removed_words", "removed_spans"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert sum(r["text"] is None for r in rows) == sum(r["text"] is None for r in odd.collect())
    assert C.dedup_substrings(empty).count() == 0


def test_whole_copies(spark):
    rng = random.Random(4)
    t = text(rng, 100)
    df = spark.createDataFrame([(i, t) for i in range(50)] + [(3, "only this")], "doc_id long, text string")
    rows = C.dedup_substrings(df).collect()
    assert sorted(r["text"] for r in rows) == sorted([t, "only this"] + [""] * 49)


def test_passages_without_sentence_ends(spark):
    rng = random.Random(6)

    def plain(words):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(words))
    passages = [plain(n) for n in (51, 60, 80) for _ in range(60)]
    rows = [(2 * i + k, f"{plain(70)} {p} {plain(70)}") for i, p in enumerate(passages) for k in (0, 1)]
    out = {r["doc_id"]: r for r in C.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = lost = 0
    for i, p in enumerate(passages):
        assert out[2 * i]["removed_words"] == 0
        removed = out[2 * i + 1]["removed_words"]
        missed += removed < 16
        lost += max(0, len(p.split()) - removed)
    assert missed <= 6 and lost <= 14 * len(passages)


def test_passages_in_scripts_without_spaces(spark):
    rng = random.Random(7)

    def run(chars, n):
        return "".join(rng.choice(chars) for _ in range(n))
    han, thai = [chr(c) for c in range(0x4E00, 0x5E00)], [chr(c) for c in range(0x0E01, 0x0E2F)]
    code = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    cases = [(chars, run(chars, n)) for chars, n in ((han, 120), (thai, 200), (code, 1500)) for _ in range(20)]
    rows = [(2 * i + k, run(chars, 300) + p + run(chars, 300)) for i, (chars, p) in enumerate(cases) for k in (0, 1)]
    texts = dict(rows)
    out = {r["doc_id"]: r for r in C.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = 0
    for i, (_, p) in enumerate(cases):
        assert out[2 * i]["text"] == texts[2 * i]
        for s in out[2 * i + 1]["removed_spans"]:
            assert texts[2 * i + 1][s["start"]:s["end"]] in p
        removed += len(texts[2 * i + 1]) - len(out[2 * i + 1]["text"]) > len(p) // 2
    assert removed >= 57


def test_short_repeats_without_spaces_stay(spark):
    rows = [(i, f"{chr(0x5000 + i) * 3}版权所有不得转载。{chr(0x6000 + i) * 3}") for i in range(20)]
    rows += [(100 + i, f"word{i} https://example.org/a/b/c/page.html other{i}") for i in range(20)]
    assert all(r["text"] == dict(rows)[r["doc_id"]]
               for r in C.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_columns_of_any_name(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{i} start. {passage} end {i}", i, i, i, i, i, i) for i in range(3)]
    names = ["shared", "dups", "__dups", "__cdc_dups", "removed_words", "removed_spans"]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    words, spans = C.removed_columns(df)
    out = C.dedup_substrings(df).collect()
    assert (words, spans) == ("removed_words_", "removed_spans_")
    assert all(r[n] == r["doc_id"] for r in out for n in names)
    assert [r[words] > 40 for r in sorted(out, key=lambda r: r["doc_id"])] == [False, True, True]


def test_very_long_white_space_in_a_passage(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in ("left", "right"))
    passage = a + " " * (17 << 20) + b
    rows = [(1, f"one. {passage} one"), (2, f"two other words here. {passage} two")]
    out = {r["doc_id"]: r for r in C.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1]
    # what is cut lies within the passage (and the space before it), and most of it goes
    (_, text), spans = rows[1], out[2]["removed_spans"]
    start = text.index(passage)
    assert spans and all(start - 1 <= s["start"] < s["end"] <= start + len(passage) for s in spans)
    assert out[2]["removed_words"] >= 50 and out[2]["text"].startswith("two other words here.") and out[2]["text"].endswith("two")
