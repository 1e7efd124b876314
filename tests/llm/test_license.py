import random
import re

import pytest

from riskframe.llm import license_scan as L
from riskframe.llm.queries import BASE_PHRASES, QUERIES


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())


def distances(words, notice, errors):
    """Edits of every span of whole words within the bound, by the textbook table."""
    out = {}
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            s = " ".join(words[a:b])
            if len(s) > len(notice) + errors:
                break
            if len(s) < len(notice) - errors:
                continue
            row = list(range(len(notice) + 1))
            for x, c in enumerate(s, 1):
                new = [x]
                for y, d in enumerate(notice, 1):
                    new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (c != d)))
                row = new
            if row[-1] <= errors:
                out[a, b] = row[-1]
    return out


def planted(rng, n):
    letters = "abcdefilmnopst"
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(rng.randint(0, 6))]
            s = list(rng.choice(L.NOTICES).text)
            for _ in range(rng.randint(0, 4)):
                k, at = rng.randint(0, 2), rng.randrange(len(s))
                s[at:at + (k != 1)] = [] if k == 0 else [rng.choice(letters)]
                s = s or ["x"]
            parts.append("".join(s))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts).title())
    return texts


def check(text, n_words, places, notices=L.NOTICES):
    words = words_of(text)
    assert n_words == len(words)
    for n in notices:
        near = distances(words, n.text, n.errors)
        if n.keep:
            near = {s: e for s, e in near.items() if set(n.keep) <= set(words[s[0]:s[1]])}
        mine = []
        for p in places:
            if p["notice"] == n.text:
                assert text[p["start"]:p["end"]] == p["text"] and p["label"] == n.label
                got = words_of(p["text"])
                span = (p["word"], p["word"] + len(got))
                assert words[span[0]:span[1]] == got and near[span] == p["edits"]
                mine.append((span, p["edits"]))
        # every exact place, and every other one or a better one that it overlaps
        for (a, b), e in near.items():
            over = [x for (c, d), x in mine if c < b and a < d]
            assert over and (min(over) <= e), (text, n.text, (a, b), e, mine)
            if e == 0:
                assert ((a, b), 0) in mine
        for s, e in mine:
            assert e == 0 or not any(t != s and t[0] < s[1] and s[0] < t[1] and x < e for t, x in mine)


def test_against_brute_force(spark, odd):
    rng = random.Random(5)
    texts = planted(rng, 50) + ["mit license mit license", "submit license", "MIT-Licence", "the Apache\n License", "mitlicense", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        check(t or "", got[i]["n_words"], got[i]["places"])
    labels = {t: {p["label"] for p in got[i]["places"]} for i, t in enumerate(texts)}
    assert labels["submit license"] == set() and labels["MIT-Licence"] == {"mit"} and labels["the Apache\n License"] == {"apache"}
    assert [p["edits"] for p in got[50]["places"]] == [0, 0]


def test_one_edit_in_every_place(spark):
    f = L.NoticeFinder(L.NOTICES)
    for n in L.NOTICES:
        if not n.errors or n.keep:
            continue
        for at in range(len(n.text)):
            if " " in n.text[max(at - 1, 0):at + 2]:  # a word may be lost whole
                continue
            for s in (n.text[:at] + "q" + n.text[at + 1:], n.text[:at] + "q" + n.text[at:], n.text[:at] + n.text[at + 1:]):
                _, places = L.scan_text(f"xx {s} yy", f)
                hit = [p for p in places if p["notice"] == n.text]
                assert [(p["edits"], p["text"]) for p in hit] == [(1, s)]


def test_odd_rows(odd, empty):
    rows = L.scan(odd).collect()
    assert len(rows) == odd.count() and all(r["places"] == [] for r in rows)
    assert sorted(r["n_words"] for r in rows) == sorted(len(words_of(r["text"])) for r in odd.collect())
    assert L.scan(empty).count() == 0


def test_bad_notices():
    with pytest.raises(ValueError, match="too many errors"):
        L.NoticeFinder((L.Notice("x", "mit", 1),))
    with pytest.raises(ValueError, match="normal form"):
        L.NoticeFinder((L.Notice("x", "MIT, license", 1),))


def test_query(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in QUERIES["op11_license_scan"](spark, sf_dir).collect()}
    assert len(got) == docs.count()
    for d in docs.collect():
        w = words_of(d["text"])
        hits = sorted((k, lab) for p, lab in BASE_PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None),
            ",".join(sorted({lab for _, lab in hits})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not hits)
