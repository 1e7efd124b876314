import random
import re
import zlib
from collections import Counter, defaultdict

from riskframe.llm import variant_trie as V
from riskframe.llm.queries import QUERIES


def brute_counts(rows, min_length=5, min_count=3):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}


def brute_near(words):
    """Words that share a deletion variant, or are one, compared exactly."""
    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)):] == b[i + 1:]

    cells, near = defaultdict(set), defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            cells[v].add(w)
    for c in cells.values():
        for a in c:
            near[a] |= {b for b in c if one_edit(a, b)}
    return near


def brute_forms(counts):
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_near_words_of_all_lengths(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(900)}
    words |= {"a" * k for k in range(1, 40)} | {"ab" * k for k in range(1, 20)}
    long = "".join(rng.choices("abcdefgh", k=6000))
    words |= {long, long[:-1], long[1:], long + "x", long[:3000] + "z" + long[3001:], long[:2000] + long[2001:], long[:4500] + "q" + long[4500:]}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = defaultdict(set)
    rows = V.near_words(df).collect()
    for r in rows:
        got[r["word"]].add(r["near"])
    assert sum(map(len, got.values())) == len(rows)
    want = brute_near(words)
    assert {w: v for w, v in want.items() if v} == dict(got)


def test_an_edge_is_judged_once(spark, monkeypatch):
    """A level finds out once whether an edge leads anywhere; a word's nodes are not gathered into lists."""
    plans, write = {}, V.materialize

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(V, "materialize", noted)
    words = ["abcde", "abcdf", "abcxde", "bcdea", "acde"]
    got = V.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {(r["word"], r["near"]) for r in got} == {(w, v) for w, vs in brute_near(words).items() for v in vs}
    assert plans["trie-level"].count("levenshtein(") == 3
    assert "collect_list" not in plans["trie-marks"]


def test_chains_and_ties(spark):
    counts = {"worda": 3, "wordb": 6, "wordbb": 12, "wordbbb": 24, "xwordbbb": 48, "tiesa": 3, "tiesb": 9, "tiesc": 9, "alone": 5,
              "almost": 4, "almosu": 7}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = as_dict(V.variant_forms(df))
    assert got == brute_forms(counts)
    assert got["worda"][1] == "xwordbbb" and got["tiesa"][0] == "tiesb" and got["almost"] == (None, "almost", 4, 1, None)


def test_long_chain(spark):
    # each word one letter longer and twice as common: 40 forms up to the root
    counts = {"a" * (5 + k): 3 * 2 ** k for k in range(41)}
    got = as_dict(V.variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute_forms(counts) and got["aaaaa"][1] == "a" * 45


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    counts = brute_counts(rows, 2, 2)
    got = as_dict(V.variant_forms(V.word_counts(odd, 2, 2)))
    assert got == brute_forms(counts) and len(got) > 3
    assert V.variant_forms(V.word_counts(empty)).count() == 0


def test_query(spark, sf_dir, docs):
    counts = brute_counts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert as_dict(QUERIES["op13_spelling_variants"](spark, sf_dir)) == brute_forms(counts)
