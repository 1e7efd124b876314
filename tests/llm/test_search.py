import math
import random
import re
from collections import Counter

import numpy as np

from riskframe.llm import nra_search as N


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    """Every score of every document, straight from the formula."""
    bags = [(i, Counter(tokens(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for i, b in bags:
            m = 25 + (75 * b.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 8 * m))
                    for t in tokens(text) if t in b)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k], 1)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def found(df):
    return sorted(map(tuple, df.collect()), key=key)


def test_best_reads_only_what_it_needs():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(1, 3000))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            some = rng.permutation(n)[:int(rng.integers(1, n + 1))].astype(np.int32)
            # steep or flat, with many ties
            x = np.sort((rng.pareto(1.0, len(some)) * 5 + 1).astype(np.int64) if trial % 2 else rng.integers(1, 5, len(some)))[::-1]
            order = np.lexsort((some, -x))
            lists.append((some[order], x[order]))
        whole = np.zeros(n, np.int64)
        for d, x in lists:
            np.add.at(whole, d, x)
        order = np.lexsort((np.arange(n), -whole))
        order = order[whole[order] > 0][:10]
        top, score, read = N.best(lists, n, 10, first=8)
        assert top.tolist() == order.tolist() and score.tolist() == whole[order].tolist()
        assert read <= sum(len(d) for d, _ in lists)
    # a clear winner at the head of both lists: the tails stay unread
    d = np.arange(5000, dtype=np.int32)
    x = np.r_[np.arange(100, 89, -1) * 1000, np.full(4989, 3)].astype(np.int64)
    top, _, read = N.best([(d, x), (d, x)], 5000, 10)
    assert top.tolist() == list(range(10)) and read < 500


def test_against_brute_force(spark, docs, odd):
    rng = random.Random(2)
    vocab = ["the", "of", "straße", "日本語", "a1", "x"] + [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(None, rows[7][1]), (None, None), (5, rows[7][1]), (2000, "W1, The-THE w2 " * 3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 15)))) for i in range(25)]
    items += [(3, items[3][1]), (None, "the of w1"), (77, None), (78, ""), (79, "unknown words only"), (80, rows[7][1] + " the the")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(rows, items, 10), key=key)
    assert found(N.search(d, q)) == want
    assert found(N.search(d, q, query_bytes=400, shard_bytes=3000)) == want
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    odd_items = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = found(N.search(both, odd, item_col="doc_id"))
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in both.collect()], odd_items, 10), key=key)


def test_empty(odd, empty):
    assert N.search(empty, odd, item_col="doc_id").count() == 0
    assert N.search(odd, empty, item_col="doc_id").count() == 0
