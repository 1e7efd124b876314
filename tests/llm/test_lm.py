import math
import re
import zlib
from collections import Counter

import pytest

from riskframe.llm import deleted_interpolation as D


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def part(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


@pytest.mark.parametrize("block", [16_000_000, 3_000])
def test_scores_equal_brute_force(docs, odd, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_TEXT", block)
    monkeypatch.setattr(D, "BUCKET_TEXT", 200_000)
    learned = {}
    learn = D.learn_weights
    monkeypatch.setattr(D, "learn_weights", lambda *a: learned.setdefault("w", learn(*a)))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = both.collect()
    c1, c2 = Counter(), Counter()
    for r in rows:
        if part(r["doc_id"]):
            t = tokens(r["text"])
            c1.update(t)
            c2.update(zip([None, *t], t, strict=False))
    n, v = sum(c1.values()), len(c1)
    got = D.score_documents(both).collect()
    assert len(got) == len(rows)
    w = learned["w"]
    want = []
    for r in rows:
        t = tokens(r["text"])
        base = sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = 0.0
        for a, b in zip([None, *t], t, strict=False):
            x = w[min(c1[a].bit_length(), D.CLASSES - 1)]
            score += math.log10(x[0] * (c2[a, b] / c1[a] if c1[a] else 0) + x[1] * c1[b] / n + x[2] / (v + 1))
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(t), part(r["doc_id"]) == 0, sum(c1[x] > 0 for x in t), n, base, score))
    have = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
            for r in got]
    for a, b in zip(sorted(want), sorted(have), strict=True):
        assert a[:6] == b[:6] and b[6:] == pytest.approx(a[6:], rel=1e-9)
    assert (w >= 0).all() and w.sum(axis=1) == pytest.approx(1) and (w[:, 2] > 0).all()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_by_em():
    import pandas as pd

    # a context class whose pair estimate is always right and one where it is never
    cells = pd.DataFrame([(3, 0, 5 * D.STEPS, 1000), (5, -1, 2 * D.STEPS, 1000)], columns=["cls", "s2", "s1", "n"])
    w = D.learn_weights(cells, 1000.0)
    assert w[3, 0] > 0.99 and w[5, 0] < 0.01 and w[5, 1] > 0.9


def test_empty_and_untrained(empty, spark):
    assert D.score_documents(empty).count() == 0
    only = next(i for i in range(100) if part(i) == 0)
    r = D.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()[0]
    assert r["held_out"] and r["n_tokens"] == 3 and r["train_tokens"] == 0 and r["score"] == 0.0
