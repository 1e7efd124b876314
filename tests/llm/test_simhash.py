import itertools

import numpy as np
import xxhash

from riskframe.llm import simhash_ball as S


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            low[r] = min(d, low.get(r, d))
    return [low.get(find(i)) for i in range(len(fps))]


def test_query_equals_brute_force(docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 1000000 as doc_id", "text"))
    rows = both.collect()
    fps = [brute_fp(r["text"]) for r in rows]
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), f"{f:016x}", c or -1) for r, f, c in
                  zip(rows, fps, brute_components(fps, [r["doc_id"] for r in rows]), strict=True))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"] or -1)
                 for r in S.simhash_components(both).collect())
    assert got == want


def _links(spark, fps, radius=4):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    return [(r[0] & (2 ** 64 - 1), r[1] & (2 ** 64 - 1)) for r in S.ball_links(df, len(fps), radius).collect()]


def _classes(fps, links):
    idx = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            lo = min(label[idx[a]], label[idx[b]])
            for x in (a, b):
                if label[idx[x]] != lo:
                    label[idx[x]], changed = lo, True
    return label


def test_chains_and_radius(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2 ** 63, 25)]
    fps = set(base)
    for b in base:  # near ones at 1..6 bits, and a chain
        for k in range(1, 7):
            bits = rng.choice(64, k, replace=False)
            fps.add(b ^ sum(1 << int(x) for x in bits))
        x = b
        for _ in range(4):
            x ^= sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps, list(range(len(fps))))
    assert _classes(fps, _links(spark, fps)) == want
    # keys beyond the limit write out their variants, and parts of a key's variants are made in turn: same result
    monkeypatch.setattr(S, "KEY_ROWS_MAX", 5)
    assert _classes(fps, _links(spark, fps)) == want


def test_key_parts(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2 ** 60, 40, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(0b1011)]))
    whole = S._link_key(fps, 0, 4, 2, 4)
    monkeypatch.setattr(S, "VARIANTS_AT_ONCE", 2000)
    parts = S._link_key(fps, 0, 4, 2, 4)
    assert [sorted(zip(*x, strict=True)) for x in (whole,)] == [sorted(zip(*x, strict=True)) for x in (parts,)]
    assert len(whole[0]) == 40


def test_keep_one(docs, odd, empty):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    comp = {r["doc_id"]: r["component_id"] for r in S.simhash_components(odd).collect()}
    known = [i for i in ids if i is not None]
    # an id that repeats with different texts stays where one of its rows leads its group
    assert len(known) == len(set(known)) and set(comp.values()) - {None} >= set(known)
    assert ids.count(None) == 2
    assert S.keep_one(empty).count() == 0 and S.simhash_components(empty).count() == 0
