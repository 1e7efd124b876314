import random
import zlib

import pytest

from riskframe.llm import sharding as S


def check(rows, docs, n=None):
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows) == sorted(
        ((d["doc_id"] is None, d["doc_id"] or 0), len((d["text"] or "").encode()) + 16, zlib.crc32((d["text"] or "").encode())) for d in docs)
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    home = {}
    for r in rows:
        assert home.setdefault(r["grp"], r["shard"]) == r["shard"]
    return {k: sum(r["size"] for r in v) for k, v in shards.items()}


def test_near_equal_shards(docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = S.shard_rows(both, n_shards=8).collect()
    size = check(rows, both.collect())
    largest = max(r["size"] for r in rows)
    assert set(size) == set(range(8))
    mean = sum(size.values()) / 8
    assert max(size.values()) <= max(mean * 1.02, largest) and min(size.values()) >= 0.9 * min(mean, (sum(size.values()) - largest) / 7)


def test_hot_group_and_capacity(spark, empty):
    rows = [(i, "hot text " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * (1 + i % 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = check(S.shard_rows(df, n_shards=6).collect(), df.collect())
    rest = sorted(size.values())[:-1]
    assert len(size) == 6 and max(rest) <= 1.03 * min(rest)
    cap = 20_000
    size = check(S.shard_rows(df, capacity=cap).collect(), df.collect())
    over = [s for s in size.values() if s > cap]
    assert len(over) == 1 and len(size) <= 1 + 1.1 * (sum(size.values()) - over[0]) / cap + 1
    assert S.shard_rows(empty, n_shards=3).count() == 0
    with pytest.raises(ValueError):
        S.shard_rows(df)


def test_tree_is_best_fit():
    random.seed(2)
    sizes = sorted((random.randint(1, 900) for _ in range(2000)), reverse=True)
    room, want = [], []
    for s in sizes:
        fit = [(r, b) for b, r in enumerate(room) if r >= s]
        if fit:
            b = min(fit)[1]
        else:
            b = len(room)
            room.append(1000)
        room[b] -= s
        want.append(b)
    got = S.best_fit_decreasing(sizes, 1000)
    assert max(got) == max(want)
    fill = [0] * (max(got) + 1)
    for b, s in zip(got, sizes, strict=True):
        fill[b] += s
    assert max(fill) <= 1000
