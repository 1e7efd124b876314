import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskframe.llm import ga_packing as G
from riskframe.llm.token_counts import count_tokens, distinct_pre_tokens
from riskframe.llm.tokens import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def test_packing(docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    tok = Tokenizer.from_file(PATH)
    want = []
    for r in both.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        n, at, k = len(ids), 0, 0
        size = n if n <= 2048 else (n % 2048 or 2048)
        while at < n:
            part = ids[at:at + size]
            want.append((key(r), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at, size, k = at + size, 2048, k + 1
    rows = G.pack_documents(both, PATH).collect()
    assert sorted((key(r), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for off, size in sorted(s):
            assert off == at
            at += size
        assert at <= 2048
    sizes = sorted((w[3] for w in want), reverse=True)
    fills = []
    G.best_fit(sizes, fills, 2048)
    assert len(seqs) <= len(fills)


def test_a_text_is_merged_in_one_call():
    """Whatever its words and white space; what is too long for the merger's pattern goes to the library."""
    enc, merge, calls = ByteBpe(PATH), ByteBpe(PATH).merge, []

    class Counted:
        def __getattr__(self, name):
            def call(*args, **kwargs):
                calls.append(args[0])
                return getattr(merge, name)(*args, **kwargs)
            return call

    enc.merge = Counted()
    texts = [" ".join(f"word{i} x{i * 7}" for i in range(500)), "a  b \n\n c\t d ", " lead", "it's 12\u00a0é", "a <|endoftext|> b", ""]
    want = [np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert len(calls) <= len(texts)
    gap = "a" + "\n" * 1_500_000 + "b"
    assert enc.encode([gap]) == [np.array(enc.whole.encode(gap, add_special_tokens=False).ids, "<u4").tobytes()]


def test_sequences_hold_the_ids(odd):
    tok = Tokenizer.from_file(PATH)
    packed = G.pack_documents(odd.select("doc_id", "text"), PATH, with_ids=True)
    total = sum(len(r["ids"]) for r in G.sequences(packed).collect())
    assert total == sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert G.pack_documents(odd.limit(0), PATH).count() == 0


def test_evolution_is_a_partition_and_no_worse_than_best_fit():
    rng = np.random.default_rng(0)
    size = -np.sort(-rng.choice([700, 690, 680, 670, 660, 400, 350, 300, 90, 1400], 300))
    first = G._complete(size, np.full(len(size), -1), 2048)
    best = G.evolve(size, [], 2048, 3)
    again = G.evolve(size, [best, first], 2048, 4)
    for a in (first, best, again):
        assert np.bincount(a, weights=size).max() <= 2048 and (a >= 0).all()
    assert G.fitness(size, first, 2048) <= G.fitness(size, best, 2048) <= G.fitness(size, again, 2048)
    child = G.crossover(first, best, size, 2048, rng)
    assert np.bincount(child, weights=size).max() <= 2048 and len(child) == len(size)


def test_crossover_does_the_packing(docs):
    """On the query's own pieces: from random groupings down to the least number of bins, by children."""
    size = [r["length"] for r in G.pieces(docs, PATH).collect() if r["length"] < 2048]
    size = -np.sort(-np.array(size))
    bound = -(-size.sum() // 2048)
    elites, trace = [], []
    for seed in range(G.EPOCHS):
        steps = []
        elites = [G.evolve(size, elites, 2048, seed, steps)]
        trace += steps
    assert trace[0] > trace[-1] >= bound and all(a >= b for a, b in zip(trace, trace[1:]))
    fills = []
    G.best_fit(size.tolist(), fills, 2048)
    assert trace[-1] <= len(fills) and len(set(trace)) >= 3


def test_blocks(spark):
    rows = [(i, 100 + i * 37 % 1900) for i in range(500)]
    packed = G.pack(spark.createDataFrame(rows, "doc_id long, length long"), block=60).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == sorted(rows)
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_token_counts(docs, odd, empty):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for r in both.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((key(r), len((r["text"] or "").encode()), n, n > 2048))
    got = [(key(r), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(both, path).collect()]
    assert sorted(got) == sorted(want)
    # all pre-tokens by the join, and all but a few
    for hot in (0, 20):
        got = [(key(r), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(both, path, hot=hot).collect()]
        assert sorted(got) == sorted(want)
    assert count_tokens(empty, path).count() == 0


def test_every_pre_token_is_counted_once(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(i, "one two one <|endoftext|> " * 3 + f"only{i % 5}") for i in range(40)], "doc_id long, text string").repartition(6)
    got = {r["pre"]: (r["times"], r["n"]) for r in distinct_pre_tokens(rows, path).collect()}
    assert {p: t for p, (t, _) in got.items()} == {"one": 240, "two": 120, "<|endoftext|>": 120, **{f"only{k}": 8 for k in range(5)}}
    plan = count_tokens(rows, path)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" in plan and "Generate posexplode" in plan
