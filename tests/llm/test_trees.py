import hashlib
import itertools

from pyspark.sql import functions as F

from riskframe.llm import reply_trees as T
from riskframe.llm.queries import QUERIES

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def paths(rows):
    """Branches of each tree, by brute force: (score, length, nodes from the root)."""
    out = {}
    for t in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == t}
        parents = {n: (r[2] if r[2] in own and r[2] != n else None) for n, r in own.items()}
        for n in own:
            if n not in parents.values():
                p = [n]
                while parents[p[-1]] is not None:
                    p.append(parents[p[-1]])
                out.setdefault(t, []).append((sum(own[x][5] or 0 for x in p), len(p), p[::-1]))
    return out


def test_branches_by_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for t in range(12):
        for n in range(rng.choice([1, 2, 9, 40])):
            parent = rng.choice([None, n, 999]) if n == 0 else rng.randrange(n)
            rows.append((t, n, parent, rng.choice(["user", "assistant"]), f"t{t} n{n} <&>", float(rng.randrange(4))))
    rows += [(50, n, n - 1 if n else None, "user", f"chain {n}", None) for n in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = T.format_trees(df, top=None).withColumn("turns", T.read_turns(F.col("formatted"))).collect()
    text = {(r[0], r[1]): r[4] for r in rows}
    want = paths(rows)
    got = {}
    for r in out:
        got.setdefault(r["tree"], []).append((r["rank"], [x["text"] for x in r["turns"]]))
    assert got.keys() == want.keys()
    for t, bs in want.items():
        assert sorted(x for _, x in got[t]) == sorted([text[t, n] for n in p] for _, _, p in bs)
        score = {tuple(text[t, n] for n in p): (s, k) for s, k, p in bs}
        ranked = [score[tuple(x)] for _, x in sorted(got[t])]
        assert ranked == sorted(ranked, reverse=True)
    best = {r["tree"]: r for r in T.format_trees(df).collect()}
    assert len(best) == 13 and best[50]["n_turns"] == 70


def test_reversible(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n", "\n</turn>\n<turn:user>\n", "&lt;", "&amp;lt;", "<turn:assistant>\nx", "", None,
            "\n", "é\U0001f600<", "$1 \\1 \\E", ">"]
    rows = [(1, i, i - 1 if i else None, r, t, None) for i, (r, t) in
            enumerate(itertools.product(["user", "assistant", "as>s\n<istant", None], hard))]
    out = (T.format_trees(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", T.read_turns(F.col("formatted")))
           .withColumn("said", T.read_loss(F.col("formatted"), F.col("loss"))))
    r = out.collect()[0]
    assert [(x["role"], x["text"]) for x in r["turns"]] == [(a[3] or "", a[4] or "") for a in rows]
    assert r["said"] == "".join(a[4] or "" for a in rows if a[3] == "assistant")


def test_odd_rows(spark):
    rows = [(None, 1, None, "user", "null tree", 1.0), (None, 2, 1, "assistant", "reply", 1.0), (1, None, None, "user", "no id", None),
            (1, None, 5, "user", "no id either", None), (1, 5, 5, "user", "own parent", 2.0), (1, 5, 5, "user", "own parent", 2.0),
            (2, 1, 77, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    out = T.format_trees(df, top=None).collect()
    assert sorted((r["tree"] or 0, r["n_turns"]) for r in out) == [(0, 2), (1, 1), (1, 1), (1, 1), (2, 1)] or len(out) == 5
    assert T.format_trees(df.limit(0)).count() == 0


def test_circle_is_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(T, "MAX_ROUNDS", 6)
    with pytest.raises(ValueError):
        T.format_trees(spark.createDataFrame([(1, 1, 2, "user", "a", None), (1, 2, 1, "user", "b", None)], SCHEMA)).collect()


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        turns = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    df = QUERIES["op3_chat_formatting"](spark, sf_dir)
    got = {r["conv_id"]: tuple(r)[1:5] for r in df.collect()}
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
