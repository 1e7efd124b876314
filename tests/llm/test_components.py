import random

from riskframe.llm.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if None in (a, b) or a == b:
                continue
            lo = min(label[a], label[b])
            for x in (a, b):
                if label[x] != lo:
                    label[x], changed = lo, True
    return label


def test_path_star_random(spark):
    random.seed(5)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    some = [(random.randrange(3000, 3400), random.randrange(3000, 3400)) for _ in range(250)]
    edges = path + star + some + [(5, 5), (None, 3), (4, None), (7, 6), (7, 6)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute(edges)
    assert got.keys() == want.keys()
    groups = {}
    for n, root in got.items():
        groups.setdefault(root, set()).add(n)
    groups2 = {}
    for n, root in want.items():
        groups2.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, groups2.values()))
    assert all(root in members for root, members in groups.items())


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
