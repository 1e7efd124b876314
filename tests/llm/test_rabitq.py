import numpy as np

from riskframe.llm import rabitq_dedup as R


def brute(rows, threshold=0.9):
    vecs = []
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        vecs.append(np.array(v, np.float32).astype(float) if ok else None)
    n = len(rows)
    adj = [[] for _ in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            x, y = vecs[a], vecs[b]
            if x is not None and y is not None and len(x) == len(y):
                if np.array_equal(x, y) or x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    adj[a].append(b)
                    adj[b].append(a)
    comp = list(range(n))
    for s in range(n):
        seen, todo = {s}, [s]
        while todo:
            for y in adj[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[i][0] for i in seen if rows[i][0] is not None]
        comp[s] = min(ids) if ids else None
    return [(rows[i][0], len(adj[i]), comp[i]) for i in range(n)]


def planted(rng, groups=25, dim=64):
    rows = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        rows.append(base)
        for noise in (0.0, 0.05, 0.3, 0.5, 0.6, 0.9):
            rows.append(base + noise * rng.standard_normal(dim))
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def sort(rows):
    return sorted(((a is None, a or 0), b, (c is None, c or 0)) for a, b, c in rows)


def test_recall_and_no_false_links(spark):
    rows = planted(np.random.default_rng(5))
    got = {r["vec_id"]: r for r in R.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = brute(rows)
    links = sum(w[1] for w in want)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= n for i, n, _ in want) and found >= 0.9 * links


def test_table_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in R.near_duplicates(df).collect()]
    assert sort(got) == sort(brute(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]),
            (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, []), (None, [1.0, 2.0, 3.1]), (None, None), (1, [1.0, 2.0, 3.0]), (10, [1.0, 2.0]),
            (11, [-1.0, -2.0, -3.0]), (12, [0.0, 1.0, 0.0]), (13, [-0.0, 1.0, 0.0]), (14, [3e38, 3e38, 0.0]), (15, [1e-30, 1e-30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = R.near_duplicates(df)
    assert sort((r["vec_id"], r["n_links"], r["component_id"]) for r in out.collect()) == sort(brute(rows))
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out.collect())
    assert R.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in base + 0.1 * rng.standard_normal(16)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(R, "CELL", 10)
    got = R.near_duplicates(df).collect()
    assert sort((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sort(brute(rows))


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    rot = R.rotation(64)
    x = R.unit(rng.standard_normal((400, 64)))
    y = R.unit(x + 0.4 / 8 * rng.standard_normal((400, 64)) * 8 ** 0.5)
    rows = np.concatenate([x, y])
    c = R.Codes(R.Codes.pack(*R.encode(rows, rot)), 64, rot)
    i, j = np.arange(400), np.arange(400, 800)
    true = np.einsum("ij,ij->i", x, y)
    up = np.diag(c.upper(i, j))
    norm = np.linalg.norm(c.back[i], axis=1) / c.factor[i]
    est = up - c.error[i] - norm * c.lost[j]
    assert abs((est - true).mean()) < 0.01 and (true <= up).all()


def test_recall_holds_as_the_table_grows():
    """Pairs at the threshold, in the codes and bands of tables of 10^4 to 10^9 vectors."""
    rng = np.random.default_rng(11)
    for dim in (64, 256):
        x = R.unit(rng.standard_normal((2500, dim)))
        z = rng.standard_normal((2500, dim))
        z = R.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        y = 0.9 * x + np.sqrt(1 - 0.81) * z
        for n in (10 ** 4, 10 ** 7, 10 ** 8, 10 ** 9):
            bands, k, size = R.plan_bands(n, 0.9, dim)
            rot = R.rotation(dim, size)
            same = R.encode(x, rot)[0] == R.encode(y, rot)[0]
            met = np.zeros(len(x), bool)
            for own in R.band_bits(bands, k, rot.shape[0]):
                met |= same[:, own].all(axis=1)
            assert met.mean() >= 0.965, (dim, n, met.mean())


def test_every_length_is_looked_at(spark, monkeypatch):
    seen = []

    def links(classes, dim, n, threshold):
        seen.append(dim)
        return spark.range(0).selectExpr("id as a", "id as b", "id as n")
    monkeypatch.setattr(R, "band_links", links)
    df = spark.range(2200).selectExpr("id as vec_id", "transform(sequence(0, cast(id div 2 as int)), x -> cast(x + 1 + id as float)) as embedding")
    assert R.near_duplicates(df).count() == 2200 and len(seen) == 1100


def test_several_lengths_and_doubles(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim in (3, 16, 70):
        for _ in range(6):
            base = rng.standard_normal(dim)
            rows += [base, base * 2, base + 0.02 * rng.standard_normal(dim)]
    # two doubles that are one in single precision, and of the threshold's two sides
    rows += [np.array([1.0, 0.0]), np.array([0.9, np.sqrt(0.19) + 1e-9]), np.array([0.9, np.sqrt(0.19) - 1e-9])]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in
           R.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    vecs = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    for i, n, _ in got:
        assert n == sum(j != i and len(v) == len(vecs[i]) and (rows[i][1] == rows[j][1] or v @ vecs[i] >= 0.9) for j, v in enumerate(vecs)), i


def test_a_group_of_near_copies_costs_its_rows(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(32)
    rows = [(i, [float(np.float32(x)) for x in base + 0.01 * rng.standard_normal(32)], 1) for i in range(400)]
    classes = spark.createDataFrame(rows, "rid long, vec array<float>, copies long")
    out = R.band_links(classes, 32, 400, 0.9).collect()
    assert len(out) < 5 * 400
    assert all(sum(r["n"] for r in out if r["n"] is not None and r["a"] == i) == 399 for i in range(0, 400, 37))
