from riskframe.llm import template_decontam as T

BENCH = [(1, "Alice buys 12 apples for 3 dollars each and then gives Alice twin sister half of them. How many remain?"),
         (2, "the quick brown fox jumps over the lazy dog near the river bank at dawn"),
         (3, None), (4, ""), (5, "7 8 9"), (6, "short plain item"), (2, "the quick brown fox jumps over the lazy dog near the river bank at dawn")]


def docs_for(spark):
    pre, post = "Some ordinary text stands here first. ", " And more text follows after it, as it does."
    rows = [(1, pre + BENCH[0][1] + post), (2, pre + BENCH[1][1].upper() + post), (3, pre + BENCH[1][1] + post),
            # other names and numbers, filled consistently
            (4, pre + BENCH[0][1].replace("Alice", "Bob").replace("12", "40").replace("dollars", "euros") + post),
            # names filled inconsistently in every window that has both
            (5, "then gives Carla twin brother part of them. Alice buys 12 pears"),
            (6, pre + post), (7, None), (8, ""), (9, "12 apples"), (10, "A short plain item."), (None, pre + BENCH[1][1]), (3, "clean"),
            (11, "the quick brown fox; jumps OVER the lazy dog")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")


def test_found(spark):
    docs, bench = docs_for(spark)
    got = {r["doc_id"]: r["item_ids"] for r in T.contaminated(docs, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [2], 4: [1], 10: [6], None: [2], 11: [2]}
    left = T.decontaminate(docs, bench)
    assert left.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in left.collect()) == [5, 6, 7, 8, 9]


def test_slots(spark):
    docs = spark.createDataFrame([(1, "Tom has 3 cats and Tom likes 5 dogs"), (2, "Ann has 7 cats and Ann likes 8 dogs"),
                                  (3, "Ann has 7 cats and Sue likes 8 dogs"), (4, "Ann has 7 cats and Ann likes 7 dogs")],
                                 "doc_id long, text string")
    bench = docs.where("doc_id = 1").withColumnRenamed("doc_id", "item_id")
    assert sorted(r["doc_id"] for r in T.contaminated(docs, bench).collect()) == [1, 2]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, bench = docs_for(spark)
    want = sorted(map(str, T.contaminated(docs, bench).collect()))
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert sorted(map(str, T.contaminated(docs, bench).collect())) == want


def test_planted_benchmark_passages(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")

    def ws(t):
        return re.findall(r"\w+", (t or "").lower())
    rows = [(r["doc_id"], ws(r["text"])) for r in docs.collect()]
    grams = set()
    for r in bench.collect():
        w = ws(r["text"])
        grams |= {tuple(w[i:i + 8]) for i in range(max(1, len(w) - 7))}
    want = {d for d, w in rows if any(tuple(w[i:i + 8]) in grams for i in range(max(1, len(w) - 7)))}
    got = {r["doc_id"] for r in T.contaminated(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 0.002 * len(rows)


def test_empty_and_plan(spark, odd, empty):
    docs, bench = docs_for(spark)
    assert T.contaminated(empty, bench).count() == 0 and T.contaminated(docs, bench.limit(0)).count() == 0
    assert T.decontaminate(odd, bench).columns == odd.columns and T.decontaminate(odd, bench).count() == odd.count()
    plan = T.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_without_plain_words(spark):
    items = ["WHAT IS THE CAPITAL CITY OF FRANCE TODAY THEN", "12 34 56 78 90 kg 7 m", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan", "7 8 9"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"some words before, {t}, and some after") for i, t in enumerate(items)]
    rows += [(10, "What is the capital city of France today then"), (11, "12 34 56 78 91 kg 7 m"), (12, "7 8 and 9"),
             (13, "Bob Alice Carol Dave Frank Erin Grace Heidi Ivan")]
    got = {r["doc_id"]: r["item_ids"] for r in T.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [3], 10: [0]}


def test_conflict_voids_only_windows_around_it(spark):
    item = "Tom has 3 red apples and Tom gives 2 of them to Eve who puts 4 in a bag then Max takes 6 of those home and Tom eats 5 at once"
    other = "Ann has 7 red apples and Ann gives 8 of them to Liz who puts 9 in a bag then Ben takes 11 of those home and {} eats {} at once"
    rows = [(1, other.format("Sue", 12)),  # Tom is Ann and Sue, far apart
            (2, other.format("Ann", 7)),  # 3 and 5 are 7, far apart
            (3, "Ann has 7 red apples and Sue gives")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in T.contaminated(docs, bench).collect()) == [1, 2]
