import numpy as np

from riskframe.llm import language_id as L
from riskframe.llm.common import crc_bucket


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("h", crc_bucket("doc_id", 3) == 1)
    model = L.fit(docs.where("not h"))
    got = L.predict(docs.where("h"), model).select("lang", "lang_pred", "score").collect()
    right = [r["lang"] == r["lang_pred"] for r in got]
    assert len(right) > 200 and np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    # scores are probabilities: about as many are right as they say
    assert abs(np.mean([r["score"] for r in got]) - np.mean(right)) < 0.03
    assert (model.weights == 0).mean() > 0.5


def test_odd_rows(odd, empty, docs):
    model = L.fit(docs)
    out = L.predict(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        bare = r["text"] is None or not any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == bare and (not bare or r["score"] == 0.0)
    assert L.predict(empty, model).count() == 0
    none = L.fit(empty)
    assert none.labels == [] and {r["lang_pred"] for r in L.predict(odd, none).collect()} == {"und"}


def test_slots_stay_within_a_text():
    a, b = "abc", "zyx wv"
    both = list(L.slots_by_text([a, b]))
    assert all(np.array_equal(np.sort(x[x != L.NONE]), np.sort(y[y != L.NONE]))
               for x, y in zip(both, [next(L.slots_by_text([a])), next(L.slots_by_text([b]))], strict=True))
    # 1-, 2- and 3-grams of "abc" between two marks
    assert (both[0] != L.NONE).sum() == 3 + 4 + 3
