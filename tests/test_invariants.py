"""Invariants of the distributed building blocks against NumPy / Spark ML."""

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.models import prepare as PP
from riskframe.operators import evaluate as EV
from riskframe.operators import prefix, stats
from riskframe.plans import views as V


def _frame(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 5, n), "x": rng.integers(0, 50, n).astype(float)})
    pdf.loc[pdf.index % 3 == 0, "g"] = 0  # one hot group: a third of the rows and more
    return spark.createDataFrame(pdf), pdf


def test_running_sum_matches_numpy(spark):
    df, pdf = _frame(spark)
    out = prefix.running(df, ["id"], {"cs": "x"}, partitions=7).orderBy("id").toPandas()
    assert np.allclose(out["cs"], pdf.sort_values("id")["x"].cumsum())


def test_running_min_and_by_group(spark):
    df, pdf = _frame(spark)
    out = prefix.running(df, ["id"], {"cm": F.col("x") - 25}, ops={"cm": "min"}, partitions=5).orderBy("id").toPandas()
    assert np.allclose(out["cm"], (pdf["x"] - 25).cummin())
    g = prefix.running(df, ["id"], {"cs": "x"}, by=["g"], partitions=6).toPandas().sort_values("id")
    exp = pdf.sort_values("id").groupby("g")["x"].cumsum()
    assert np.allclose(g.set_index("id")["cs"].sort_index(), exp.sort_index().to_numpy())


def test_global_rank_is_row_number(spark):
    df, pdf = _frame(spark)
    r = prefix.global_rank(df, [F.col("x").desc(), "id"], partitions=4).toPandas()
    exp = pdf.sort_values(["x", "id"], ascending=[False, True]).reset_index(drop=True)
    exp["rank"] = np.arange(1, len(exp) + 1)
    m = r.merge(exp, on="id")
    assert (m["rank_x"] == m["rank_y"]).all()


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _frame(spark)
    q = stats.exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.95], tiebreak="id").first()
    for k, p in zip(q, [0.1, 0.25, 0.5, 0.95]):
        assert abs(k - np.percentile(pdf["x"], p * 100)) < 1e-9
    by = stats.exact_quantiles(df, "x", [0.5], by=["g"], tiebreak="id").toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        assert abs(by.loc[g, "q_50"] - np.percentile(sub["x"], 50)) < 1e-9


def test_auc_matches_spark_evaluator_and_is_rank_invariant(spark, sf_dir):
    s = V.scored(spark, sf_dir)
    ours = EV.auc(EV.long_scores(s, {"m": "fraud_probability"})).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="fraud_probability", labelCol="Class", numBins=0)
    theirs = ev.evaluate(s.withColumn("Class", F.col("Class").cast("double")))
    assert abs(ours - theirs) < 1e-12
    mono = EV.auc(EV.long_scores(s, {"m": F.exp(F.col("fraud_probability") * 3)})).first()["auc"]
    assert abs(ours - mono) < 1e-12


def test_split_disjoint_complete_and_stratified(spark, sf_dir):
    t = V.tx(spark, sf_dir)
    sp = PP.stratified_split(t).cache()
    assert sp.count() == t.count()
    assert sp.select("transaction_id").distinct().count() == t.count()
    for cls, n in t.groupBy("Class").count().collect():
        n_test = sp.filter((F.col("Class") == cls) & (F.col("split") == "test")).count()
        assert n_test == int(np.ceil(0.2 * n))


def test_prefix_handles_repeated_keys_like_a_window(spark):
    df, pdf = _frame(spark)
    w = Window.orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("e", F.sum("x").over(w))
    got = prefix.running(df, ["x", "id"], {"cs": "x"}, partitions=9)
    j = got.join(exp, "id").filter(F.abs(F.col("cs") - F.col("e")) > 1e-9)
    assert j.count() == 0
