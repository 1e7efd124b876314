"""Nulls, repeats, fine-grained values, restarts and other awkward input."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from riskframe.models import classifiers as CL
from riskframe.models import iforest as IF
from riskframe.models import prepare as PP
from riskframe.models import recon as RC
from riskframe.operators import drift as DR
from riskframe.operators import features as FE
from riskframe.operators import prefix
from riskframe.operators import profile as PR
from riskframe.operators import report as R
from riskframe.plans import queries_ml as QM
from riskframe.sources import records as RE
from riskframe.sources import tables as TB
from riskframe.streaming import state as ST
from riskframe.streaming import stream as SS
from tests.oracle_check import duck


def test_trailing_count_null_times_and_repeated_ids(spark):
    rows = [(1, 7, None), (1, 7, None), (2, 7, 10.0), (2, 7, 10.0), (3, 7, 86410.0), (4, 7, 86411.0), (5, None, 5.0), (6, None, 6.0)]
    df = spark.createDataFrame(rows, "transaction_id long, customer_id long, Time double")
    got = sorted(((r["customer_id"] or 0), (r["Time"] or -1), r["tx_freq_24h"]) for r in FE.trailing_count(df).collect())
    assert got == sorted([(7, -1, 2), (7, -1, 2), (7, 10.0, 2), (7, 10.0, 2), (7, 86410.0, 3), (7, 86411.0, 2), (0, 5.0, 1), (0, 6.0, 2)])


def test_small_amounts_keep_their_digits(spark):
    df = spark.createDataFrame([(1, 1, 0.004), (2, 1, 0.004), (3, 1, 1e-9)], "transaction_id long, customer_id long, Amount double")
    assert FE.customer_profile(df).first()["avg_amount_per_customer"] == pytest.approx((0.008 + 1e-9) / 3, rel=1e-9)
    s = df.withColumn("fraud_probability", F.col("Amount") / 1e6).withColumn("Class", F.lit(0))
    assert R.risk_by(s, "customer_id").first()["avg_risk_score"] == pytest.approx((0.008 + 1e-9) / 3e6, rel=1e-6)


def test_range_count_follows_size_only(spark, sf_dir):
    one = spark.range(2)
    assert prefix.auto_partitions(one) == 1
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert prefix.auto_partitions(ev.join(ev, "event_id")) == 1


def test_what_a_task_holds_does_not_grow_with_a_range(spark):
    """A range that comes out long is cut into blocks, and running sums, decayed sums and ranks carry over their ends."""
    n = 300_000
    df = spark.range(n).select("id", ((F.col("id") * 7919) % 101 - 50).cast("double").alias("v"))
    r = prefix.Ranges(df, ["id"], 1)
    assert r.rows.groupBy("_pid").count().agg(F.max("count")).first()[0] <= 1 << 17
    v = ((np.arange(n) * 7919) % 101 - 50).astype(float)
    got = r.running(r.rows, {"s": "v", "low": "v"}, ops={"low": "min"}).orderBy("id").toPandas()
    assert (got["s"].to_numpy() == np.cumsum(v)).all() and (got["low"].to_numpy() == np.minimum.accumulate(v)).all()
    decayed = prefix.decayed_running(df, ["id"], {"m": "v"}, 0.9999, partitions=1).orderBy("id").toPandas()["m"].to_numpy()
    assert np.allclose(decayed, prefix.decayed_sums(v, 0.9999), atol=1e-6)
    assert prefix.global_rank(df, ["id"], partitions=2).where("rank <> id + 1").count() == 0


def test_blocks_are_not_coalesced_into_one_task(spark, monkeypatch):
    """Adaptive execution coalesces shuffles to a size at which one task would sort all the blocks of narrow rows."""
    monkeypatch.setattr(prefix, "BLOCK_BITS", 14)
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 1 << 14)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.range(300_000).select("id", (F.col("id") % 2).alias("g"), F.lit(1.0).alias("v"))
        for by in (None, ["g"]):
            out = prefix.running(df, ["id"], {"s": "v"}, partitions=2, by=by)
            held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(held) == 300_000 and max(held) <= 6 << 14
    finally:
        spark.conf.set(key, before)


def test_group_sums_carry_over_blocks(spark, monkeypatch):
    """A group may fill several blocks, share one with many others, or begin with one."""
    monkeypatch.setattr(prefix, "BLOCK_BITS", 2)
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 4)
    rows = [(i, None if i % 11 == 0 else "a" if i % 3 else "b" if i % 2 else f"c{i}", i % 7 - 3.0) for i in range(300)]
    got = prefix.running(spark.createDataFrame(rows, "id long, g string, v double"), ["id"], {"s": "v"}, by=["g"], partitions=3)
    upto: dict = {}
    for r in sorted(got.collect()):
        upto[r["g"]] = upto.get(r["g"], 0.0) + r["v"]
        assert r["s"] == upto[r["g"]]


def test_learning_is_spread_over_the_cores(spark, tmp_path):
    """One row group of several MiB is one task's; the rows that models learn from are dealt to all."""
    n = 400_000
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"),
                          (F.col("id") % 10).cast("int").alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for side in QM._split(spark, str(tmp_path)):
        sizes = [r["count"] for r in side.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.2 * min(sizes)


def test_detector_work_is_linear_in_the_values(monkeypatch):
    """A detection starts afresh; what follows it isn't folded anew from every detection before."""
    work = []
    plain = ST.decayed_sums
    monkeypatch.setattr(ST, "decayed_sums", lambda v, *a: work.append(len(v)) or plain(v, *a))
    x = (np.arange(60_000) // 40 % 2).astype(float)
    for alpha in (1.0, 0.99):
        work.clear()
        found = ST.PageHinkleyDetector(threshold=0.5, min_instances=5, alpha=alpha).update_many(x)
        assert len(found) > 1000 and sum(work) < 40 * len(x)
        one, many = ST.PageHinkleyDetector(threshold=0.5, min_instances=5, alpha=alpha), []
        for i in range(0, 8000, 97):
            many += one.update_many(x[i:min(8000, i + 97)])
        assert many == [f for f in found if f <= 8000]


def test_box_and_balance_keep_null_groups(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 7.0), (3, 0, 1.0), (4, 1, 2.0)], "transaction_id long, Class int, Amount double")
    got = {r["Class"]: r["median"] for r in PR.box_stats(df, "Amount", "Class").collect()}
    assert got == {None: 6.0, 0: 1.0, 1: 2.0}
    assert {r["class_name"]: r["n"] for r in PR.class_balance(df).collect()} == {"unknown": 2, "normal": 1, "fraud": 1}


def test_split_treats_null_labels_as_a_class(spark):
    df = spark.createDataFrame([(i, None if i < 50 else i % 2) for i in range(150)], "transaction_id long, Class int")
    n = {r["Class"]: r["n"] for r in PP.stratified_split(df).where("split = 'test'").groupBy("Class").agg(F.count("*").alias("n")).collect()}
    assert n == {None: 10, 0: 10, 1: 10}


def test_kpis_invent_nothing(spark):
    k = R.kpis(spark.createDataFrame([(1,), (0,)], "Class int")).first()
    assert k["precision"] is None and k["recall"] is None and k["fraud_rate_pct"] == 50.0


def test_json_flags_what_does_not_parse(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    rows = [(1, json.dumps({"b": 2})), (2, "{}"), (3, "not json"), (4, None), (5, json.dumps({"a": "x"})), (6, json.dumps({"a": 1, "b": 2}))]
    got = {r["i"]: r["_corrupt"] for r in RE.parse_json(spark.createDataFrame(rows, "i int, t string"), "t", schema, keep=["i"]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_stored_table_errors_are_not_absence(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    assert TB.read_scored(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):
        TB.read_scored(spark, str(tmp_path / "bad"))


def test_reconstruction_is_centred_and_keeps_null_rows(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(0, 5, 400)
    x = np.stack([100 + t + rng.normal(0, 0.2, 400), 105 - t + rng.normal(0, 0.2, 400)], 1)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    m = RC.fit(df, ["a", "b"], k=1)
    assert m.error(df).agg(F.avg("recon_error")).first()[0] == pytest.approx(0.02, abs=0.02)
    holes = spark.createDataFrame([(None, 105.0), (100.0, None)], "a double, b double")
    assert m.probability(m.error(holes)).where("p_recon between 0 and 1").count() == 2


def test_every_tree_has_exactly_its_rows(spark):
    rng = np.random.default_rng(1)
    for n, psi in ((3, 3), (700, 64), (5000, 64)):
        df = spark.createDataFrame(pd.DataFrame({"transaction_id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)}))
        m = IF.fit(df, ["a", "b"], trees=40, max_samples=64)
        root = m.nodes[m.nodes["node"] == 0]
        assert len(root) == 40 and m.max_samples == psi and (root["size"] == psi).all()


def test_rows_without_a_score_are_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0), (None, 1.0, 3.0), (None, 1.0, -1.0)], "transaction_id long, Time double, Amount double")
    score = lambda d: d.withColumn("p_m", F.when(F.col("Amount") == 2.0, F.lit(None)).otherwise(F.lit(0.9)))
    for one_pass in (True, False):
        out = CL.score_batch(df, score, name="m", required=("Time", "Amount"), one_pass=one_pass).collect()
        assert sorted((r["risk_level"], r["error"] or "") for r in out) == [
            ("Error", "negative:Amount"), ("Error", "no score"), ("High", ""), ("High", "")]
        ids = [r["transaction_id"] for r in out]
        assert len(set(ids)) == 4 and sum(i.startswith("tx_") for i in ids) == 2
        assert all(r["prediction_time"] for r in out)
    wide = df.withColumn("V1", F.lit("x"))
    reasons = CL.score_batch(wide, score, name="m").first()["error"]
    assert "non_numeric:V1" in reasons and "missing:V28" in reasons


def test_stream_scores_every_model_by_its_own_threshold(spark):
    df = spark.createDataFrame([(1, 0.6, 0.2), (2, None, 0.45), (3, None, None)], "transaction_id long, a double, b double")
    out = SS.score_stream_models(df, {"gbt": lambda d: d.withColumn("p_gbt", F.col("a")), "logit": lambda d: d.withColumn("p_logit", F.col("b"))},
                                 {"gbt": 0.7, "logit": 0.4}, preference=("gbt", "logit")).orderBy("transaction_id").collect()
    assert [(r["model_used"], r["prediction"], r["risk_level"]) for r in out] == [("gbt", 0, "Medium"), ("logit", 1, "Low"), ("none", 0, "Error")]
    assert out[0]["all_predictions"] == {"gbt": 0, "logit": 0}


SCHEMA = "transaction_id long, merchant_id long, ts timestamp, Amount double, fraud_probability double, prediction int"


def _files(spark, folder, rows, per_file):
    at = dt.datetime(2024, 1, 1)
    for i in range(0, len(rows), per_file):
        spark.createDataFrame([(a, m, at, x, p, y) for a, m, x, p, y in rows[i:i + per_file]], SCHEMA).coalesce(1).write.parquet(
            f"{folder}/f{i:05d}")
    return SS.file_stream(spark, f"{folder}/*", T._parse_datatype_string(SCHEMA), max_files_per_trigger=1)


def test_null_keys_and_null_values_on_the_stream(spark, tmp_path):
    rows = [(1, None, 5.0, 0.9, 1), (2, None, None, None, None), (3, 7, 10.0, 0.1, 0), (4, 7, None, 0.2, 0), (5, 7, 20.0, 0.3, 1), (6, 7, 1.0, 0.3, 1)]
    s = _files(spark, tmp_path / "a", rows, 2)
    got = {r["merchant_id"]: r for r in SS.run_to_table(ST.last_n_buffer(s, n=3), "b", mode="update", keys=["merchant_id"]).collect()}
    assert got[None]["seen"] == 2 and got[None]["fraud_rate"] == 1.0 and got[7]["buffered"] == 3 and got[7]["seen"] == 4
    live = {r["transaction_id"]: r for r in SS.run_to_table(SS.live_profiles(s, key="merchant_id"), "l").collect()}
    assert live[5]["avg_amount_per_customer"] == 10.0 and live[5]["profile_tx_count"] == 2 and live[6]["avg_amount_per_customer"] == 15.0
    det = {r["merchant_id"]: r["n"] for r in SS.run_to_table(ST.fold_detector(s, "merchant_id", "fraud_probability"), "d", mode="update",
                                                             keys=["merchant_id"]).collect()}
    assert det == {None: 1, 7: 4}


def test_detector_order_holds_over_arrow_batches(spark, tmp_path):
    rows = [(i, 1, 1.0, float(i >= 50), 0) for i in reversed(range(100))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10)
    try:
        make = lambda: ST.PageHinkleyDetector(threshold=5.0, min_instances=10, alpha=1.0)
        t = SS.run_to_table(ST.fold_detector(_files(spark, tmp_path / "a", rows, 100), "merchant_id", "fraud_probability", factory=make), "o",
                            mode="update", keys=["merchant_id"]).first()
    finally:
        spark.conf.unset(key)
    assert t["first_at"] == make().update_many((np.arange(100) >= 50).astype(float))[0]


def test_adwin_state_survives_any_cut():
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, 1700), rng.normal(3, 1, 900)]
    whole = ST.AdwinDetector().update_many(x)
    d, found = ST.AdwinDetector(), []
    for part in np.array_split(x, 53):
        again = ST.AdwinDetector()
        again.from_numbers(d.numbers())
        found += again.update_many(part)
        d = again
    assert found == whole and whole and 1700 < whole[0] < 1800


def test_a_stopped_stream_resumes(spark, tmp_path):
    rows = [(i, i % 3, float(i), 0.5, i % 2) for i in range(30)]
    base, src = str(tmp_path / "base"), tmp_path / "in"

    def run():
        s = SS.file_stream(spark, f"{src}/*", T._parse_datatype_string(SCHEMA))
        qp, pp = SS.start(s.select("transaction_id", "prediction"), "p", path=f"{base}/p", checkpoint=f"{base}/cp")
        qb, pb = SS.start(ST.last_n_buffer(s, n=5), "b", path=f"{base}/b", checkpoint=f"{base}/cb", mode="update", foreach_batch=SS.append_versioned)
        for q in (qp, qb):
            q.awaitTermination()
        return pp, pb

    _files(spark, src, rows[:12], 6)
    run()
    for i in range(12, 30, 6):
        spark.createDataFrame(
            [(a, m, dt.datetime(2024, 1, 1), x, p, y) for a, m, x, p, y in rows[i:i + 6]], SCHEMA).coalesce(1).write.parquet(f"{src}/g{i}")
    pp, pb = run()
    assert sorted(r[0] for r in spark.read.parquet(pp).select("transaction_id").collect()) == list(range(30))  # nothing twice
    seen = {r["merchant_id"]: r["seen"] for r in SS.latest_per_key(spark, pb, ["merchant_id"]).collect()}
    assert seen == {0: 10, 1: 10, 2: 10}  # with the state of the first run
    SS.compact(spark, pb, ["merchant_id"])
    assert {r["merchant_id"]: r["seen"] for r in SS.latest_per_key(spark, pb, ["merchant_id"]).collect()} == seen


def test_drift_alerts_on_the_stream(spark, tmp_path):
    rows = [(i, 1, 1.0, 0.1 if i < 900 else 0.9, int(i >= 900)) for i in range(1800)]
    s = _files(spark, tmp_path / "a", rows, 600)
    base = str(tmp_path / "out")
    q, _ = SS.start(s, "drift", checkpoint=f"{base}/c", foreach_batch=SS.drift_alert_sink(f"{base}/rows", f"{base}/alerts"))
    q.awaitTermination()
    t = spark.read.parquet(f"{base}/alerts")
    assert {(r["_epoch"], r["type"]) for r in t.collect()} == {(1, "Fraud Rate Drift"), (1, "Probability Drift"),
                                                               (2, "Fraud Rate Drift"), (2, "Probability Drift")}


def test_adwin_uses_no_later_data(spark):
    rows = [(i, float(i * 60), 10.0 + i % 7 if i < 3000 else 200.0 + i % 7) for i in range(6000)]
    df = spark.createDataFrame(rows, "transaction_id long, Time double, Amount double")
    early = DR.adwin_alert(df.where("transaction_id < 3400")).first()
    late = DR.adwin_alert(df).first()
    assert early == late and early["old_value"] < early["new_value"]


def test_scratch_needs_a_shared_folder_off_local(spark, monkeypatch):
    from riskframe import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n[0] in "DX" or n.startswith(("P3", "M13", "T", "C"))))
def test_oracles_are_not_empty(sf_dir, name):
    rows = duck(sf_dir).sql(E.oracle_sql()[name]).fetchall()
    assert rows
    if name == "X2_stream_detector":
        assert sum(bool(x) for r in rows for x in r if isinstance(x, bool)) > 0
    if name in ("P3_violation_summary", "M13_M15_score_batch"):
        assert any("negative:Amount" in map(str, r) for r in rows)
