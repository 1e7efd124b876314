"""Streams over several micro-batches: one pass with many sinks, velocity, live profiles."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.models import classifiers as CL
from riskframe.models import prepare as PP
from riskframe.operators import features as FE
from riskframe.plans import queries_stream as Q
from riskframe.plans import views as V
from riskframe.streaming import epochs as EP
from riskframe.streaming import profiles as PF
from riskframe.streaming import state as ST
from riskframe.streaming import stream as SS
from riskframe.streaming.velocity import STATE_CONF, TrailingTimes, trailing_count_stream

SCHEMA = "transaction_id long, merchant_id long, ts timestamp, Amount double, fraud_probability double, prediction int, risk_level string"
AT = dt.datetime(2024, 1, 1)


def rows_of(n, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 1, 1, 1, 2, 3]), AT + dt.timedelta(minutes=i), rng.choice([None, float("nan"), rng.random() * 100]),
             p := rng.random(), int(p > 0.5), "High" if p > 0.8 else "Low") for i in range(n)]


def files(spark, folder, rows, per_file, schema=SCHEMA):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], schema).coalesce(1).write.parquet(f"{folder}/f{i:05d}")
    return SS.file_stream(spark, f"{folder}/*", T._parse_datatype_string(schema), max_files_per_trigger=1)


def run(s, base, **kw):
    q, log = EP.start_scoring(s, base, **kw)
    q.awaitTermination()
    return log


def test_one_pass_equals_the_single_operators(spark, tmp_path):
    rows = rows_of(600)
    s = files(spark, tmp_path / "in", rows, 100)
    # small enough that buffers are folded on the way
    log = run(s, str(tmp_path / "out"), buffer_size=50, last=200, fold_every=2)
    assert log.newest()[0] == 5 and log.read("predictions").count() == 600
    m = log.read_newest("metrics").first()
    known = [r[3] for r in rows if r[3] is not None and r[3] == r[3]]
    assert (m["total_processed"], m["fraud_detected"]) == (600, sum(r[5] for r in rows))
    assert m["avg_amount"] == pytest.approx(sum(known) / len(known), rel=1e-12)
    buffer = {r["merchant_id"]: r for r in EP.read_buffer(spark, log.base).collect()}
    want = {r["merchant_id"]: r for r in SS.run_to_table(ST.last_n_buffer(s, n=50), "b", mode="update", keys=["merchant_id"]).collect()}
    assert buffer.keys() == want.keys() and len(want) == 4
    for k, w in want.items():
        assert (buffer[k]["seen"], buffer[k]["buffered"]) == (w["seen"], w["buffered"])
        for c in ("fraud_rate", "avg_probability", "first_window_rate", "last_window_rate"):
            assert buffer[k][c] == pytest.approx(w[c])
    assert {r["transaction_id"] for r in spark.read.parquet(log.folder("recent", 5)).collect()} == set(range(400, 600))
    stats = log.read("updates").where("_epoch = 3").first()["message"]
    assert f'"total_transactions":400,"fraud_count":{sum(r[5] for r in rows[:400])}' in stats and '"transaction_id":399' in stats


@pytest.mark.parametrize("crash_after", ["predictions", "recent", "seen"])
def test_a_crash_between_sinks_shows_nothing_of_the_epoch(spark, tmp_path, crash_after):
    s = files(spark, tmp_path / "in", rows_of(300), 100)
    base, seen = str(tmp_path / "out"), []

    def between(sink):
        seen.append(sink)
        if sink == crash_after and seen.count(sink) == 2:
            raise RuntimeError("crash")

    q, log = EP.start_scoring(s, base, between=between)
    with pytest.raises(Exception, match="crash"):
        q.awaitTermination()
    # the first epoch, whole, in every sink
    assert log.newest()[0] == 0 and log.read("predictions").count() == 100 == log.read_newest("metrics").first()["total_processed"]
    assert EP.read_buffer(spark, base).agg(F.sum("seen")).first()[0] == 100
    log = run(s, base)  # the same checkpoint: the epoch again, then the rest
    assert log.newest()[0] == 2 and log.read("predictions").count() == 300 == log.read_newest("metrics").first()["total_processed"]
    assert log.read("predictions").select("transaction_id").distinct().count() == 300
    assert EP.read_buffer(spark, base).agg(F.sum("seen")).first()[0] == 300


def test_an_epoch_keeps_no_more_than_the_ones_before(spark, tmp_path):
    s = files(spark, tmp_path / "in", rows_of(120), 10)
    log = run(s, str(tmp_path / "out"), buffer_key=None, last=30)
    assert log.newest()[0] == 11 and len(log.committed()) <= 3
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "out" / "recent").iterdir() if p.is_dir()} <= {10, 11}


def test_complete_mode_table_is_never_half_written(spark, tmp_path):
    s = files(spark, tmp_path / "in", rows_of(200), 100)
    out = str(tmp_path / "m")
    q, _ = SS.start(SS.running_metrics(s), "m", path=out, mode="complete", foreach_batch=SS.overwrite_batch)
    q.awaitTermination()
    assert SS.read_table(spark, out).first()["total_processed"] == 200
    # an epoch that crashed while writing stays unseen
    spark.range(3).write.parquet(EP.EpochLog(spark, out).folder("table", 7))
    assert SS.read_table(spark, out).first()["total_processed"] == 200


def test_velocity_with_ties_gaps_and_null_times(spark, tmp_path):
    rng = random.Random(1)
    schema, rows, t = "transaction_id long, customer_id long, ts timestamp", [], AT
    for i in range(600):
        t += dt.timedelta(seconds=rng.choice([0, 30, 600, 3600, 40_000 if i % 60 == 0 else 0]))
        rows.append((i, rng.choice([None, 1, 1, 2, 3]), None if i % 97 == 0 else t))
    # ties stay within one micro-batch
    cuts = [0] + [i for i in range(100, 600) if i % 97 > 1 and rows[i][2] > rows[i - 1][2]][::80] + [600]
    for a, b in zip(cuts, cuts[1:]):
        part = rows[a:b]
        rng.shuffle(part)  # any order within a micro-batch
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{a:05d}")
    s = SS.file_stream(spark, f"{tmp_path}/in/*", T._parse_datatype_string(schema), max_files_per_trigger=1)
    out = SS.run_to_table(trailing_count_stream(s, name="n"), "v", conf=STATE_CONF).collect()
    got = {r["transaction_id"]: r["n"] for r in out}
    assert {r["transaction_id"]: (r["customer_id"], r["ts"]) for r in out} == {i: (c, at) for i, c, at in rows}
    day = dt.timedelta(days=1)
    for i, c, at in rows:
        if at is not None:
            assert got[i] == sum(1 for _, d, x in rows if d == c and x is not None and at - day <= x <= at), i
    assert len(got) == 600 and len(cuts) > 4


class FakeState:
    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, v):
        self.calls += 1
        self.value = v

    def clear(self):
        self.calls += 1
        self.value = None

    def getValueState(self, name, schema):
        return self if name == "held" else FakeState()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class FakeTime:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_velocity_calls_on_the_store_do_not_grow_with_a_keys_times():
    state, hour = FakeState(), 3_600_000
    p = TrailingTimes("ts", 86400, "n")
    p.init(state)
    for k in range(3):
        before = state.calls
        ts = pd.Timestamp(AT) + pd.to_timedelta(np.arange(k * 400, k * 400 + 400) * 9, "min")
        out, = p.handleInputRows(("=1",), iter([pd.DataFrame({"ts": ts})]), FakeTime(0))
        assert out["n"].tolist() == [min(i + 1, 161) for i in range(k * 400, k * 400 + 400)]
        assert state.calls - before <= 3
    # the timer of the first rows finds newer ones and is set on; the next one clears the key
    assert len(state.timers) == 1
    list(p.handleExpiredTimer(("=1",), FakeTime(state.timers[0] + hour), FakeTime(state.timers[0])))
    assert len(state.timers) == 2 and state.value is not None and state.timers[1] == int(ts[-1].timestamp() * 1000) + 24 * hour + 1
    list(p.handleExpiredTimer(("=1",), FakeTime(state.timers[1] + hour), FakeTime(state.timers[1])))
    assert len(state.timers) == 2 and state.value is None


def test_velocity_state_expires(spark, tmp_path):
    """A silent key's ring is cleared by its timer, and it starts afresh."""
    schema = "transaction_id long, customer_id long, ts timestamp"
    hours = [(1, 0), (1, 1), (2, 30), (2, 60), (1, 61), (1, 61)]
    rows = [(i, c, AT + dt.timedelta(hours=h)) for i, (c, h) in enumerate(hours)]
    s = files(spark, tmp_path / "in", rows, 2, schema)
    out = str(tmp_path / "out")
    q, _ = SS.start(trailing_count_stream(s, name="n"), "v", path=out, checkpoint=str(tmp_path / "c"), conf=STATE_CONF)
    q.awaitTermination()
    assert {r["transaction_id"]: r["n"] for r in spark.read.parquet(out).collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 2, 5: 2}


def test_model_trained_on_the_trailing_count_scores_the_stream_alike(spark, sf_dir):
    hist = V.tx(spark, sf_dir)
    feats = FE.engineer_features(hist.drop("ts"))
    pm = PP.fit_preprocessor(feats, ["Amount", "tx_freq_24h", "avg_amount_per_customer"])
    lr = CL.train_logit(PP.with_weights(pm.transform(feats)), "lr", max_iter=10)
    batch = {r[0]: r[1] for r in CL.positive_probability(lr.transform(pm.transform(feats)), "lr").select("transaction_id", "p_lr").collect()}
    scorer = CL.model_scorer("lr", lr, preprocessor=pm, prepare_fn=lambda d: FE.profile_features(d, hist))
    scored = SS.score_stream(trailing_count_stream(Q._feed(spark, sf_dir)).drop("ts"), scorer, "lr").select("transaction_id", "fraud_probability")
    live = {r[0]: r[1] for r in SS.run_to_table(scored, "lr", conf=STATE_CONF).collect()}
    assert live.keys() == batch.keys() and max(abs(live[k] - batch[k]) for k in live) < 1e-12


PROFILE = "transaction_id long, customer_id long, Amount double, Class int"


def test_profiles_by_epoch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 1, 2, 3, 100 + i % 40]), rng.choice([None, float("nan"), 1.5, 2e9]), rng.choice([None, 0, 1])) for i in range(300)]
    s = files(spark, tmp_path / "in", rows, 50, PROFILE)
    base = str(tmp_path / "out")
    store = PF.ProfileStore(spark, f"{base}/store", buckets=3, merge_at=0.3)
    q, out = SS.start(s, "p", path=f"{base}/rows", foreach_batch=PF.enrich_and_fold(store, f"{base}/rows", ["transaction_id"]))
    q.awaitTermination()
    got = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    n, amounts, labels = Counter(), defaultdict(list), defaultdict(list)
    for lo in range(0, 300, 50):
        for i, c, _, _ in rows[lo:lo + 50]:
            r = got[i]
            assert r["profile_tx_count"] == (n[c] if c is not None else 0)
            assert r["profile_avg_amount"] == (pytest.approx(sum(amounts[c]) / len(amounts[c])) if c is not None and amounts[c] else None)
            assert r["profile_rate"] == (pytest.approx(sum(labels[c]) / len(labels[c])) if c is not None and labels[c] else None)
        for _, c, x, y in rows[lo:lo + 50]:
            n[c] += 1
            amounts[c] += [x] if x is not None and x == x else []
            labels[c] += [y] if y is not None else []


def test_profile_lookup_aggregates_nothing_and_moves_no_base(spark, tmp_path):
    store = PF.ProfileStore(spark, str(tmp_path / "s"), buckets=4, merge_at=0.5)
    rows = spark.range(2000).select(F.col("id").alias("transaction_id"), (F.col("id") % 500).alias("customer_id"), F.lit(1.0).alias("Amount"),
                                    F.lit(0).alias("Class"))
    for e in range(3):
        store.fold(rows if e == 0 else rows.where(f"customer_id < {20 * e}"), e)
    store.fold(rows, 2)  # a retried epoch adds nothing
    assert store.log.newest()[1]["base"] == 0 and store.log.newest()[1]["recent"] == 2
    want = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        look = store.lookup(rows.where("transaction_id < 500"))
        plan = look._jdf.queryExecution().executedPlan().toString()
        got = {r["customer_id"]: r["profile_tx_count"] for r in look.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Aggregate" not in plan and "Bucketed: true" in plan
    # the rows themselves and the recent keys move, the base does not
    assert plan.count("Exchange hashpartitioning") == 2
    assert got == {k: 4 + 4 * (k < 20) + 4 * (k < 40) for k in range(500)}
    spark.sql(f"DROP TABLE {store._table(0)}")  # as another session finds it
    assert PF.ProfileStore(spark, str(tmp_path / "s"), buckets=4).lookup(rows.limit(10)).count() == 10
