"""Plan properties the scale design relies on (checked on small data, they
are properties of the plan, not of the size)."""

from pyspark.sql import functions as F

from riskframe.operators import features as FE
from riskframe.operators import report as R
from riskframe.plans import views as V
from riskframe.streaming import state as ST
from riskframe.streaming import stream as SS


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_dimension_join_is_removed(spark, sf_dir):
    df = R.merchant_risk(V.scored(spark, sf_dir))
    plan = _optimized(df)
    assert "Join" not in plan
    assert "customer" not in plan and "nation" not in plan


def test_used_dimension_join_is_kept(spark, sf_dir):
    df = V.tx(spark, sf_dir).groupBy("card_type").count()
    assert "Join" in _optimized(df)


def test_scan_is_pruned_and_filter_pushed(spark, sf_dir):
    df = V.tx(spark, sf_dir).filter(F.col("Amount") > 100).select("transaction_id", "Amount")
    phys = _physical(df)
    assert "GreaterThan(value,100.0)" in phys
    scan = [ln for ln in phys.splitlines() if "FileScan parquet" in ln and "events" in ln]
    assert scan and "props" not in scan[0] and "event_type" not in scan[0]


def test_partial_aggregation_before_shuffle(spark, sf_dir):
    phys = _physical(FE.customer_profile(V.tx(spark, sf_dir)))
    assert phys.count("HashAggregate") >= 2 and "partial_" in phys


def test_trailing_count_holds_no_key_in_one_task(spark, sf_dir):
    t = V.tx(spark, sf_dir).select("transaction_id", "customer_id", "Time")
    phys = _physical(FE.trailing_count(t))
    # the only windows are over the ranges, and over the table of one row per range
    assert "windowspecdefinition(customer_id" not in phys and "windowspecdefinition(_k" not in phys


def test_leaderboard_scans_the_rows_once(spark, sf_dir):
    from riskframe.operators import evaluate as EV

    s = V.scored(spark, sf_dir)
    long = EV.long_scores(s, {"a": "fraud_probability", "b": F.col("Amount") / 500.0})
    assert _physical(long).count("FileScan") == _physical(s.select("fraud_probability", "Amount", "Class")).count("FileScan")


def test_top_per_group_is_limited_map_side(spark, sf_dir):
    s = V.scored(spark, sf_dir).select("region", "transaction_id", "fraud_probability")
    phys = _physical(R.top_per_group(s, "region", "fraud_probability", 3, "transaction_id"))
    assert "WindowGroupLimit" in phys and "Partial" in phys


def test_stream_state_across_micro_batches_equals_batch(spark, sf_dir):
    from riskframe.session import scratch_path

    land = scratch_path(spark, "test-landing")
    V.table(spark, sf_dir, "events").repartitionByRange(6, "event_id").write.parquet(land)
    s = SS.score_stream(SS.tx_stream(spark, sf_dir, max_files_per_trigger=1, events_dir=land, events_glob="*.parquet"))
    got = SS.run_to_table(ST.last_n_buffer(s, "merchant_id", n=7, n_windows=2), "t6test", mode="update",
                          keys=["merchant_id"]).toPandas().set_index("merchant_id").sort_index()
    b = V.scored(spark, sf_dir).withColumn("prediction", (F.col("fraud_probability") >= 0.5).cast("int")).toPandas()
    for m, g in b.groupby("merchant_id"):
        last = g.sort_values("transaction_id").tail(7)
        assert got.loc[m, "seen"] == len(g)
        assert got.loc[m, "buffered"] == len(last)
        assert abs(got.loc[m, "fraud_rate"] - last["prediction"].mean()) < 1e-12
