"""Composed user-level jobs (C1-C4, C7). Each returns DataFrames (or fitted
models plus DataFrames); nothing is collected except fitted parameters of
bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.models import classifiers as CL
from riskframe.models import hybrid as HY
from riskframe.models import iforest as IF
from riskframe.models import prepare as PP
from riskframe.models import recon as RC
from riskframe.models import registry as RG
from riskframe.operators import drift as DR
from riskframe.operators import evaluate as EV
from riskframe.operators import features as FE
from riskframe.operators import profile as PR
from riskframe.operators import report as R
from riskframe.operators import validate as VA
from riskframe.operators import windows as WN


def profile(df: DataFrame, label: str = "Class", numeric: list[str] | None = None) -> dict[str, DataFrame]:
    """Nulls, summary, class counts and balance, histograms (Amount, Time,
    V1 where present), Amount box per class, correlation of the numeric columns."""
    numeric = numeric or VA.numeric_columns(df, exclude=("transaction_id", "customer_id", "merchant_id"))
    out = {"nulls": PR.null_profile(df, only_positive=False), "summary": PR.dataset_summary(df, label),
           "class_counts": PR.value_counts(df, label), "class_balance": PR.class_balance(df, label),
           "amount_hist": PR.histogram(df, "Amount"), "time_hist": PR.histogram(df, "Time"),
           "amount_box": PR.box_stats(df, "Amount", label), "correlation": PR.corr_matrix(df, numeric)}
    if "V1" in df.columns:
        out["v1_hist"] = PR.histogram(df, "V1")
    return out


def characteristics(df: DataFrame) -> dict[str, DataFrame]:
    """C2 (on engineered features)."""
    return {"distinct": PR.distinct_counts(df), "group_sizes": PR.group_size_describe(df),
            "time_span": PR.time_span_days(df), "activity": R.activity_counts(df),
            "group_rates": PR.group_rate_describe(df),
            "merchant_rate_box": PR.box_stats(df, "merchant_fraud_rate", "Class")}


def score_history(df: DataFrame, scorer, name: str = "model", required=S.REQUIRED_COLUMNS, batch_size: int = 1000,
                  watch: str = "Amount") -> dict[str, DataFrame]:
    """Score all rows with error isolation (M13, M15), summarise every
    positional batch (W5, A14), roll the batches up (A15), and log the drift of
    the watched feature and of the last predictions (D1, D3, D4, D5, U1)."""
    # the id goes through the scoring, so repeated and missing ids stay one row each
    preds = CL.score_batch(df.withColumn("_id", F.col("transaction_id")), scorer, name=name, required=required, keep=("_id",))
    batches = R.batch_summary(WN.chunk_by_position(preds.select("_id", "risk_level"), batch_size, order=("_id", "risk_level")),
                              by="batch_id")
    recent = preds.select(F.col("_id").alias("transaction_id"), "fraud_probability",
                          F.coalesce(X.threshold_classify("fraud_probability", 0.5), F.lit(0)).alias("prediction"))
    alerts = R.union_all([DR.adwin_alert(df, watch).drop("cut_time", "detected_time"), DR.window_drift(DR.window_stats(recent))])
    return {"predictions": preds.drop("_id"), "batches": batches, "rollup": R.rollup_batches(batches), "alerts": alerts}


def prepare(df: DataFrame, numeric: list[str] | None = None, label: str = "Class", test_size: float = 0.2,
            seed: int = 42, engineer: bool = True, unit: str = "seconds", freq: str = "trailing"):
    """Validate, split (M4), engineer features with profiles fitted on
    the training side, fit the preprocessor on train, transform both.
    Returns ``(train, test, PipelineModel)``."""
    VA.require_columns(df, ["Time", "Amount"] if engineer else [label])
    split = PP.stratified_split(df, label, test_size, seed)
    train_raw, test_raw = split.filter("split = 'train'"), split.filter("split = 'test'")
    if engineer:
        train_raw = FE.engineer_features(train_raw, unit=unit, freq=freq, fit_df=train_raw)
        test_raw = FE.engineer_features(test_raw, unit=unit, freq=freq, fit_df=split.filter("split = 'train'"))
    numeric = numeric or VA.numeric_columns(train_raw, exclude=(label, "transaction_id", "customer_id",
                                                                 "merchant_id", *S.CATEGORICAL_COLUMNS))
    pm = PP.fit_preprocessor(train_raw, numeric)
    return pm.transform(train_raw), pm.transform(test_raw), pm


def train_all(train: DataFrame, test: DataFrame, label: str = "Class", gbt_rounds: int = 1000,
              ensemble_rounds: int = 500, forest_trees: int = 200, iforest_trees: int = 200,
              target_precision: float = 0.90, features: list[str] | None = None,
              id_col: str = "transaction_id", model_dir: str | None = None):
    """C4: class weights, boosted trees, forest, logistic, ensemble,
    isolation forest, reconstruction model, hybrid boosted trees; a
    leaderboard (E6) on the test side; with ``model_dir`` all models and the
    leaderboard are saved there (S6). Boosting stops early once a tenth of the
    training rows, held out by a hash of the id, gains nothing more. Returns
    ``(models, test_scores, leaderboard)``."""
    train = with_validation(PP.with_weights(train, label), id_col).checkpoint()
    gbt = CL.train_gbt(train, "gbt", label=label, max_iter=gbt_rounds, validation="validation")
    gbt_e = CL.train_gbt(train, "gbt_e", label=label, max_iter=ensemble_rounds, validation="validation")
    forest = CL.train_forest(train, "forest", label=label, num_trees=forest_trees)
    logit = CL.train_logit(train, "logit", label=label)
    scored = CL.apply_models(test, {"gbt": gbt, "gbt_e": gbt_e, "forest": forest, "logit": logit})
    # cut lineage (to the shared checkpoint folder): later steps take
    # scalar subqueries over this frame, which would otherwise re-embed the
    # whole scoring plan in every subquery
    scored = CL.ensemble(scored, members=("gbt_e", "forest", "logit")).checkpoint()
    models = {"gbt": gbt, "forest": forest, "logit": logit, "gbt_e": gbt_e}
    if features:
        iso = IF.fit(train, features, trees=iforest_trees, id_col=id_col)
        tr = iso.score(train).checkpoint()
        lo, hi = tr.agg(F.min("score_samples"), F.max("score_samples")).first()  # the training range, two numbers

        def anomaly(c):
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.minmax_normalise(c, lo, hi, invert=True)))

        scored = iso.score(scored).withColumn("p_iforest", anomaly("score_samples"))
        rec = RC.fit(train, features)
        scored = rec.probability(rec.error(scored)).drop("recon_error").checkpoint()
        # hybrid labels by the training cut; boosted trees with weights of the hybrid labels
        tr = tr.withColumn("p_anom", anomaly("score_samples"))
        cut = HY.anomaly_cut(tr, "p_anom", 0.95, id_col)
        tr = HY.hybrid_labels(tr, "p_anom", cut, label).drop("score_samples", "p_anom", "weight")
        tr = PP.with_weights(tr, "hybrid_label").checkpoint()
        hyb = CL.train_gbt(tr, "hybrid", label="hybrid_label", max_iter=gbt_rounds, validation="validation")
        scored = CL.apply_models(scored.drop("score_samples"), {"hybrid": hyb})
        models.update({"iforest": iso, "recon": rec, "hybrid": hyb})
    names = [c[2:] for c in scored.columns if c.startswith("p_")]
    lb = EV.leaderboard(scored, {n: f"p_{n}" for n in names}, label, target_precision)
    if model_dir:
        RG.save_models(scored.sparkSession, model_dir, models, lb)
    return models, scored, lb


def with_validation(train: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """``validation``: true for about a tenth of the rows, by a hash of the id."""
    return train.withColumn("validation", F.pmod(F.xxhash64(F.col(id_col), F.lit("validation")), F.lit(10)) == 0)


def risk_report(scored: DataFrame, leaderboard: DataFrame | None = None) -> dict[str, DataFrame]:
    """C7."""
    f = FE.time_features(scored)
    merchants = R.merchant_risk(scored)
    return {"kpis": R.kpis(scored, leaderboard), "by_hour": R.risk_by(f, "hour_of_day"),
            "by_type": R.risk_by(scored, "transaction_type"), "amount_buckets": R.amount_buckets(scored),
            "activity": R.activity_counts(f), "merchants": merchants,
            "merchant_overview": R.merchant_overview(merchants), "top_merchants": R.top_risk_merchants(merchants),
            "daily_volume": R.daily_volume(scored), "quartiles": WN.quartile_labels(scored),
            "high_risk": R.high_risk_rows(scored)}
