"""Supervised learners on Spark ML (M5-M8, M12) and the scorer interface
(X1, M13-M15).

Parameters default to the reference's settings; MLlib's boosting is
first-order with per-node column sampling, so boosted scores are not
numerically equal to the reference's library, only comparable in quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.operators import validate as VA


def _named(est, name):
    """Per-model output columns, so several models can score one frame."""
    return (est.setProbabilityCol(f"prob_{name}").setRawPredictionCol(f"raw_{name}")
            .setPredictionCol(f"pred_{name}"))


def train_gbt(train: DataFrame, name: str = "gbt", features: str = "features", label: str = "Class",
              weight: str | None = "weight", max_iter: int = 1000, max_depth: int = 6, step: float = 0.1,
              subsample: float = 0.9, feature_subset: str = "0.9", min_instances: int = 3,
              checkpoint_interval: int = 10, seed: int = 42, validation: str | None = None):
    """M5: boosted trees, up to ``max_iter`` rounds. ``validation``: a boolean
    column; boosting stops once the error on its rows no longer falls (the rows
    are not trained on). ``checkpointInterval`` cuts the lineage of the
    per-round predictions (to the shared checkpoint folder)."""
    est = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=feature_subset,
                        minInstancesPerNode=min_instances, checkpointInterval=checkpoint_interval,
                        seed=seed)
    _named(est, name)
    if weight:
        est.setWeightCol(weight)
    if validation:
        est.setValidationIndicatorCol(validation)
    return est.fit(train)


def train_forest(train: DataFrame, name: str = "forest", features: str = "features", label: str = "Class",
                 weight: str | None = "weight", num_trees: int = 200, max_depth: int = 10,
                 min_instances: int = 2, seed: int = 42):
    """M6: random forest (balanced via the weight column)."""
    est = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                 minInstancesPerNode=min_instances, seed=seed)
    _named(est, name)
    if weight:
        est.setWeightCol(weight)
    return est.fit(train)


def train_logit(train: DataFrame, name: str = "logit", features: str = "features", label: str = "Class",
                weight: str | None = "weight", max_iter: int = 1000, C: float = 1.0):
    """M7: L2 logistic regression. The reference's ``C`` maps to
    ``regParam = 1 / (C * sum of weights)``; no internal standardisation."""
    total_w = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    est = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                             regParam=1.0 / (C * float(total_w)), elasticNetParam=0.0, standardization=False)
    _named(est, name)
    if weight:
        est.setWeightCol(weight)
    return est.fit(train)


def positive_probability(df: DataFrame, name: str) -> DataFrame:
    """Probability of class 1 from a model's vector column, as ``p_<name>``,
    dropping the model's vector outputs."""
    return df.withColumn(f"p_{name}", vector_to_array(F.col(f"prob_{name}"))[1]).drop(
        f"prob_{name}", f"raw_{name}", f"pred_{name}")


def apply_models(df: DataFrame, models: dict) -> DataFrame:
    """Score one frame with several fitted models in succession (no joins):
    each adds ``p_<name>``."""
    out = df
    for name, m in models.items():
        out = positive_probability(m.transform(out), name)
    return out


def ensemble(df: DataFrame, members=("gbt", "forest", "logit"), weights=S.ENSEMBLE_WEIGHTS,
             name: str = "ensemble") -> DataFrame:
    """M8 (F7): weighted soft vote of member probabilities."""
    return df.withColumn(f"p_{name}", X.weighted_score([f"p_{m}" for m in members], weights))


# ---- scorers (X1) --------------------------------------------------------

SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_scorer(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """A scorer maps a frame to the same frame plus ``p_<name>`` (a
    probability). Wrap a fitted ML model with :func:`model_scorer`, an
    anomaly model with :func:`flag_scorer`, or any vectorised
    ``pandas_udf`` returning a double."""
    SCORERS[name] = fn


def model_scorer(name: str, model, preprocessor=None,
                 prepare_fn: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Wrap a fitted classifier. ``prepare_fn`` (e.g. feature engineering
    with stored profiles) and ``preprocessor`` (the fitted ``PipelineModel``)
    run inside the scorer, so validation (P3) sees the raw columns."""
    def score(df: DataFrame) -> DataFrame:
        d = prepare_fn(df) if prepare_fn else df
        d = preprocessor.transform(d) if preprocessor is not None else d
        return positive_probability(model.transform(d), name)
    return score


def flag_scorer(name: str, flag_fn: Callable[[DataFrame], DataFrame], flag_col: str = "anomaly_flag"):
    """Models with only a -1/1 flag: F4 maps it to 0.9 / 0.1."""
    return lambda df: flag_fn(df).withColumn(f"p_{name}", X.anomaly_flag_to_probability(flag_col))


def udf_scorer(name: str, pandas_fn, cols: list[str]):
    return lambda df: df.withColumn(f"p_{name}", pandas_fn(*[F.col(c) for c in cols]))


def score_batch(df: DataFrame, scorer: str | Callable, name: str | None = None,
                required=S.REQUIRED_COLUMNS, id_col: str = "transaction_id", one_pass: bool = True,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """M13 + M15: validate every required column (P3), score, band (F3). Invalid
    rows get probability 0.0, band ``Error`` and the reasons; so does a row that
    the model gives no score. Rows without an id are named by their place.

    One pass over the source: all rows go through the scorer, the required
    columns of invalid rows as nulls. A scorer that fails on nulls or drops rows
    needs ``one_pass=False``: then valid rows alone are scored and the others
    rejoin by a union. Columns named in ``keep`` go through to the result."""
    fn = SCORERS[scorer] if isinstance(scorer, str) else scorer
    name = name or (scorer if isinstance(scorer, str) else "model")
    p, at = F.col(f"p_{name}"), F.monotonically_increasing_id()
    v = VA.with_violations(df, required=required)
    v = v.withColumns({id_col: X.default_tx_id(id_col, at)} if id_col in df.columns else {id_col: X.default_tx_id(F.lit(None), at)})
    bad = F.size("violations") > 0
    if one_pass:
        present = [c for c in required if c in df.columns]
        rows = fn(v.withColumns({c: F.when(~bad, F.col(c)) for c in present}))
    else:
        rows = fn(v.where(~bad)).unionByName(v.where(bad), allowMissingColumns=True)
    none = p.isNull() | F.isnan(p)
    return rows.select(
        F.col(id_col).alias("transaction_id"), F.when(bad | none, F.lit(0.0)).otherwise(p).alias("fraud_probability"),
        F.when(bad, F.lit("Error")).otherwise(X.risk_band(p)).alias("risk_level"), F.lit(name).alias("model_used"),
        F.when(bad, F.array_join("violations", "; ")).when(none, F.lit("no score")).alias("error"),
        X.iso_now().alias("prediction_time"), *keep)


def multi_model(df: DataFrame, names: list[str], thresholds: dict[str, float] | None = None,
                preference=("ensemble", "gbt")) -> DataFrame:
    """Maps of per-model predictions and probabilities; the final
    score is the first available of ``preference`` (0.0 and ``none``
    otherwise). Expects ``p_<name>`` columns."""
    thresholds = thresholds or {}
    keys = F.array(*[F.lit(n) for n in names])
    probs = F.array(*[F.coalesce(F.col(f"p_{n}"), F.lit(0.0)) for n in names])
    preds = F.array(*[F.coalesce((F.col(f"p_{n}") >= F.lit(thresholds.get(n, 0.5))).cast("int"), F.lit(0))
                      for n in names])
    avail = [n for n in preference if n in names]
    final_p = F.coalesce(*[F.col(f"p_{n}") for n in avail], F.lit(0.0)) if avail else F.lit(0.0)
    used = F.coalesce(*[F.when(F.col(f"p_{n}").isNotNull(), F.lit(n)) for n in avail], F.lit("none")) \
        if avail else F.lit("none")
    final_pred = F.coalesce(*[F.when(F.col(f"p_{n}").isNotNull(),
                                     (F.col(f"p_{n}") >= F.lit(thresholds.get(n, 0.5))).cast("int"))
                              for n in avail], F.lit(0)) if avail else F.lit(0)
    return df.withColumns({"all_probabilities": F.map_from_arrays(keys, probs),
                           "all_predictions": F.map_from_arrays(keys, preds),
                           "fraud_probability": final_p, "prediction": final_pred, "model_used": used})
