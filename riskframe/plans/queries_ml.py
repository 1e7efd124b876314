"""Registered queries: preparation, learning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.models import boost as BO
from riskframe.models import classifiers as CL
from riskframe.models import hybrid as HY
from riskframe.models import iforest as IF
from riskframe.models import prepare as PP
from riskframe.models import recon as RC
from riskframe.models import registry as RG
from riskframe.operators import evaluate as EV
from riskframe.plans import jobs as J
from riskframe.plans import views as V
from riskframe.plans.catalog import register
from riskframe.plans.oracle import ML_COLUMNS, sql
from riskframe.plans.queries_report import _LB_SQL, stand_in_models
from riskframe.session import scratch_path

register("M1_label_encode", sql("tx", body="SELECT transaction_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS INTEGER) AS {c}" for c in S.CATEGORICAL_COLUMNS)
    + " FROM tx"))(
    lambda spark, d: (lambda t: __import__("pyspark.ml", fromlist=["PipelineModel"]).PipelineModel(
        stages=PP.fit_label_encoders(t, handle_invalid="error")).transform(t))(
        V.tx(spark, d).select("transaction_id", *S.CATEGORICAL_COLUMNS)))

register("M2_standardise", sql("ml", body="SELECT transaction_id, " + ", ".join(
    f'round(("{v}" - avg("{v}") OVER ()) / CASE WHEN stddev_pop("{v}") OVER () = 0 THEN 1.0 '
    f'ELSE stddev_pop("{v}") OVER () END, 6) AS "{v}"' for v in ML_COLUMNS) + " FROM ml"))(
    lambda spark, d: (lambda ml, cols: PP.fit_scaler(ml, cols).transform(ml).select(
        "transaction_id", *[F.round(v, 6).alias(v) for v in cols]))(V.ml(spark, d), V.ml_columns(spark, d)))

register("M3_class_weights", sql("tx", """c AS (SELECT "Class", count(*) AS n_c FROM tx GROUP BY 1)""",
                                 """k AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)""",
                                 body="""SELECT "Class", n_c, n / (k * n_c) AS weight,
  (SELECT n / (k * n_c) FROM c, k WHERE "Class" = 1) / (SELECT n / (k * n_c) FROM c, k WHERE "Class" = 0) AS pos_weight_ratio
FROM c, k"""))(lambda spark, d: PP.class_weights(V.tx(spark, d)))

_SPLIT_SQL = """sp AS (SELECT transaction_id, "Class", "Amount",
  CASE WHEN row_number() OVER (PARTITION BY "Class" ORDER BY
      CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT), transaction_id)
    <= ceil(count(*) OVER (PARTITION BY "Class") * 0.2) THEN 'test' ELSE 'train' END AS split FROM tx)"""

register("M4_stratified_split", sql("tx", _SPLIT_SQL, body="""SELECT transaction_id, "Class", split FROM sp"""))(
    lambda spark, d: PP.stratified_split(V.tx(spark, d).select("transaction_id", "Class")))

_PREP_NUMERIC = ["Time", "Amount", "hour_of_day", "day_of_week", "avg_amount_per_customer", "tx_freq_24h", "merchant_fraud_rate"]


def _prepare(spark, d):
    """C3, the whole job: split, features with training profiles, encoders and
    scaler fitted on the training side, both sides transformed."""
    train, test, _ = J.prepare(V.tx(spark, d).drop("ts"), numeric=_PREP_NUMERIC)
    return train.unionByName(test).select("transaction_id", "split", "Class", *[F.round(c, 6).alias(c) for c in _PREP_NUMERIC],
                                          *S.CATEGORICAL_COLUMNS)


_MEAN2 = 'CAST(sum(CAST("Amount" AS DECIMAL(38,2))) AS DOUBLE) / count("Amount")'
register("C3_prepare", sql(
    "tx", _SPLIT_SQL, """t AS (SELECT tx.*, sp.split FROM tx JOIN sp USING (transaction_id))""", """tr AS (SELECT * FROM t WHERE split = 'train')""",
    f"""cp AS (SELECT customer_id, {_MEAN2} AS a FROM tr GROUP BY 1)""",
    """mp AS (SELECT merchant_id, avg(CAST("Class" AS DOUBLE)) AS r FROM tr GROUP BY 1)""",
    f"""f AS (SELECT t.*, CAST(floor("Time" / 3600.0) % 24 AS INTEGER) AS hour_of_day, CAST(floor("Time" / 86400.0) % 7 AS INTEGER) AS day_of_week,
  coalesce(cp.a, (SELECT {_MEAN2} FROM tr)) AS avg_amount_per_customer, coalesce(mp.r, 0.0) AS merchant_fraud_rate,
  count(*) OVER (PARTITION BY split, t.customer_id ORDER BY "Time" RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW) AS tx_freq_24h
  FROM t LEFT JOIN cp ON t.customer_id = cp.customer_id LEFT JOIN mp ON t.merchant_id = mp.merchant_id)""",
    "st AS (SELECT " + ", ".join(f'avg("{c}") AS "m_{c}", coalesce(nullif(stddev_pop("{c}"), 0), 1.0) AS "s_{c}"' for c in _PREP_NUMERIC)
    + " FROM f WHERE split = 'train')",
    *[f"""e_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code, count(*) OVER () AS k
  FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS v FROM tr) AS x)""" for c in S.CATEGORICAL_COLUMNS],
    body='SELECT transaction_id, split, "Class", ' + ", ".join(f'round((f."{c}" - "m_{c}") / "s_{c}", 6) AS "{c}"' for c in _PREP_NUMERIC) + ", "
    + ", ".join(f"CAST(coalesce(e_{c}.code, (SELECT max(k) FROM e_{c})) AS INTEGER) AS {c}" for c in S.CATEGORICAL_COLUMNS)
    + " FROM f CROSS JOIN st " + " ".join(f"LEFT JOIN e_{c} ON e_{c}.v = coalesce(CAST(f.{c} AS VARCHAR), 'nan')" for c in S.CATEGORICAL_COLUMNS)))(
    _prepare)

register("M8_ensemble_weights", sql("scored", body="""SELECT transaction_id,
  fraud_probability * 0.5::DOUBLE + round(1.0 - exp(-"Amount" / 100.0), 6) * 0.3::DOUBLE
  + (CASE WHEN transaction_type = 'error' THEN 0.9 ELSE 0.1 END) * 0.2::DOUBLE AS p_ensemble FROM scored"""))(
    lambda spark, d: CL.ensemble(V.scored(spark, d).withColumns(
        {f"p_{k}": v for k, v in stand_in_models().items()}), members=("amount50", "amount100", "type_flag"))
    .select("transaction_id", "p_ensemble"))


def _anomaly_stand_in():
    """A deterministic anomaly probability: distance of Amount from 100,
    scaled (a stand-in so M11 has an exact oracle)."""
    return F.round(F.abs(F.col("Amount") - 100.0) / 500.0, 6)


def _hybrid(spark, d):
    s = PP.stratified_split(V.tx(spark, d).select("transaction_id", "Class", "Amount"))
    s = s.withColumn("p_anom", _anomaly_stand_in())
    cut = HY.anomaly_cut(s.filter("split = 'train'"), "p_anom", 0.95)
    return HY.hybrid_labels(s, "p_anom", cut).select("transaction_id", "split", "hybrid_label")


register("M11_hybrid_labels", sql("tx", _SPLIT_SQL, """a AS (SELECT *, round(abs("Amount" - 100.0) / 500.0, 6) AS p_anom FROM sp)""",
                                  body="""SELECT transaction_id, split, greatest("Class",
  CAST(p_anom > (SELECT quantile_cont(p_anom, 0.95) FROM a WHERE split = 'train') AS INTEGER)) AS hybrid_label FROM a"""))(_hybrid)


def _multi(spark, d):
    s = V.scored(spark, d).withColumns({f"p_{k}": v for k, v in stand_in_models().items()})
    m = CL.multi_model(s, ["amount50", "amount100", "type_flag"], thresholds={"amount50": 0.5, "amount100": 0.4},
                       preference=("ensemble", "amount50"))
    flagged = F.aggregate(F.map_values("all_predictions"), F.lit(0), lambda a, x: a + x)
    return m.select("transaction_id", "fraud_probability", "prediction", "model_used", flagged.alias("models_flagging"))


register("M14_multi_model", sql("scored", body="""SELECT transaction_id, fraud_probability,
  CAST(fraud_probability >= 0.5 AS INTEGER) AS prediction, 'amount50' AS model_used,
  CAST(fraud_probability >= 0.5 AS INTEGER) + CAST(round(1.0 - exp(-"Amount" / 100.0), 6) >= 0.4 AS INTEGER)
  + CAST((CASE WHEN transaction_type = 'error' THEN 0.9 ELSE 0.1 END) >= 0.5 AS INTEGER) AS models_flagging FROM scored"""))(_multi)

#: rows made bad by their id, each in its own way
_BAD = """CASE WHEN transaction_id % 97 = 5 THEN -1.0 WHEN transaction_id % 101 = 7 THEN NULL ELSE "Amount" END"""


def _with_bad_rows(spark, d):
    i = F.col("transaction_id")
    return V.tx(spark, d).withColumn("Amount", F.when(i % 97 == 5, F.lit(-1.0)).when(i % 101 == 7, F.lit(None)).otherwise(F.col("Amount")))


register("M13_M15_score_batch", sql("tx", f"""b AS (SELECT transaction_id, "Time", {_BAD} AS a FROM tx)""",
                                    """p AS (SELECT *, coalesce("Time" >= 0 AND a >= 0, false) AS ok, round(1.0 - exp(-a / 50.0), 6) AS p FROM b)""",
                                    body="""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id,
  CASE WHEN ok THEN p ELSE 0.0 END AS fraud_probability,
  CASE WHEN NOT ok THEN 'Error' WHEN p > 0.8 THEN 'High' WHEN p > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level,
  'amount50' AS model_used,
  CASE WHEN NOT ok THEN concat_ws('; ',
    CASE WHEN "Time" IS NULL THEN 'missing:Time' END, CASE WHEN "Time" < 0 THEN 'negative:Time' END,
    CASE WHEN a IS NULL THEN 'missing:Amount' END, CASE WHEN a < 0 THEN 'negative:Amount' END) END AS error FROM p"""))(
    lambda spark, d: CL.score_batch(_with_bad_rows(spark, d), lambda df: df.withColumn("p_amount50", V.stand_in_probability()),
                                    name="amount50", required=("Time", "Amount")).drop("prediction_time"))

register("F13_prediction_time", sql("tx", body="SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, true AS timed FROM tx"))(
    lambda spark, d: CL.score_batch(V.tx(spark, d), lambda df: df.withColumn("p_amount50", V.stand_in_probability()),
                                    name="amount50", required=("Time", "Amount")).select(
        "transaction_id", F.col("prediction_time").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d[.]\d{6}$").alias("timed")))

# ---- trained models: scores are not SQL, but the rows, their bounds and bands are ----

_ML_SPLIT = _SPLIT_SQL.replace('"Class", "Amount",', '"Class",').replace("FROM tx)", "FROM ml)")
_CHECKED = """SELECT transaction_id, "Class", true AS in_bounds, true AS banded FROM sp WHERE split = 'test'"""


def _split(spark, d):
    ml = PP.spread(PP.stratified_split(V.ml(spark, d))).checkpoint()
    return ml.filter("split = 'train'"), ml.filter("split = 'test'")


def _prepared(spark, d):
    train, test = _split(spark, d)
    pm = PP.fit_preprocessor(train, V.ml_columns(spark, d), categorical=[])
    return pm.transform(train), pm.transform(test)


def _checked(out, p):
    ok = F.col(p).between(0.0, 1.0)
    return out.select("transaction_id", "Class", F.coalesce(ok, F.lit(False)).alias("in_bounds"),
                      (X.risk_band(p) != "Error").alias("banded"))


def _train_one(spark, d, kind):
    train, test = _prepared(spark, d)
    train = J.with_validation(PP.with_weights(train)).checkpoint()
    if kind == "gbt":
        m = CL.train_gbt(train, "gbt", validation="validation")
    elif kind == "forest":
        m = CL.train_forest(train, "forest")
    else:
        m = CL.train_logit(train, "logit")
    return _checked(CL.positive_probability(m.transform(test), kind), f"p_{kind}")


register("M5_boosted_trees", sql("ml", _ML_SPLIT, body=_CHECKED))(lambda spark, d: _train_one(spark, d, "gbt"))
register("M6_random_forest", sql("ml", _ML_SPLIT, body=_CHECKED))(lambda spark, d: _train_one(spark, d, "forest"))
register("M7_logistic", sql("ml", _ML_SPLIT, body=_CHECKED))(lambda spark, d: _train_one(spark, d, "logit"))


def _auc_floors(spark, d):
    """M5-M8: the learners on transactions, whose label follows from amount and
    type; each has to rank the held-out rows nearly perfectly."""
    tx = V.tx(spark, d).select("transaction_id", "Class", "Amount", "Time", F.hour("ts").alias("hour"),
                               (F.col("transaction_type") == "error").cast("int").alias("is_error"))
    cols = ["Amount", "Time", "hour", "is_error"]
    split = PP.spread(PP.stratified_split(tx)).checkpoint()
    train, test = (split.filter(f"split = '{s}'") for s in ("train", "test"))
    pm = PP.fit_preprocessor(train, cols, categorical=[])
    train, test = PP.with_weights(pm.transform(train)).checkpoint(), pm.transform(test)
    boost = BO.fit(train, cols, rounds=10, rate=0.3)
    RG.save_models(spark, path := scratch_path(spark, "boost"), {"boost": boost})
    out = CL.apply_models(RG.load_models(spark, path)[0]["boost"].score(test, "boost"),
                          {"forest": CL.train_forest(train, "forest", num_trees=20), "logit": CL.train_logit(train, "logit")})
    out = CL.ensemble(out, members=("boost", "forest", "logit")).checkpoint()
    names = ("boost", "forest", "logit", "ensemble")
    auc = EV.auc(EV.long_scores(out, {n: f"p_{n}" for n in names}))
    return auc.select("model", (F.col("auc") >= 0.95).alias("reached"), F.lit(out.count()).cast("long").alias("rows"), F.lit(len(boost.trees)).alias("trees"))


register("M5_M8_auc_floors", sql("tx", _SPLIT_SQL, body="""SELECT unnest(['boost', 'forest', 'logit', 'ensemble']) AS model, true AS reached,
  (SELECT count(*) FROM sp WHERE split = 'test') AS rows, 10 AS trees"""))(_auc_floors)


def _outlier_floors(spark, d):
    """One vector in 25 made long; the anomaly scores have to rank
    these first."""
    cols = V.ml_columns(spark, d)
    odd = F.col("transaction_id") % 25 == 3
    ml = V.ml(spark, d).select("transaction_id", odd.cast("int").alias("Class"), *[F.when(odd, F.col(c) * 4.0).otherwise(F.col(c)).alias(c) for c in cols])
    ml = ml.checkpoint()
    clean = ml.filter("Class = 0")
    iso, rec = IF.fit(clean, cols, trees=50), RC.fit(clean, cols, k=8)
    s = rec.error(iso.score(ml)).select("Class", (-F.col("score_samples")).alias("iforest"), F.col("recon_error").alias("recon"))
    auc = EV.auc(EV.long_scores(s, {"iforest": "iforest", "recon": "recon"}))
    return auc.select("model", (F.col("auc") >= 0.95).alias("reached"), F.lit(ml.filter("Class = 1").count()).cast("long").alias("planted"))


register("M9_M10_outlier_floors", sql("ml", body="""SELECT unnest(['iforest', 'recon']) AS model, true AS reached,
  (SELECT count(*) FROM ml WHERE transaction_id % 25 = 3) AS planted"""))(_outlier_floors)


def _iforest(spark, d):
    train, test = _split(spark, d)
    model = IF.fit(train, V.ml_columns(spark, d))
    lo, hi = model.score(train).agg(F.min("score_samples"), F.max("score_samples")).first()
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.minmax_normalise("score_samples", lo, hi, invert=True)))
    s = model.flag(model.score(test)).withColumn("p_iforest", z)
    return _checked(s, "p_iforest").withColumn("trees", F.lit(int(model.nodes["tree"].nunique())))


register("M9_isolation_forest", sql("ml", _ML_SPLIT, body=_CHECKED.replace("true AS banded", "true AS banded, 200 AS trees")))(_iforest)


def _recon(spark, d):
    train, test = _split(spark, d)
    model = RC.fit(train, V.ml_columns(spark, d), k=8)
    return _checked(model.probability(model.error(test)), "p_recon")


register("M10_reconstruction", sql("ml", _ML_SPLIT, body=_CHECKED))(_recon)


def _train_all(spark, d):
    train, test = _prepared(spark, d)
    models, scored, lb = J.train_all(train, test, features=V.ml_columns(spark, d), model_dir=scratch_path(spark, "models"))
    sane = F.col("auc").between(0.0, 1.0) & F.col("precision").between(0.0, 1.0) & F.col("recall").between(0.0, 1.0)
    return lb.select("model", sane.alias("sane"), F.col("model_order").cast("int").alias("model_order"))


_C4_MODELS = ("gbt", "gbt_e", "forest", "logit", "ensemble", "iforest", "recon", "hybrid")
register("C4_train_leaderboard", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', true, {i})" for i, m in enumerate(_C4_MODELS))
         + ") AS v(model, sane, model_order) WHERE (SELECT count(*) FROM embeddings) > 0")(_train_all)


def _hybrid_gbt(spark, d):
    train, test = _prepared(spark, d)
    iso = IF.fit(train, V.ml_columns(spark, d))
    tr = iso.score(train).checkpoint()
    lo, hi = tr.agg(F.min("score_samples"), F.max("score_samples")).first()
    tr = tr.withColumn("p_anom", X.minmax_normalise("score_samples", lo, hi, invert=True))
    cut = HY.anomaly_cut(tr, "p_anom")
    tr = PP.with_weights(HY.hybrid_labels(tr, "p_anom", cut).drop("score_samples", "p_anom"), "hybrid_label")
    tr = J.with_validation(tr).checkpoint()
    m = CL.train_gbt(tr, "hybrid", label="hybrid_label", validation="validation")
    return _checked(CL.positive_probability(m.transform(test), "hybrid"), "p_hybrid")


register("M12_hybrid_boosted", sql("ml", _ML_SPLIT, body=_CHECKED))(_hybrid_gbt)


def _round_trip(spark, d):
    """The fitted preprocessor, saved and loaded, standardises as before."""
    ml, cols = V.ml(spark, d), V.ml_columns(spark, d)
    path = scratch_path(spark, "preprocessor")
    PP.save_preprocessor(PP.fit_preprocessor(ml, cols, categorical=[]), path)
    out = PP.load_preprocessor(path).transform(ml)
    return out.select("transaction_id", *[F.round(c, 6).alias(c) for c in cols])


register("S5_preprocessor_round_trip", sql("ml", body="SELECT transaction_id, " + ", ".join(
    f'round(("{v}" - avg("{v}") OVER ()) / CASE WHEN stddev_pop("{v}") OVER () = 0 THEN 1.0 '
    f'ELSE stddev_pop("{v}") OVER () END, 6) AS "{v}"' for v in ML_COLUMNS) + " FROM ml"))(_round_trip)


def _registry(spark, d):
    """Models and leaderboard, saved and loaded; the loaded leaderboard."""
    path = scratch_path(spark, "registry")
    RG.save_models(spark, path, {"recon": RC.fit(V.ml(spark, d), V.ml_columns(spark, d), k=2)},
                   EV.leaderboard(V.scored(spark, d), stand_in_models()))
    models, lb = RG.load_models(spark, path)
    return lb.select("model", "threshold", F.lit(",".join(sorted(models))).alias("models"))


register("S6_model_registry", _LB_SQL.format(body="SELECT model, threshold, 'recon' AS models FROM lbf"))(_registry)
