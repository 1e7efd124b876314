"""Evaluation of scores against labels (E1-E6), exact and distributed.

Rows are first collapsed to one row per (model, distinct score) with
positive/negative counts; cumulative counts "from the top" come from the
distributed prefix sums, so no step sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import prefix
from riskframe.session import materialize


def long_scores(df: DataFrame, models: dict, label: str = "Class") -> DataFrame:
    """(model, score, label) rows from one column (or expression) per model:
    one scan, each row unpivoted."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("score"))
                      for m, c in models.items()])
    return (df.select(F.col(label).cast("int").alias("label"), F.explode(pairs).alias("x"))
            .select("x.model", "x.score", "label"))


def curve(scores: DataFrame) -> DataFrame:
    """E1/E4 core: per model and distinct score, counts at and above it:
    ``tp``, ``fp`` (cumulative from the top), ``pos``/``neg`` at the score, and
    the model's totals ``P``/``N``. Rows without a score or a label are left out."""
    s = scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull())
    c = s.groupBy("model", "score").agg(F.sum("label").cast("long").alias("pos"),
                                        (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("neg"))
    r = prefix.running(c, [F.col("score").desc()], {"tp": "pos", "fp": "neg"}, by=["model"])
    tot = c.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return (r.withColumns({"tp": F.col("tp").cast("long"), "fp": F.col("fp").cast("long")})
            .join(tot, "model", "left"))


def pr_curve(scores: DataFrame | None, c: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every distinct threshold (predict positive
    when score >= threshold). Recall is 1 when there are no positives.
    ``c``: a precomputed :func:`curve` to share."""
    c = c if c is not None else curve(scores)
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))
    return c.select("model", F.col("score").alias("threshold"), "tp", "fp",
                    prec.alias("precision"), rec.alias("recall"))


def roc_curve(scores: DataFrame) -> DataFrame:
    """False and true positive rates at every distinct threshold."""
    c = curve(scores)
    return c.select("model", F.col("score").alias("threshold"),
                    F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))


def auc(scores: DataFrame | None, c: DataFrame | None = None) -> DataFrame:
    """Exact ROC AUC per model (ties count one half), as the rank-sum
    statistic. The numerator is an exact integer, so the result does not
    depend on summation order. Equals Spark ML's
    ``BinaryClassificationEvaluator`` with ``numBins=0``."""
    c = c if c is not None else curve(scores)
    num = F.sum(F.lit(2) * F.col("pos") * (F.col("N") - F.col("fp")) + F.col("pos") * F.col("neg"))
    g = c.groupBy("model").agg(num.alias("_num"), F.first("P").alias("P"), F.first("N").alias("N"))
    return g.select("model", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                    F.col("_num").cast("double") / (F.lit(2.0) * F.col("P") * F.col("N")))
                    .alias("auc"))


def threshold_for_precision(pr: DataFrame, target: float = 0.90, mode: str = "exact") -> DataFrame:
    """Per model, the threshold reaching ``target`` precision.

    ``exact``: the smallest threshold whose precision >= target.
    ``reference``: the distinct score just below that one, 0.5 when it is the
    smallest score. Both fall back to the largest threshold when no
    threshold reaches the target (the curve's final point has precision 1).
    """
    meets = F.col("precision") >= target
    g = pr.groupBy("model").agg(
        F.min(F.when(meets, F.col("threshold"))).alias("_hit"),
        F.max("threshold").alias("_max"),
        F.min("threshold").alias("_min"))
    if mode == "exact":
        return g.select("model", F.coalesce("_hit", "_max").alias("threshold"))
    below = pr.join(g.select("model", "_hit"), "model").filter(F.col("threshold") < F.col("_hit")) \
        .groupBy("model").agg(F.max("threshold").alias("_below"))
    j = g.join(below, "model", "left")
    thr = (F.when(F.col("_hit").isNull(), F.col("_max"))
           .when(F.col("_hit") == F.col("_min"), F.lit(0.5)).otherwise(F.col("_below")))
    return j.select("model", thr.alias("threshold"))


def confusion(scores: DataFrame, thresholds: DataFrame, strict: bool = False) -> DataFrame:
    """Confusion counts per model at its threshold (F5: ``>=``, or ``>`` when
    ``strict`` for anomaly scores). ``thresholds`` has one row per model."""
    j = scores.join(thresholds, "model", "inner")
    pred = (F.col("score") > F.col("threshold")) if strict else (F.col("score") >= F.col("threshold"))
    pred = F.coalesce(pred, F.lit(False))
    y = F.col("label") == 1
    return j.groupBy("model", "threshold").agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))


def confusion_at(c: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The same counts read off the :func:`curve` (rows with a score), without
    another pass over the rows."""
    j = c.join(thresholds, "model", "inner")
    up = F.col("score") >= F.col("threshold")
    g = j.groupBy("model", "threshold").agg(
        F.coalesce(F.sum(F.when(up, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(up, F.col("neg"))), F.lit(0)).alias("fp"),
        F.first("P").alias("P"), F.first("N").alias("N"))
    return g.select("model", "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))


def _div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p, r):
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def classification_report(conf: DataFrame) -> DataFrame:
    """E5: per model rows for class 0, class 1, accuracy, macro and weighted
    averages (precision, recall, f1_score, support); 0 on empty division."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    base = conf.select("model", p1.alias("p1"), r1.alias("r1"), p0.alias("p0"), r0.alias("r0"),
                       s1.alias("s1"), s0.alias("s0"), n.alias("n"), _div(tp + tn, n).alias("acc"))
    f1_1, f1_0 = _f1(F.col("p1"), F.col("r1")), _f1(F.col("p0"), F.col("r0"))
    rows = [
        ("0", F.col("p0"), F.col("r0"), f1_0, F.col("s0")),
        ("1", F.col("p1"), F.col("r1"), f1_1, F.col("s1")),
        ("accuracy", F.col("acc"), F.col("acc"), F.col("acc"), F.col("n")),
        ("macro avg", (F.col("p0") + F.col("p1")) / 2.0, (F.col("r0") + F.col("r1")) / 2.0,
         (f1_0 + f1_1) / 2.0, F.col("n")),
        ("weighted avg", _div(F.col("p0") * F.col("s0") + F.col("p1") * F.col("s1"), F.col("n")),
         _div(F.col("r0") * F.col("s0") + F.col("r1") * F.col("s1"), F.col("n")),
         _div(f1_0 * F.col("s0") + f1_1 * F.col("s1"), F.col("n")), F.col("n")),
    ]
    lines = F.array(*[F.struct(F.lit(k).alias("class_label"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                               f.cast("double").alias("f1_score"), s.cast("long").alias("support")) for k, p, r, f, s in rows])
    return base.select("model", F.explode(lines).alias("x")).select("model", "x.*")


def leaderboard(df: DataFrame, models: dict, label: str = "Class", target: float = 0.90,
                mode: str = "exact") -> DataFrame:
    """Per model threshold (E2), precision, recall, F1 of class 1,
    accuracy (E5) and AUC (E3) over the rows that have a score, with the
    listing order kept in ``model_order`` for K4's tie rule."""
    # one row per model and distinct score, written once; everything below reads that
    c, _ = materialize(curve(long_scores(df, models, label)), "leaderboard-curve")
    thr = threshold_for_precision(pr_curve(None, c), target, mode)
    conf = confusion_at(c, thr)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = _div(tp, tp + fp), _div(tp, tp + fn)
    m = conf.select("model", "threshold", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1_score"),
                    _div(tp + tn, tp + fp + fn + tn).alias("accuracy"))
    order = F.create_map(*[x for i, k in enumerate(models) for x in (F.lit(k), F.lit(i))])
    return m.join(auc(None, c), "model", "left").withColumn("model_order", order[F.col("model")])
