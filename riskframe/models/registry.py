"""One model folder for every fitted artifact.

``<dir>/manifest``   parquet (name, kind)
``<dir>/models/<name>``   Spark ML writer output, or parquet tables for the
                          isolation forest and the reconstruction model
``<dir>/leaderboard``   parquet: thresholds and metrics keyed by model
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.sql import DataFrame, SparkSession

from riskframe.models import boost as BO
from riskframe.models import iforest as IF
from riskframe.models import recon as RC

_ML = {"gbt": GBTClassificationModel, "forest": RandomForestClassificationModel,
       "logit": LogisticRegressionModel, "pipeline": PipelineModel}


def _kind(model) -> str:
    if isinstance(model, IF.IsolationForestModel):
        return "iforest"
    if isinstance(model, RC.ReconModel):
        return "recon"
    if isinstance(model, BO.BoostModel):
        return "boost"
    for k, cls in _ML.items():
        if isinstance(model, cls):
            return k
    raise TypeError(f"cannot save {type(model).__name__}")


def save_models(spark: SparkSession, model_dir: str, models: dict, leaderboard: DataFrame | None = None) -> None:
    rows = []
    for name, m in models.items():
        kind = _kind(m)
        path = f"{model_dir}/models/{name}"
        if kind == "iforest":
            IF.save(m, spark, path)
        elif kind == "recon":
            spark.createDataFrame([(m.features, m.components, m.means, m.lo, m.hi)],
                                  "features array<string>, components array<array<double>>, means array<double>, lo double, hi double"
                                  ).write.mode("overwrite").parquet(path)
        elif kind == "boost":
            spark.createDataFrame([(m.to_json(),)], "model string").write.mode("overwrite").parquet(path)
        else:
            m.write().overwrite().save(path)
        rows.append((name, kind))
    spark.createDataFrame(rows, "name string, kind string").write.mode("overwrite").parquet(f"{model_dir}/manifest")
    if leaderboard is not None:
        leaderboard.write.mode("overwrite").parquet(f"{model_dir}/leaderboard")


def load_models(spark: SparkSession, model_dir: str) -> tuple[dict, DataFrame | None]:
    models = {}
    for name, kind in spark.read.parquet(f"{model_dir}/manifest").collect():  # one row per model
        path = f"{model_dir}/models/{name}"
        if kind == "iforest":
            models[name] = IF.load(spark, path)
        elif kind == "recon":
            r = spark.read.parquet(path).first()
            models[name] = RC.ReconModel(list(r.features), [list(x) for x in r.components], list(r.means), r.lo, r.hi)
        elif kind == "boost":
            models[name] = BO.BoostModel.from_json(spark.read.parquet(path).first()["model"])
        else:
            models[name] = _ML[kind].load(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{model_dir}/leaderboard")
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # a folder may be saved without metrics
    return models, spark.read.parquet(f"{model_dir}/leaderboard") if there else None


def thresholds(leaderboard: DataFrame) -> dict[str, float]:
    """Per-model thresholds (one row per model) for the stream scorer."""
    return {r.model: r.threshold for r in leaderboard.select("model", "threshold").collect()}
