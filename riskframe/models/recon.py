"""Reconstruction-error anomaly score.

The reference trains a neural autoencoder on one machine; the Spark-native
stand-in is a linear one: principal components (MLlib ``PCA``, fitted by a
distributed covariance), centring, projection and reconstruction as plain column
arithmetic with the fitted d x k matrix as literals (whole-stage codegen, no
UDF), and the per-row mean squared error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import scalars as X


@dataclass
class ReconModel:
    features: list[str]
    components: list[list[float]]   # d x k
    means: list[float]               # of the training rows: centre, and what a null counts as
    lo: float | None = None          # training error range (for stored normalisation)
    hi: float | None = None

    def error(self, df: DataFrame, name: str = "recon_error") -> DataFrame:
        d, k = len(self.features), len(self.components[0])
        x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)) - F.lit(m)
             for c, m in zip(self.features, self.means, strict=True)]
        proj = []
        for j in range(k):
            e = None
            for i in range(d):
                t = x[i] * F.lit(self.components[i][j])
                e = t if e is None else e + t
            proj.append(e)
        out = df.withColumns({f"_pc{j}": proj[j] for j in range(k)})
        err = None
        for i in range(d):
            r = None
            for j in range(k):
                t = F.col(f"_pc{j}") * F.lit(self.components[i][j])
                r = t if r is None else r + t
            sq = (x[i] - r) * (x[i] - r)
            err = sq if err is None else err + sq
        return out.withColumn(name, err / float(d)).drop(*[f"_pc{j}" for j in range(k)])

    def probability(self, df: DataFrame, err: str = "recon_error", name: str = "p_recon",
                    batch_range: bool = False) -> DataFrame:
        """F6 direct: min-max normalised error by the stored training range,
        clipped to [0, 1]; ``batch_range`` uses the scored batch's own min/max
        instead (the reference's behaviour, Q12)."""
        if batch_range:
            lo, hi = df.agg(F.min(err)).scalar(), df.agg(F.max(err)).scalar()
        else:
            lo, hi = self.lo, self.hi
        z = X.minmax_normalise(err, lo, hi)
        return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)))


def fit(train: DataFrame, features: list[str], k: int = 8) -> ReconModel:
    """Principal components of the centred training rows; nulls and NaN count
    as the mean in the fit as in scoring."""
    cols = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in features]
    row = train.select(*cols).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).first()
    means = [float(x or 0.0) for x in row]
    filled = train.select(*[F.coalesce(e, F.lit(m)).alias(c) for e, m, c in zip(cols, means, features, strict=True)])
    vec = VectorAssembler(inputCols=features, outputCol="_vec").transform(filled)
    pca = PCA(k=min(k, len(features)), inputCol="_vec", outputCol="_pca").fit(vec)
    pc = pca.pc.toArray().tolist()   # d x k, bounded by the feature count
    model = ReconModel(features=list(features), components=pc, means=means)
    e = model.error(train)
    model.lo, model.hi = e.agg(F.min("recon_error"), F.max("recon_error")).first()
    return model
