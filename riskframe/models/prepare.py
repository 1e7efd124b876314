"""Feature preparation for learning.

The fitted state is a ``PipelineModel``: label encoders are
``StringIndexerModel``s (alphabetical codes, like the reference's encoder),
scaling is a ``SQLTransformer`` holding the fitted means and population
standard deviations as literals, and a ``VectorAssembler`` builds the
feature vector. It saves and loads with the standard ML writers.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe import schema as S
from riskframe.functions import scalars as X
from riskframe.operators import prefix


#: classes of a label at most, for what is kept as literals
MAX_CLASSES = 100


def fit_label_encoders(df: DataFrame, cols=S.CATEGORICAL_COLUMNS, handle_invalid: str = "keep"):
    """M1: one ``StringIndexerModel`` per present categorical column; codes
    follow sorted value order. ``handle_invalid``: ``error`` raises on an
    unseen value (the reference's behaviour), ``keep`` maps it to an extra
    code, ``skip`` drops the row."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return []
    texts = df.select(*[X.category_text(c).alias(f"{c}__text") for c in present])
    si = StringIndexer(inputCols=[f"{c}__text" for c in present], outputCols=[f"{c}__code" for c in present],
                       stringOrderType="alphabetAsc", handleInvalid=handle_invalid)
    return [SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(CAST(`{c}` AS STRING), 'nan') AS `{c}__text`" for c in present) + " FROM __THIS__"),
        si.fit(texts),
        SQLTransformer(statement=_replace_stmt(present))]


def _replace_stmt(cols):
    # codes replace the text columns under their original names
    return ("SELECT * EXCEPT (" + ", ".join(f"`{c}`, `{c}__text`, `{c}__code`" for c in cols) + "), "
            + ", ".join(f"CAST(`{c}__code` AS INT) AS `{c}`" for c in cols) + " FROM __THIS__")


def fit_scaler(df: DataFrame, cols: list[str]) -> SQLTransformer:
    """M2: standardise with the mean and the **population** std (MLlib's
    ``StandardScaler`` uses the sample std); a zero std divides by 1. One
    aggregate pass; the 2 x len(cols) numbers become literals."""
    if not cols:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    exprs = []
    for i, c in enumerate(cols):
        m = row[f"m_{i}"] or 0.0
        s = row[f"s_{i}"] or 0.0
        s = s if s != 0.0 else 1.0
        exprs.append(f"(CAST(`{c}` AS DOUBLE) - {m!r}D) / {s!r}D AS `{c}`")
    keep = "SELECT * EXCEPT (" + ", ".join(f"`{c}`" for c in cols) + "), "
    return SQLTransformer(statement=keep + ", ".join(exprs) + " FROM __THIS__")


def standardise_expr(df: DataFrame, cols: list[str]) -> DataFrame:
    """M2 as plain columns over ``df`` itself (mean and population std as
    scalar subqueries)."""
    out = df
    for c in cols:
        m = df.agg(F.avg(c)).scalar()
        s = df.agg(F.stddev_pop(c)).scalar()
        out = out.withColumn(c, (F.col(c).cast("double") - m) / F.when(s == 0, F.lit(1.0)).otherwise(s))
    return out


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical=S.CATEGORICAL_COLUMNS,
                     handle_invalid: str = "keep", features_col: str = "features") -> PipelineModel:
    """Encoders + scaler + assembler fitted on ``train`` only (the
    reference fits before splitting, which leaks test labels)."""
    stages = fit_label_encoders(train, categorical, handle_invalid)
    enc = PipelineModel(stages=stages).transform(train) if stages else train
    cats = [c for c in categorical if c in train.columns]
    stages.append(fit_scaler(enc, numeric))
    stages.append(VectorAssembler(inputCols=[*numeric, *cats], outputCol=features_col, handleInvalid="keep"))
    return PipelineModel(stages=stages)


def class_weights(df: DataFrame, label: str = "Class") -> DataFrame:
    """M3: balanced weights ``n / (k * n_c)`` per class, and the positive
    weight ratio ``w1 / w0``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy()  # one row per class, in one aggregate over the source
    n, k = F.sum("n_c").over(every), F.count(label).over(every)
    w = c.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))
    at = {v: F.max(F.when(F.col(label) == v, F.col("weight"))).over(every) for v in (0, 1)}
    return w.withColumn("pos_weight_ratio", at[1] / at[0])


def with_weights(df: DataFrame, label: str = "Class", name: str = "weight") -> DataFrame:
    """M3 as a weight column, joined from the class table (one row per class;
    no hint: Spark broadcasts it as long as it is small)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(w, label, "left")


def split_key(id_col: str = "transaction_id", seed: int = 42):
    """Stable 32-bit key from md5(id:seed); DuckDB can compute the same."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str = "Class", test_size: float = 0.2, seed: int = 42,
                     id_col: str = "transaction_id") -> DataFrame:
    """M4: per class, the ``ceil(test_size * n_c)`` rows with the smallest
    md5 keys (ties by id) are ``test``, the rest ``train``. Stable under
    repartitioning and re-runs.

    Rows without a label are a class of their own.

    Only a narrow (class, key, id) projection is ranked (distributed prefix
    count, so the big class is not ranked in one task); the rank gives one
    cut-off (key, id) per class, whose values become literals of one ``CASE``
    expression: the wide rows are labelled in place, never shuffled or joined.
    A label with more than MAX_CLASSES values is an error."""
    keyed = df.withColumn("_key", split_key(id_col, seed))
    narrow = keyed.select(label, "_key", id_col)
    counts = narrow.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_nc"))
    if counts.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}")
    ranked = prefix.running(narrow, ["_key", id_col], {"_r": F.lit(1.0)}, by=[label])
    cuts = (ranked.join(F.broadcast(counts), ranked[label].eqNullSafe(counts["_c"]), "inner")
            .filter(F.col("_r") == F.ceil(F.col("_nc") * test_size))
            .select(label, "_key", id_col).collect())   # one row per class
    is_test = F.lit(False)
    for cls, ck, cid in cuts:
        below = (F.col("_key") < F.lit(ck)) | ((F.col("_key") == F.lit(ck)) & (F.col(id_col) <= F.lit(cid)))
        is_test = F.when(F.col(label).eqNullSafe(F.lit(cls)), below).otherwise(is_test)
    return keyed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_key")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as the cluster runs at once, at least a
    MiB of input each (beyond 128 MiB a task: more). Learning passes over its rows
    hundreds of times; in the partitions of a columnar file, which may be a single
    row group, one core would do that work."""
    small, large = (prefix.auto_partitions(df, mib << 20) for mib in (1, 128))
    n = min(small, max(large, df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(n) if n > 1 else df


def save_preprocessor(model: PipelineModel, path: str) -> None:
    """S5."""
    model.write().overwrite().save(path)


def load_preprocessor(path: str) -> PipelineModel:
    """S5."""
    return PipelineModel.load(path)
