"""Corpus pipeline: language ID, SimHash near-dedup, substring dedup,
benchmark decontamination, best-fit packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import cdc_dedup, ga_packing, language_id, simhash_ball, template_decontam
from riskframe.llm.common import crc_bucket, free_name
from riskframe.session import materialize, ship_package

#: below this probability (four languages: 0.25 is a guess) a text has no recognisable language
MIN_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of no recognisable language;
    learned from the stage's own input, without the held-out third."""
    ship_package(spark)
    model = language_id.fit(docs.where(crc_bucket("doc_id", 3) != 1))
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    scored = language_id.predict(docs, model, label_out=lang, score_out=score)
    # a corpus without any label teaches nothing, so nothing is rejected for its language
    known = F.col(lang) != "und" if model.labels else F.expr("text rlike '\\\\p{L}'")
    return scored.where(known & (F.col(score) >= (MIN_LANGUAGE_SCORE if model.labels else 0.0))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: four-word shingles,
    four differing bits."""
    ship_package(spark)
    return simhash_ball.keep_one(docs, shingle=4, radius=4)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; a document of which nothing
    but white space is left goes."""
    ship_package(spark)
    out = cdc_dedup.dedup_substrings(docs)
    left = (F.col(cdc_dedup.removed_columns(docs)[0]) == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    out = out.where(left).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark question, re-parameterised or not."""
    ship_package(spark)
    return template_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in packed sequences."""
    ship_package(spark)
    return ga_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: hashes, learned models and packing can't be expressed in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
