"""Queries of this subpackage: one ``opN_`` query for each dealt operator, over
its whole table with production parameters, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    from riskframe.llm.simhash_ball import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    from riskframe.llm.ga_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _byte_bpe())


@query("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    from riskframe.llm.template_decontam import contaminated

    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    bad = contaminated(docs, bench)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(bad, ids["doc_id"].eqNullSafe(bad["doc_id"]), "left")
    return out.select(ids["doc_id"], F.col("item_ids").isNotNull().alias("contaminated"), "item_ids",
                      F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


@query("op6_language_id")
def op6(spark, sf_dir):
    from riskframe.llm.common import crc_bucket
    from riskframe.llm.language_id import fit, predict

    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket("doc_id", 3) == 1)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    from riskframe.llm.cdc_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "removed_words", "removed_spans", "text")


@query("op1_sharding")
def op1(spark, sf_dir):
    from riskframe.llm.sharding import shard_rows

    out = shard_rows(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    import public_tokenizers

    from riskframe.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    from riskframe.llm.deleted_interpolation import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op9_embedding_near_dedup")
def op9(spark, sf_dir):
    from riskframe.llm.rabitq_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_chat_formatting")
def op3(spark, sf_dir):
    from pyspark.sql import Window

    from riskframe.llm.reply_trees import format_trees, read_loss, read_turns

    hard = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                                  "conv_id long, turn long, role string, text string"))
    # rows by turn: each row answers the one before
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    tree = rows.select("conv_id", place.alias("node"), (place - 1).alias("parent"), "role", "text")
    out = format_trees(tree, tree="conv_id", score=None)
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss"))
    return out.select(F.col("tree").alias("conv_id"), F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
                      F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: fixed values: the phrases of the contract and their labels
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@query("op11_license_scan")
def op11(spark, sf_dir):
    from riskframe.llm.license_scan import scan

    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: (p["edits"] == 0) & p["notice"].isin(*BASE_PHRASES))

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    words = F.transform(base, lambda p: p["word"])
    closeness = F.transform("places", lambda p: 1.0 - p["edits"] / F.length(p["notice"]))
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                      F.array_max(words).alias("last_word"), labels(base).alias("base_labels"),
                      labels(F.col("places")).alias("labels"),
                      F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"), "places")


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    from riskframe.llm.variant_trie import variant_forms, word_counts

    return variant_forms(word_counts(table(spark, sf_dir, "documents")))


_SEARCH_SQL = r"""
with word as (
  select item_id as id, false as is_doc, row_number() over () as r, text from benchmark
  union all select doc_id, true, row_number() over (), text from documents),
term as (
  select is_doc, r, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from word),
freq as (select is_doc, r, id, t, count(*) as n from term group by all),
size as (select r, sum(n)::bigint as n from freq where is_doc group by r),
whole as (select count(*)::bigint as docs, sum(n)::bigint as len from size),
weight as (
  select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
  from freq, whole where is_doc group by t),
scored as (
  select q.r, q.id as item_id, d.r as dr, d.id as doc_id,
         sum(q.n * w * ((1000000000 * d.n) // (1000 * d.n + 8 * (25 + (75 * size.n * docs) // len))))::bigint as score
  from freq q join freq d on q.t = d.t and not q.is_doc and d.is_doc
  join weight on weight.t = q.t join size on size.r = d.r, whole
  group by q.r, q.id, d.r, d.id)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by r order by score desc, doc_id))::int as rank from scored where score > 0)
where rank <= 10
"""


@query("op12_ranked_search", _SEARCH_SQL)
def op12(spark, sf_dir):
    from riskframe.llm.nra_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
