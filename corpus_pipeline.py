"""The training-data pipeline: quality, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and keeps the columns of ``documents``; the
last one returns the packed pieces. ``run`` writes every stage as Parquet in the shared
folder and reads it again as the next stage's input.

Quality drops the documents that the classifier predicts as label 0. Language drops
those without a language: no letters, or too few of the n-grams of the language that
fits best, by a limit from its training rows. Null and empty texts have no language and go there.
Rows that repeat an id and text are documents of their own for quality and language; of
exact and near duplicates, repeated rows included, exactly one row stays.

Columns other than ``doc_id``, ``text`` and ``lang`` are renamed inside a stage, so that none
can clash with what an operator adds. Stages bound the bytes of the session's Arrow batches: with the default of
10,000 rows a batch of long texts takes a good part of an executor outside its heap.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framelore.llm import bitmap, exactdup, langid, lshforest, packing, quality
from framelore.llm.bpe import tokenizer_path
from framelore.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "lang")
BATCH_BYTES = 4 << 20


def shielded(stage: Stage) -> Stage:
    """The stage, with the other columns of the documents under names that no operator uses."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        inner = {c: c if c in OWN else f"column{k}" for k, c in enumerate(docs.columns)}
        done = stage(spark, docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()]), sf_dir)
        back = {i: c for c, i in inner.items()}
        return done.select(*[F.col(c).alias(back.get(c, c)) for c in done.columns])

    return run


@shielded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score_quality(docs, model, "_quality", "_good").filter("_good = 1").select(*docs.columns)


@shielded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(langid.training_rows(docs, ~langid.held_out()))
    return langid.identify(docs, model, "_language", "_sure", "_reads").filter("_reads").select(*docs.columns)


@shielded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c != "doc_id"]
    return exactdup.exact_dedup(docs, carry=others, only_kept=True).select(*docs.columns)


@shielded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are known by id and text. A key of which a row stays and another goes is one of repeated rows: one of them stays."""
    name = lambda text: F.concat_ws(":", F.col("doc_id").cast("string"), text.cast("string")).alias("_key")
    found = lshforest.near_duplicates(docs.select("doc_id", "text")).select(name(F.col("mark")), "stays")
    keys = materialise(found.groupBy("_key").agg(F.bool_and("stays").alias("all"), F.bool_or("stays").alias("some")).filter("not all"), "gone")
    keyed = docs.withColumn("_key", name(F.xxhash64("text")))
    kept = bitmap.drop_matching(keyed, keys.select("_key"), "_key").select(*docs.columns)
    repeated = keys.filter("some").select("_key")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(bitmap.keep_matching(keyed, repeated, "_key").dropDuplicates(["_key"]).select(*docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return packing.pack_best_fit(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: The classifiers, the signatures and the tokenizer are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
