"""Corpus pipeline: stages that each call one operator of :mod:`epiframe.llm`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import decontaminate, near_dedup, packing, quality, substring_dedup
from epiframe.llm.staging import dropped, scratch, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, keep_text=True)
    return scored.where(F.col("_score") >= quality.REJECT).withColumnRenamed("_text", "text").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts stays: that of the smallest id.

    Each row is judged by its own text: different texts of one id stay, and of rows with the same id and text one stays.
    Texts without words are in no group.  Of a group without ids the text of smallest hash stays.
    """
    found = near_dedup.near_duplicate_texts(docs.select("doc_id", "text"))
    row = F.struct(F.col("id").isNull().alias("n"), "id", "text_hash")
    best = found.where("group is not null").groupBy("group").agg(F.min(row).alias("best"))
    gone = found.join(best, "group").where(row != F.col("best")).select(F.struct(F.col("id").alias("doc_id"), "text_hash").alias("_row")).distinct()
    keyed = docs.withColumn("_row", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    return keyed.join(gone, "_row", "left_anti").dropDuplicates(["_row"]).select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows are cut from the texts; texts without any stay as they are, null becomes empty."""
    out = substring_dedup.remove_repeats(docs)
    return out.withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by its own text, whether its id is null or repeated."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = decontaminate.contaminated(keyed.select("_row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return keyed.join(found.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Signatures, hashes and trained models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written and read again; what a stage wrote on the way goes when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            docs = staged(result, name, keep=True)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
