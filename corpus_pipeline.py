"""Corpus pipeline: quality, near-duplicates, repeated strings, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces. ``run`` writes each result to the shared folder, so a lost executor costs at
most the stage at hand.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenospark.llm import decontaminate, packing, quality, simhash, suffix_dedup, texts as tx


def _in_small_batches(stage):
    """A stage's result is written by the caller, so the session keeps sending small Arrow batches after the stage returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(tx.BATCH_BYTES, tx.SMALL_BATCH)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_in_small_batches
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id; of its repeated rows one."""
    found = simhash.similar_texts(docs).where(F.col("component_id") == F.col("order_id"))
    stays = found.groupBy("order_id").agg(F.min("rid").alias("rid")).select(F.col("order_id").alias("__order"), F.col("rid").alias("__rid"))
    order, rid = F.coalesce(docs["doc_id"].cast("long"), F.lit(tx.LAST_ID)), F.xxhash64(docs["doc_id"], docs["text"])
    kept = docs.withColumns({"__order": order, "__rid": rid}).join(stays, ["__order", "__rid"], "left_semi")
    return _one_of_equal(kept, docs.columns)


def _one_of_equal(kept: DataFrame, columns: list[str]) -> DataFrame:
    """Repeated rows share doc_id and text; the first of them in the order of the other columns stays."""
    whole = F.struct(*(F.col(c) for c in columns))
    return kept.groupBy("__order", "__rid").agg(F.min(whole).alias("row")).select(*(F.col("row")[c].alias(c) for c in columns))


@_in_small_batches
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere as well."""
    return suffix_dedup.strip_texts(docs)


@_in_small_batches
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of 10 words of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: No SQL: a learned model and a tokenizer decide. tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tx.Stage(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
