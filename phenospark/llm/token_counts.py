"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, count). Content is normalised only as far as counts allow
(NULL becomes empty); its digest is SHA-256 of the UTF-8 bytes, the tokenizer's that of its file. Texts meet by digest, so
each different text is there once; those whose digest is stored are joined, the others are encoded and appended. Two writers
may append the same count; readers group by digest.

Rows: one per input row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx, tokens
from phenospark.session import scratch_path

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(vocabulary: str) -> str:
    with open(tokens.vocabulary_path(vocabulary), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(batches, vocabulary: str, digest: str):
    encoder = tokens.encoder(vocabulary)
    for batch in batches:
        texts, counts = batch.column(1), []
        for lo, hi in tx.chunked(pc.binary_length(texts).to_pylist(), 4 << 20):
            counts += [len(ids) // 4 for ids in encoder.encode(texts.slice(lo, hi - lo).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def count_tokens(docs: DataFrame, cache_path: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row; new counts are in the cache afterwards."""
    spark, version = docs.sparkSession, tokenizer_digest(vocabulary)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    distinct = keyed.groupBy("content_digest").agg(F.first("text").alias("text"))
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    misses = distinct.join(stored().select("content_digest").distinct(), "content_digest", "left_anti") if _exists(spark, cache_path) else distinct
    misses.mapInArrow(lambda it: _count(it, vocabulary, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    tx.release(spark)
    counts = stored().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """The whole of documents, beginning with an empty cache."""
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
