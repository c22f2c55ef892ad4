"""Token counts with a stored cache of digests.

A text is known by the SHA-256 of its normalised content, a count by that digest
and the digest of the tokenizer's version. Texts are joined to stored counts; of
the rest each distinct text is encoded once and its count appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches
from plumbline.llm.token_text import encoder, together, tokenizer_version

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def normalised(text: Column | str) -> Column:
    """The content that is counted: null counts as empty, nothing else may change."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def stored_counts(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty when nothing is stored yet.

    A digest that two jobs appended at the same time counts once.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        for batch in together(batches):
            coded = tokens.encode_all(batch["text"].to_pylist())
            n_tokens = pa.array([len(ids) // 4 for ids in coded], pa.int64())
            yield from pa.table({"digest": batch["digest"], "n_tokens": n_tokens}).to_batches()

    return texts.select("digest", "text").mapInArrow(count, "digest binary, n_tokens long")


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens. Missing counts are appended to ``cache_path``.

    Null texts count as empty (0 tokens). Repeated rows stay repeated; equal texts
    are encoded once. Null ids are kept. Other columns are left out. The texts move
    once, keyed by digest and id, so a text that a third of all rows share is no hot
    key; only digests are counted per text. ``cache_path`` must be shared storage.
    """
    small_batches(docs.sparkSession)
    version = tokenizer_version(tokenizer_path)
    content = docs.select(F.col(id_column).alias("id"), normalised(text_column).alias("text"))
    keyed = content.select("id", content_digest(F.col("text")).alias("digest"), "text")
    slim = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))

    missing = (
        slim.groupBy("digest")
        .agg(F.min("id").alias("first_id"))
        .join(stored_counts(docs, cache_path, version), "digest", "left_anti")
        .withColumnRenamed("digest", "missing")
    )
    here = (F.col("digest") == F.col("missing")) & F.col("id").eqNullSafe(F.col("first_id"))
    texts = keyed.join(missing, here, "left_semi")
    (
        encode_counts(texts, tokenizer_path)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
        .select(F.lit(version).alias("version"), "digest", "n_tokens")
        .write.mode("append")
        .parquet(cache_path)
    )
    counts = stored_counts(docs, cache_path, version)
    return slim.join(counts, "digest", "left").select(F.col("id").alias(id_column), "n_bytes", "n_tokens")
