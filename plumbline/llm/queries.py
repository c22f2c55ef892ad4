"""One registered query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    conversation_repair,
    decontamination,
    fingerprints,
    jaccard_join,
    language_id,
    learned_ann,
    merkle_manifest,
    secrets,
    site_templates,
    toxicity,
    warc,
)
from plumbline.llm.common import crc_remainder, read_table, shared_folder
from plumbline.llm.packing import pack_documents
from plumbline.llm.token_counts import count_tokens

TOKEN_LIMIT = 512


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)))
    model = language_id.learn(docs.where(crc_remainder("doc_id", 3) != 1).select("lang", "text"))
    found = language_id.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op2_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, with a cache that starts empty in each call."""
    docs = read_table(spark, sf_dir, "documents")
    cache = shared_folder(spark, "token-counts")
    counts = count_tokens(docs, cache, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(read_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = labels.where(crc_remainder("doc_id", 5) != 0)
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = toxicity.score(docs, toxicity.learn(docs, learned))
    return scored.select(
        "doc_id",
        held_out,
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read_table(spark, sf_dir, "documents")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back."""
    archives = shared_folder(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), archives)
    return warc.page_digests(warc.assemble(warc.read_records(spark, archives)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repaired(rows, conversation_repair.Repair(conversation_repair.damage(rows)))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.successors(docs, fingerprints.rarity(fingerprints.entropy_counts(docs)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of the untampered documents, folded with the leaves of the tampered ones."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(crc_remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select(
        "doc_id",
        "source",
        merkle_manifest.leaf_digest(*others, F.col("text")).alias("leaf"),
        merkle_manifest.leaf_digest(*others, changed).alias("told"),
    )
    made = merkle_manifest.manifest(leaves, F.col("leaf"), F.col("source"), [F.col("doc_id")])
    folded = merkle_manifest.folded_root(F.col("row.told"), F.col("path"))
    proved = made.select("row.doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_learned_ann": op2_learned_ann,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_site_templates": op7_site_templates,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fingerprints": op12_fingerprints,
    "op13_merkle_manifest": op13_merkle_manifest,
}
