"""Queries that write tables in a file format and read them back: sources S1 to S3 and S9, run store K1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import views
from plumbline.plans.metric_queries import rounded
from plumbline.session import scratch_folder
from plumbline.sources import corpus, reports
from plumbline.sources import datasets as ds

FIELDS = ["question", "ground_truth", "context"]


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select(*FIELDS)


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in files that hold one JSON array each."""
    path = scratch_folder(spark, "json-items")
    ds.write_json(_written(spark, sf_dir), path)
    return ds.read_json(spark, path).select(*FIELDS)


def jsonl_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as JSON lines."""
    path = scratch_folder(spark, "jsonl-items")
    _written(spark, sf_dir).write.json(path)
    items, rejected = ds.read_jsonl(spark, path)
    ds.require_clean(rejected)
    return items.select(*FIELDS)


def csv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: items as quoted CSV whose fields hold line ends and quotes."""
    path = scratch_folder(spark, "csv-items")
    _written(spark, sf_dir).write.options(header=True, escape='"', quoteAll=True).csv(path)
    return ds.read_csv(spark, path).select(*FIELDS)


def file_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a text file of its own, read as a corpus."""
    path = scratch_folder(spark, "corpus")
    views.table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    read = corpus.read_corpus(spark, path)
    return read.select(
        F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"),
        F.rtrim("content", F.lit("\n")).alias("content"),
        F.col("metadata")["extension"].alias("extension"),
    )


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: two scored runs in a run store, as its history tells them."""
    store = scratch_folder(spark, "runs")
    scored = views.scored_runs(spark, sf_dir)
    for run in ("logged", "echo"):
        settings = {"dataset_path": f"data/{run}", "output": "json"}
        one = scored.where(F.col("run_id") == run).drop("run_id")
        reports.save_run(one, store, views.RUN_METRICS, run, "2026-01-01T00:00:00+00:00", settings)
    return reports.read_runs(spark, store).select(
        "run_id", "total", "errors", "dataset_path", rounded("score")
    )


QUERIES = {
    "json_items": json_items,
    "jsonl_items": jsonl_items,
    "csv_items": csv_items,
    "file_corpus": file_corpus,
    "saved_runs": saved_runs,
}
