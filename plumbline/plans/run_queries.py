"""Registered queries for diagnosis, gates, comparison, history and datasets (D, G, H, S, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import chunk_checks as cc
from plumbline.operators import comparison as cmp
from plumbline.operators import diagnosis as dg
from plumbline.operators import gates as gt
from plumbline.operators import summary
from plumbline.plans import views
from plumbline.plans.metric_queries import rounded
from plumbline.sources import datasets as ds
from plumbline.streaming.scoring import windowed_latency

GATES = [
    ("quality", "fail", [("faithfulness:gte:0.5", True), ("f1_score:gt:0.05", True)]),
    ("speed", "warn", [("latency:gte:0.9", True), ("token_count:gt:0.9", False)]),
    ("sanity", "fail", [("exact_match:lte:1", True), ("total_items:neq:0", True)]),
    ("unknown", "skip", [("no_such_metric:gt:0", True), ("exact_match:eq:0", False)]),
]


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.diagnose(views.scored_runs(spark, sf_dir), views.RUN_METRICS)


def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dg.component_scores(views.scored_runs(spark, sf_dir), views.RUN_METRICS)
    return df.select(
        "run_id",
        "item_id",
        F.size("retrieval_scores").cast("bigint").alias("n_retrieval"),
        F.size("generation_scores").cast("bigint").alias("n_generation"),
        rounded(F.col("retrieval_scores")["context_recall"], "context_recall"),
        rounded(F.col("generation_scores")["faithfulness"], "faithfulness"),
        F.col("context_count").cast("bigint").alias("context_count"),
        F.array_join(F.transform("context_lengths", lambda n: n.cast("string")), ",").alias(
            "context_lengths"
        ),
        F.col("answer_length").cast("bigint").alias("answer_length"),
    )


def diag_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dg.failure_rows(_diagnosed(spark, sf_dir), "run_id", "item_id")
    return rows.select(
        "run_id", "item_id", F.col("seq").cast("bigint").alias("seq"), "mode", "blame",
        "confidence", "reason",
    )


def diag_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).select(
        "run_id", "item_id", "blame.target", "blame.confidence", "blame.reason"
    )


def _issues(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key,
        F.col("ctx_i").cast("bigint").alias("ctx_i"),
        F.col("ctx_j").cast("bigint").alias("ctx_j"),
        rounded("measure"),
    )


def diag_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(cc.overlapping(views.items(spark, sf_dir).unionByName(
        views.chunk_items(spark, sf_dir), allowMissingColumns=True), "item_id"), "item_id")


def diag_chunk_char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(cc.excess_overlap(views.chunk_items(spark, sf_dir), "item_id"), "item_id")


def diag_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(cc.uneven_sizes(views.items(spark, sf_dir), "item_id"), "item_id")


def diag_chunk_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(cc.size_deviation(views.chunk_items(spark, sf_dir), "item_id"), "item_id")


def diag_chunk_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cc.small_chunks(views.chunk_items(spark, sf_dir), "item_id", chunk_size="chunk_size")
    plain = cc.small_chunks(views.items(spark, sf_dir), "item_id")
    return _issues(found.unionByName(plain), "item_id")


def diag_content_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cc.content_gaps(views.echo_items(spark, sf_dir), "item_id")
    prior = views.items(spark, sf_dir).withColumn("contexts", F.slice("contexts", 1, 1))
    first_only = cc.content_gaps(prior, "item_id")
    return found.withColumn("contexts_seen", F.lit("all")).unionByName(
        first_only.withColumn("contexts_seen", F.lit("first"))
    ).select("item_id", "contexts_seen", rounded("measure"), "description")


def diag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.health(_diagnosed(spark, sf_dir)).select(
        "total_items", "healthy_items", rounded("overall_health"), "health_label"
    )


def diag_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dg.mode_counts(_diagnosed(spark, sf_dir))


def diag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dg.blame_counts(_diagnosed(spark, sf_dir))
    return dg.blame_share(counts).select("target", "n", rounded("share"))


def diag_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = dg.blame_counts(_diagnosed(spark, sf_dir))
    return dg.recommendations(counts).select(
        F.col("position").cast("bigint").alias("position"), "recommendation"
    )


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = summary.flat_metrics(views.scored_runs(spark, sf_dir), views.RUN_METRICS)
    return gt.threshold_results(gt.gate_table(spark, GATES), metrics)


def gate_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _thresholds(spark, sf_dir).select(
        "run_id", "gate", "metric", "op", "value", rounded("actual"), "passed"
    )


def gate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.gate_results(_thresholds(spark, sf_dir)).select(
        "run_id", "gate", "behavior", "passed", "total_thresholds", "passed_thresholds",
        (F.col("failure_reasons") != "").alias("has_reasons"),
    )


def gate_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.overall(gt.gate_results(_thresholds(spark, sf_dir)))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The echo run lacks latency, the logged run exact_match: one-sided metrics exist.
    means = summary.wide_means(views.scored_runs(spark, sf_dir), views.RUN_METRICS)
    echo, metric = F.col("run_id") == "echo", F.col("metric")
    return means.where(~(echo & (metric == "latency")) & ~(~echo & (metric == "exact_match")))


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cmp.compare_runs(_means(spark, sf_dir), "logged", "echo")
    return df.select(
        "metric", rounded("baseline"), rounded("experiment"), rounded("delta"), "verdict",
        "direction",
    )


def compare_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cmp.compare_overall(_means(spark, sf_dir), "logged", "echo")
    return df.select(
        "common_metrics", rounded("baseline_overall"), rounded("experiment_overall"),
        rounded("delta"), "winner",
    )


def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cmp.compare_counts(views.scored_runs(spark, sf_dir), "logged", "echo")


def _listed(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"),
        "dataset_path", "errors", rounded("score"), F.round("cost", 9).alias("cost"), "status",
    )


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(
        cmp.run_history(
            views.runs(spark, sf_dir), sort_by="score", limit=20, search="A/", output="json"
        )
    )


def run_history_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(cmp.run_history(views.runs(spark, sf_dir), sort_by="cost", ascending=True, limit=15))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = cmp.run_history(views.runs(spark, sf_dir))
    return _listed(cmp.latest_run(runs))


def map_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under foreign field names, mapped to the item schema."""
    raw = views.items(spark, sf_dir).select(
        F.when(F.col("conv_id") % 3 != 0, F.col("question")).alias("query"),
        F.col("question").alias("prompt"),
        F.when(F.col("conv_id") % 2 == 0, F.array("ground_truth")).alias("answers"),
        F.col("answer").alias("response"),
        F.col("context").alias("passage"),
        F.col("item_id").alias("source_row"),
    )
    mapped = ds.map_fields(raw)
    return mapped.select(
        F.get_json_object("metadata", "$.source_row").alias("source_row"),
        "question",
        "ground_truth",
        "context",
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    pages = views.table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("page"), F.concat(F.lit(" \n"), "text", F.lit(" ")).alias("text")
    )
    made = ds.page_items(pages)
    return made.select(
        "question",
        "context",
        F.get_json_object("metadata", "$.page").cast("bigint").alias("page"),
        F.get_json_object("metadata", "$.source").alias("source"),
    )


def _raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    code = F.col("conv_id") + F.col("turn")
    return turns.select(
        views.row_key("conv_id", "turn").alias("item_id"),
        F.when(code % 7 == 0, F.lit("  \n"))
        .when(code % 11 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
        .alias("question"),
        F.when(code % 5 == 0, F.lit(" ")).otherwise(F.col("text")).alias("ground_truth"),
        F.when(code % 3 == 0, F.lit("")).otherwise(F.col("role")).alias("context"),
    )


def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ds.validate_items(_raw_items(spark, sf_dir))
    return good.select("item_id", "question", "ground_truth", "context")


def rejected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = ds.validate_items(_raw_items(spark, sf_dir))
    return bad.select("item_id", F.array_join("errors", "; ").alias("errors"))


def sample_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.sample_items(views.items(spark, sf_dir), 50).select("item_id", "question")


def latency_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed means of the streaming job, run as a batch."""
    df = windowed_latency(views.latencies(spark, sf_dir), "6 hours", min_score=0.97)
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "stage", "n", rounded("mean_score"), "passed",
    )


QUERIES = {
    "component_scores": component_scores,
    "diag_failures": diag_failures,
    "diag_blame": diag_blame,
    "diag_chunk_overlap": diag_chunk_overlap,
    "diag_chunk_char_overlap": diag_chunk_char_overlap,
    "diag_chunk_sizes": diag_chunk_sizes,
    "diag_chunk_deviation": diag_chunk_deviation,
    "diag_chunk_small": diag_chunk_small,
    "diag_content_gap": diag_content_gap,
    "diag_summary": diag_summary,
    "diag_mode_counts": diag_mode_counts,
    "diag_share": diag_share,
    "diag_recommend": diag_recommend,
    "gate_thresholds": gate_thresholds,
    "gate_results": gate_results,
    "gate_overall": gate_overall,
    "compare_runs": compare_runs,
    "compare_overall": compare_overall,
    "compare_counts": compare_counts,
    "run_history": run_history,
    "run_history_cost": run_history_cost,
    "latest_run": latest_run,
    "map_fields": map_fields,
    "page_items": page_items,
    "validate_items": validate_items,
    "rejected_items": rejected_items,
    "sample_items": sample_items,
    "latency_windowed": latency_windowed,
}
