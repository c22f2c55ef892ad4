"""Run status, totals, metric means, bands, errors and examples.

Input is the wide results table of one or more runs: ``run_id``, ``item_id``,
one column per metric, ``error_type`` (null for a good item), token counts and
``latency_ms``. All of it is plain partial aggregation on small keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scores import exact_mean
from plumbline.operators.evaluate import LOWER_IS_BETTER

# --- fixed values: score bands -----------------------------------------------
GOOD, FAIR = 0.8, 0.5
# -----------------------------------------------------------------------------


def run_status(results: DataFrame) -> DataFrame:
    """A4: items, successes and failures per run."""
    bad = F.col("error_type").isNotNull()
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(~bad).alias("successful_evaluations"),
        F.count_if(bad).alias("failed_evaluations"),
    )


def run_totals(results: DataFrame) -> DataFrame:
    """A5: totals per run; missing tokens count 0, missing latencies do not count."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.sum(tokens).alias("total_tokens"),
        F.avg("latency_ms").alias("average_latency_ms"),
    )


def metric_means(long: DataFrame) -> DataFrame:
    """A5: mean per run and metric from the long table, exact to the millionth. Failed items are zeros in it;
    filter them out first to leave them aside."""
    return long.groupBy("run_id", "metric").agg(
        exact_mean(F.col("score")).alias("mean_score"), F.count("score").alias("n")
    )


def wide_means(results: DataFrame, metrics: Iterable[str], exclude_failed: bool = False) -> DataFrame:
    """A5 without going long: one aggregation over the wide table, then unpivot of one
    row per run. This is the form to use on large runs."""
    metrics = list(metrics)
    rows = results.where(F.col("error_type").isNull()) if exclude_failed else results
    means = rows.groupBy("run_id").agg(*[exact_mean(F.col(m)).alias(m) for m in metrics])
    return means.unpivot("run_id", metrics, "metric", "mean_score")


def flat_metrics(results: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Metric means and the three counters as (run_id, metric, value)."""
    counters = ["total_items", "successful_evaluations", "failed_evaluations"]
    status = run_status(results).select("run_id", *[F.col(c).cast("double") for c in counters])
    return (
        wide_means(results, metrics)
        .withColumnRenamed("mean_score", "value")
        .unionByName(status.unpivot("run_id", counters, "metric", "value"))
    )


def flatten_summary(summary: DataFrame, column: str = "metrics_summary") -> DataFrame:
    """A6 for stored nested summaries: MAP<STRING, MAP<STRING, DOUBLE>> to ``key_sub`` rows."""
    outer = summary.select("run_id", F.explode(column).alias("key", "inner"))
    return outer.select("run_id", "key", F.explode("inner").alias("sub", "value")).select(
        "run_id", F.concat_ws("_", "key", "sub").alias("metric"), "value"
    )


def _band(score: str):
    return (
        F.when(F.col(score) >= GOOD, "good").when(F.col(score) >= FAIR, "fair").otherwise("poor")
    )


def metric_bands(means: DataFrame) -> DataFrame:
    """A band per metric, and per run the mean of the means as metric ``overall``."""
    overall = means.groupBy("run_id").agg(F.avg("mean_score").alias("score"))
    rows = means.select("run_id", "metric", F.col("mean_score").alias("score")).unionByName(
        overall.withColumn("metric", F.lit("overall"))
    )
    worse = F.col("metric").isin(*LOWER_IS_BETTER)
    return rows.withColumns(
        {
            "band": _band("score"),
            "direction": F.when(worse, "lower_is_better").otherwise("higher_is_better"),
        }
    )


def error_breakdown(results: DataFrame) -> DataFrame:
    """Errors per run and type."""
    return (
        results.where(F.col("error_type").isNotNull())
        .groupBy("run_id", F.coalesce("error_type", F.lit("Unknown")).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_examples(results: DataFrame, max_examples: int = 10) -> DataFrame:
    """K2: the first results in item order (a top-n, not a sort of the table)."""
    return results.orderBy("item_id", "run_id").limit(max_examples)
