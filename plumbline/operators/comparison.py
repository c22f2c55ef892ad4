"""H1 to H5: compare two runs, list the run history, find the latest run, delete runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.evaluate import LOWER_IS_BETTER

# --- fixed values ------------------------------------------------------------
MIN_CHANGE = 0.001
# -----------------------------------------------------------------------------


def compare_runs(
    means: DataFrame, baseline: str, experiment: str, metrics: Iterable[str] | None = None
) -> DataFrame:
    """H1: metric means of two runs side by side, a missing metric counted as 0.

    ``means(run_id, metric, mean_score)``. A higher value counts as better for
    every metric; ``direction`` tells where that should be read the other way.
    """
    rows = means if metrics is None else means.where(F.col("metric").isin(*metrics))
    base = rows.where(F.col("run_id") == baseline).select(
        "metric", F.col("mean_score").alias("baseline")
    )
    test = rows.where(F.col("run_id") == experiment).select(
        "metric", F.col("mean_score").alias("experiment")
    )
    both = base.join(test, "metric", "full_outer").na.fill(0.0, ["baseline", "experiment"])
    delta = F.col("experiment") - F.col("baseline")
    return both.withColumns(
        {
            "delta": delta,
            "verdict": F.when(delta > MIN_CHANGE, "improved")
            .when(delta < -MIN_CHANGE, "regressed")
            .otherwise("unchanged"),
            "direction": F.when(
                F.col("metric").isin(*LOWER_IS_BETTER), "lower_is_better"
            ).otherwise("higher_is_better"),
        }
    )


def compare_overall(means: DataFrame, baseline: str, experiment: str) -> DataFrame:
    """H2: one row with the mean over the metrics both runs have, and the winner.

    The winner is null when the runs share no metric.
    """
    base = means.where(F.col("run_id") == baseline).select(
        "metric", F.col("mean_score").alias("b")
    )
    test = means.where(F.col("run_id") == experiment).select(
        "metric", F.col("mean_score").alias("e")
    )
    scores = base.join(test, "metric").agg(
        F.count(F.lit(1)).alias("common_metrics"),
        F.avg("b").alias("baseline_overall"),
        F.avg("e").alias("experiment_overall"),
    )
    b, e = F.col("baseline_overall"), F.col("experiment_overall")
    winner = (
        F.when(F.col("common_metrics") == 0, F.lit(None).cast("string"))
        .when(e > b, F.lit(experiment))
        .when(e < b, F.lit(baseline))
        .otherwise(F.lit("tie"))
    )
    return scores.withColumns({"delta": e - b, "winner": winner})


def compare_counts(results: DataFrame, baseline: str, experiment: str) -> DataFrame:
    """H3: results and errors of both runs, one row, one pass over the two runs."""
    is_base = F.col("run_id") == baseline
    bad = F.col("error_type").isNotNull()
    return results.where(F.col("run_id").isin(baseline, experiment)).agg(
        F.count_if(is_base).alias("baseline_results"),
        F.count_if(~is_base).alias("experiment_results"),
        F.count_if(is_base & bad).alias("baseline_errors"),
        F.count_if(~is_base & bad).alias("experiment_errors"),
    )


def run_history(
    runs: DataFrame,
    sort_by: str = "date",
    ascending: bool = False,
    limit: int | None = None,
    search: str | None = None,
    output: str | None = None,
) -> DataFrame:
    """H4: list runs, newest or highest first.

    ``runs(run_id, created_at, dataset_path, output, errors, score, cost)``.
    ``search`` looks in the id and the dataset path, in any case.
    """
    keys = {"date": "created_at", "score": "score", "cost": "cost"}
    if sort_by not in keys:
        raise ValueError(f"sort_by must be one of {', '.join(keys)}")
    rows = runs
    if output:
        rows = rows.where(F.lower("output") == output.lower())
    if search:
        needle = F.lit(search.lower())
        rows = rows.where(
            F.contains(F.lower("run_id"), needle)
            | F.coalesce(F.contains(F.lower("dataset_path"), needle), F.lit(False))
        )
    key = F.col(keys[sort_by])
    order = key.asc_nulls_first() if ascending else key.desc_nulls_last()
    rows = rows.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("ok"))
    listed = rows.orderBy(order, "run_id")
    return listed if limit is None else listed.limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """H5: the newest run (a top-1)."""
    return runs.orderBy(F.col("created_at").desc_nulls_last(), "run_id").limit(1)
