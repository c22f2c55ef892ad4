"""Run stores, report files and exports.

The native form of a run is Parquet: ``results``, ``errors`` and exact ``sums`` of each
saved batch in a folder of their own, and a commit of one row that names the folders of
a run. History and comparison read commits and sums, never the results. Report JSON
files are read for diagnosis and history, and a summary can be written as JSON.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scores import exact_mean, exact_sum, mean_of
from plumbline.operators import summary as sm

_ITEM_FIELDS = (
    "question STRING, answer STRING, ground_truth STRING, contexts ARRAY<STRING>, "
    "metrics MAP<STRING, DOUBLE>, metadata MAP<STRING, STRING>"
)
_ITEM = f"STRUCT<{_ITEM_FIELDS}>"
REPORT_SCHEMA = (
    "report_id STRING, created_at STRING, config STRING, "
    "summary STRUCT<total_items: BIGINT, successful_evaluations: BIGINT, "
    "failed_evaluations: BIGINT, metrics_summary: MAP<STRING, DOUBLE>, total_tokens: BIGINT, "
    "average_latency_ms: DOUBLE>, metadata STRING, "
    f"results ARRAY<{_ITEM}>, errors ARRAY<STRUCT<error: STRING, error_type: STRING>>"
)


def save_run(
    results: DataFrame,
    store: str,
    metrics: Iterable[str],
    run_id: str | None = None,
    created_at: str | None = None,
    config: dict | None = None,
) -> str:
    """K1: write one run to a store folder; returns its id.

    ``results`` is scored items with ``error_type``; the failed ones also go to
    ``errors``. Results, errors and sums become visible together, by the commit that is
    written last: a save that fails in between leaves no run, and the next save of the
    run replaces what there was.
    """
    spark = results.sparkSession
    run_id = run_id or str(uuid.uuid4())
    created_at = created_at or datetime.now(timezone.utc).isoformat()
    before = _attempts(spark, store).get(run_id, [])
    attempt = _write_attempt(results, store, list(metrics), run_id)
    _commit(spark, store, run_id, [attempt], created_at, config or {})
    for old in before:
        _delete(spark, f"{store}/attempts/{old}")
    return run_id


def add_results(results: DataFrame, store: str, metrics: Iterable[str], run_id: str) -> None:
    """Add a batch of scored items to a run; its sums are merged, what is stored is not read again."""
    spark = results.sparkSession
    known = _commits(spark, store).where(F.col("run_id") == run_id).first()
    if known is None:
        raise ValueError(f"no run {run_id!r}")
    attempt = _write_attempt(results, store, list(metrics), run_id)
    created_at = known["created_at"].replace(tzinfo=timezone.utc).isoformat()
    _commit(spark, store, run_id, [*known["attempts"], attempt], created_at, json.loads(known["config"]))


def _write_attempt(results: DataFrame, store: str, metrics: list[str], run_id: str) -> str:
    """Results, errors and sums of some items in a folder of their own, which no reader looks at yet."""
    attempt = uuid.uuid4().hex
    folder = f"{store}/attempts/{attempt}"
    results.withColumn("run_id", F.lit(run_id)).write.parquet(f"{folder}/results")
    saved = results.sparkSession.read.parquet(f"{folder}/results")
    saved.where(F.col("error_type").isNotNull()).select("run_id", "item_id", "error_type").write.parquet(f"{folder}/errors")
    _sums(saved, metrics).write.parquet(f"{folder}/sums")
    return attempt


#: Names of the sums that are no metric.
ITEMS, ERRORS, TOKENS, LATENCY, COST = "#items", "#errors", "#tokens", "#latency_ms", "#cost_usd"


def _sums(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(run_id, metric, n, total): exact sums in whole billionths, which add up over batches."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    cost = F.col("cost_usd") if "cost_usd" in results.columns else F.lit(0.0)
    values = {
        **{m: F.col(m).cast("double") for m in metrics},
        ITEMS: F.lit(0.0),
        ERRORS: F.when(F.col("error_type").isNotNull(), F.lit(0.0)),
        LATENCY: F.col("latency_ms").cast("double"),
        COST: cost.cast("double"),
    }
    each = [F.struct(F.lit(m).alias("metric"), F.count(v).alias("n"), exact_sum(v).alias("total")) for m, v in values.items()]
    each.append(F.struct(F.lit(TOKENS).alias("metric"), F.count(F.lit(1)).alias("n"), F.sum(tokens).cast("decimal(34,0)").alias("total")))
    return results.groupBy("run_id").agg(F.array(*each).alias("sums")).select("run_id", F.inline("sums"))


_COMMIT = "run_id STRING, attempts ARRAY<STRING>, created_at TIMESTAMP, dataset_path STRING, output STRING, config STRING, committed BIGINT"


def _commit(spark: SparkSession, store: str, run_id: str, attempts: list[str], created_at: str, settings: dict) -> None:
    """One row in one file, which appears as a whole; the last commit of a run is the one that holds."""
    path = settings.get("dataset_path")
    row = (run_id, attempts, None if path is None else str(path), str(settings.get("output", "json")), json.dumps(settings, default=str), time.time_ns())
    made = spark.createDataFrame([row], "run_id STRING, attempts ARRAY<STRING>, dataset_path STRING, output STRING, config STRING, committed BIGINT")
    stamped = made.withColumn("created_at", F.lit(created_at).cast("timestamp"))
    stamped.coalesce(1).write.mode("append").parquet(f"{store}/commits")


def _commits(spark: SparkSession, store: str) -> DataFrame:
    """The last commit of each run that is not deleted (one without attempts deletes)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/commits")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _COMMIT)
    every = spark.read.schema(_COMMIT).parquet(f"{store}/commits")
    last = every.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "run_id"]), "committed").alias("c"))
    return last.select("run_id", "c.*").where(F.size("attempts") > 0)


def _attempts(spark: SparkSession, store: str) -> dict[str, list[str]]:
    """Folders of each run: one entry for each batch that was saved."""
    return {r["run_id"]: r["attempts"] for r in _commits(spark, store).select("run_id", "attempts").collect()}


def _stored(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    paths = [f"{store}/attempts/{a}/{table}" for listed in _attempts(spark, store).values() for a in listed]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_results(spark: SparkSession, store: str) -> DataFrame:
    """Scored items of all runs of a store."""
    found = _stored(spark, store, "results")
    if found is None:
        raise ValueError(f"no runs in {store}")
    return found


def read_errors(spark: SparkSession, store: str) -> DataFrame:
    """(run_id, item_id, error_type) of the failed items of all runs of a store."""
    found = _stored(spark, store, "errors")
    if found is None:
        raise ValueError(f"no runs in {store}")
    return found


def read_means(spark: SparkSession, store: str) -> DataFrame:
    """(run_id, metric, mean_score, n) of all runs, merged from their sums; results are not read."""
    found = _stored(spark, store, "sums")
    if found is None:
        return spark.createDataFrame([], "run_id STRING, metric STRING, mean_score DOUBLE, n BIGINT")
    merged = _merged(found).where(~F.startswith("metric", F.lit("#")))
    return merged.select("run_id", "metric", mean_of(F.col("total"), F.col("n")).alias("mean_score"), "n")


def _merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy("run_id", "metric").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(34,0)").alias("total"))


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """S12 on the native store: one row per run, from commits and sums alone."""
    sums = _stored(spark, store, "sums")
    if sums is None:
        sums = spark.createDataFrame([], "run_id STRING, metric STRING, n BIGINT, total DECIMAL(34,0)")
    merged = _merged(sums).withColumn("mean", mean_of(F.col("total"), F.col("n")))
    is_metric = ~F.startswith("metric", F.lit("#"))

    def only(name: str, what: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col(what)))

    means = F.array_sort(F.collect_list(F.when(is_metric, F.struct("metric", "mean"))))
    totals = merged.groupBy("run_id").agg(
        F.coalesce(only(ITEMS, "n"), F.lit(0)).alias("total"),
        F.coalesce(only(ERRORS, "n"), F.lit(0)).alias("errors"),
        only(TOKENS, "total").cast("long").alias("total_tokens"),
        only(LATENCY, "mean").alias("average_latency_ms"),
        F.map_from_entries(means).alias("metrics_summary"),
        exact_mean(F.when(is_metric, F.col("mean"))).alias("score"),
        (only(COST, "total").cast("double") / 1e9).alias("cost"),
    )
    commits = _commits(spark, store).select("run_id", "created_at", "dataset_path", "output", "config")
    empty = {"total": 0, "errors": 0}
    return commits.join(totals, "run_id", "left").na.fill(empty)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report JSON files, newest first. Unreadable files are skipped; reports
    without an id take the file name."""
    raw = (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.withColumn("report_id", F.coalesce("report_id", name)).withColumn(
        "created_at", F.try_to_timestamp("created_at")
    ).orderBy(F.col("created_at").desc_nulls_last(), "report_id")


def report_runs(reports: DataFrame) -> DataFrame:
    """Reports in the layout of the run history."""
    values = F.map_values("summary.metrics_summary")
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))
    return reports.select(
        F.col("report_id").alias("run_id"),
        "created_at",
        F.get_json_object("config", "$.dataset.path").alias("dataset_path"),
        F.coalesce(F.get_json_object("config", "$.report.output"), F.lit("json")).alias("output"),
        F.coalesce(F.size("errors"), F.lit(0)).alias("errors"),
        mean.alias("score"),
        F.lit(0.0).alias("cost"),
    )


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    """Result items for diagnosis, from an object with ``results`` or a bare list."""
    rows = spark.read.schema(f"{_ITEM_FIELDS}, results ARRAY<{_ITEM}>").option("multiLine", True).json(path)
    names = ["question", "answer", "ground_truth", "contexts", "metrics", "metadata"]
    bare = F.when(F.col("question").isNotNull(), F.array(F.struct(*names)))
    return rows.select(F.inline(F.coalesce("results", bare)))


def delete_runs(spark: SparkSession, store: str, run_ids: Iterable[str]) -> int:
    """H5: delete the named runs; returns how many there were. They are gone at once; then their files go."""
    known, removed = _attempts(spark, store), 0
    for run_id in run_ids:
        if not run_id or "/" in run_id or run_id in (".", ".."):
            raise ValueError(f"not a run id: {run_id!r}")
        attempts = known.pop(run_id, None)
        if attempts is None:
            continue
        _commit(spark, store, run_id, [], datetime.now(timezone.utc).isoformat(), {})
        for attempt in attempts:
            _delete(spark, f"{store}/attempts/{attempt}")
        removed += 1
    return removed


def export_summary(
    results: DataFrame, metrics: Iterable[str], path: str, max_examples: int = 10
) -> None:
    """K2: summary tables and the first examples, as JSON lines under ``path``."""
    metrics = list(metrics)
    sm.run_status(results).write.mode("overwrite").json(f"{path}/summary")
    sm.wide_means(results, metrics).write.mode("overwrite").json(f"{path}/metrics")
    sm.first_examples(results, max_examples).write.mode("overwrite").json(f"{path}/examples")
    sm.error_breakdown(results).write.mode("overwrite").json(f"{path}/error_breakdown")


def export_cases(cases: DataFrame, path: str, kind: str = "jsonl") -> None:
    """K3: a synthetic test set. ``jsonl`` writes cases; ``json`` and ``huggingface`` add the
    counts per type beside them (``huggingface`` writes the cases as Parquet)."""
    if kind not in ("jsonl", "json", "huggingface"):
        raise ValueError("kind is 'jsonl', 'json' or 'huggingface'")
    if kind == "jsonl":
        cases.write.mode("overwrite").json(path)
        return
    data = cases.write.mode("overwrite")
    if kind == "json":
        data.json(f"{path}/test_cases")
    else:
        data.parquet(f"{path}/data")
    counts = cases.groupBy("test_type").agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").json(f"{path}/type_counts")


def export_comparison(compared: DataFrame, path: str, kind: str = "csv") -> None:
    """K4: a comparison table as CSV or Parquet."""
    writer = compared.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("kind is 'csv' or 'parquet'")
