"""Score answers as they arrive, and windowed latency means with a gate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.scores import exact_mean
from plumbline.operators.cost_metrics import latency_score
from plumbline.operators.evaluate import DEFAULT_METRICS, evaluate


def windowed_latency(
    latencies: DataFrame,
    window: str,
    slide: str | None = None,
    watermark: str | None = None,
    min_score: float = 0.5,
) -> DataFrame:
    """Mean latency score per window and stage of ``latencies(ts, stage, latency_ms)``,
    with ``passed`` when it is at least ``min_score``. Means are exact to the millionth.

    On a stream, give a ``watermark``: state is one buffer per open window and
    stage, and rows later than the watermark are dropped.
    """
    stamped = latencies.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = stamped.withWatermark("ts", watermark) if watermark else stamped
    scored = timed.select("ts", "stage", latency_score(F.col("latency_ms")).alias("score"))
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        scored.groupBy(frame.alias("w"), "stage")
        .agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("score")).alias("mean_score"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "stage",
            "n",
            "mean_score",
            (F.col("mean_score") >= min_score).alias("passed"),
        )
    )


def start_scoring(
    answers: DataFrame,
    results_path: str,
    checkpoint_path: str,
    metrics: Iterable[str] = tuple(DEFAULT_METRICS),
    k: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score a stream of answered questions into a Parquet results table.

    Scoring is a projection, so the stream keeps no state; the file sink commits
    each batch once, also after a restart.
    """
    scored = evaluate(answers, metrics, k=k)
    writer = scored.writeStream.format("parquet").option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start(results_path)


def start_windows(
    latencies: DataFrame,
    results_path: str,
    checkpoint_path: str,
    window: str,
    slide: str | None = None,
    watermark: str = "10 minutes",
    min_score: float = 0.5,
    trigger: dict | None = None,
) -> StreamingQuery:
    """X2 as a job: closed windows are appended to a Parquet table."""
    means = windowed_latency(latencies, window, slide, watermark, min_score)
    writer = means.writeStream.format("parquet").outputMode("append")
    return (
        writer.option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start(results_path)
    )
