"""Latency score, token score and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: USD per million tokens (provider, model, input, output) ---
PRICES = [
    ("openai", "gpt-4o", 2.50, 10.00),
    ("openai", "gpt-4o-mini", 0.15, 0.60),
    ("openai", "gpt-4-turbo", 10.00, 30.00),
    ("openai", "gpt-3.5-turbo", 0.50, 1.50),
    ("anthropic", "claude-3-opus", 15.00, 75.00),
    ("anthropic", "claude-3-sonnet", 3.00, 15.00),
    ("anthropic", "claude-3-haiku", 0.25, 1.25),
    ("gemini", "gemini-pro", 0.50, 1.50),
    ("gemini", "gemini-1.5-pro", 3.50, 10.50),
    ("groq", "llama-3-70b", 0.59, 0.79),
    ("groq", "llama-3-8b", 0.05, 0.08),
]
LATENCY_THRESHOLD_MS = 1000.0
TOKEN_BUDGET = 20000.0
# -----------------------------------------------------------------------------

NO_LATENCY = "latency is missing"


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRICES, "provider string, model string, input_rate double, output_rate double"
    )


def latency_score(ms: Column, threshold_ms: float = LATENCY_THRESHOLD_MS) -> Column:
    """1 at 0 ms, 0.5 at the threshold, 0 from twice the threshold; negative or missing is 0."""
    score = F.greatest(F.lit(0.0), 1.0 - ms / (2.0 * threshold_ms))
    return F.when(ms.isNull() | (ms < 0), F.lit(0.0)).otherwise(score)


def latency_error(ms: Column) -> Column:
    return F.when(ms.isNull(), F.lit(NO_LATENCY))


def total_tokens(prompt: Column, completion: Column) -> Column:
    return F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))


def token_score(prompt: Column, completion: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - total_tokens(prompt, completion) / TOKEN_BUDGET)


def with_cost(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Add ``cost_usd``; an unknown provider or model costs 0.

    The built-in price list has eleven rows and is broadcast. A caller's own
    list is joined without a hint, so Spark sizes it before it chooses.
    """
    table = F.broadcast(price_table(df.sparkSession)) if prices is None else prices
    million = 1_000_000.0
    cost = (
        F.coalesce("prompt_tokens", F.lit(0)) / million * F.col("input_rate")
        + F.coalesce("completion_tokens", F.lit(0)) / million * F.col("output_rate")
    )
    return (
        df.join(table, ["provider", "model"], "left")
        .withColumn("cost_usd", F.coalesce(cost, F.lit(0.0)))
        .drop("input_rate", "output_rate")
    )
