"""Threshold gates over metric values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
OPERATORS = ["gt", "gte", "lt", "lte", "eq", "neq"]
BEHAVIORS = ["fail", "warn", "skip"]
EQUAL_WITHIN = 1e-6
# -----------------------------------------------------------------------------

GATE_SCHEMA = (
    "gate string, threshold_no int, metric string, op string, value double, "
    "required boolean, behavior string"
)


def parse_threshold(text: str) -> tuple[str, str, float]:
    """``metric:op:value`` to its parts; anything else is a ValueError."""
    parts = text.split(":")
    if len(parts) != 3:
        raise ValueError(f"threshold {text!r} is not metric:op:value")
    metric, op, value = (p.strip() for p in parts)
    if not metric or op not in OPERATORS:
        raise ValueError(f"threshold {text!r}: operator must be one of {', '.join(OPERATORS)}")
    return metric, op, float(value)


def gate_table(
    spark: SparkSession, gates: Iterable[tuple[str, str, Iterable[tuple[str, bool]]]]
) -> DataFrame:
    """A gate table from (gate, behavior, [(``metric:op:value``, required), …])."""
    rows = []
    for gate, behavior, thresholds in gates:
        if behavior not in BEHAVIORS:
            raise ValueError(f"behavior must be one of {', '.join(BEHAVIORS)}")
        for no, (text, required) in enumerate(thresholds):
            rows.append((gate, no, *parse_threshold(text), required, behavior))
    return spark.createDataFrame(rows, GATE_SCHEMA)


def compare(actual: Column, op: Column, value: Column) -> Column:
    """G1: the six comparisons; equality within one millionth. Unknown operators fail."""
    close = F.abs(actual - value) < EQUAL_WITHIN
    return (
        F.when(op == "gt", actual > value)
        .when(op == "gte", actual >= value)
        .when(op == "lt", actual < value)
        .when(op == "lte", actual <= value)
        .when(op == "eq", close)
        .when(op == "neq", ~close)
        .otherwise(F.lit(False))
    )


def threshold_results(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every threshold against ``metrics(run_id, metric, value)``, per run.

    A metric a run does not have, or a value that is not a number, fails. The
    metric table has one row per run and metric, a handful per run; the gate list
    is configuration and enters the plan as one array.
    """
    values = metrics.select("run_id", "metric", F.expr("try_cast(value AS double)").alias("actual"))
    per_run = values.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "actual"))).alias("known")
    )
    rows = gates.agg(F.collect_list(F.struct(*gates.columns)).alias("g"))
    paired = per_run.select("run_id", "known", F.explode(rows.scalar()).alias("t"))
    actual = F.element_at("known", F.col("t.metric"))
    checked = paired.select("run_id", "t.*", actual.alias("actual"))
    passed = F.coalesce(compare(F.col("actual"), F.col("op"), F.col("value")), F.lit(False))
    message = F.when(
        F.col("actual").isNull(), F.concat(F.lit("no value for "), F.col("metric"))
    ).otherwise(
        F.concat(
            F.col("metric"), F.lit(": "), F.format_string("%.4f", "actual"),
            F.when(passed, F.lit(" ")).otherwise(F.lit(" NOT ")), F.col("op"), F.lit(" "),
            F.format_string("%.4f", "value"),
        )
    )
    return checked.withColumns({"passed": passed, "message": message})


def gate_results(thresholds: DataFrame) -> DataFrame:
    """A gate passes when all its thresholds pass; required failures give the reasons."""
    failed = F.when(
        ~F.col("passed") & F.col("required"), F.struct("threshold_no", "message")
    )
    return thresholds.groupBy("run_id", "gate", "behavior").agg(
        F.bool_and("passed").alias("passed"),
        F.count(F.lit(1)).alias("total_thresholds"),
        F.count_if("passed").alias("passed_thresholds"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(failed)), lambda f: f["message"]), "; "
        ).alias("failure_reasons"),
    )


def overall(results: DataFrame) -> DataFrame:
    """A run fails only by a failed gate whose behavior is ``fail``."""
    return results.groupBy("run_id").agg(
        F.bool_and(F.col("passed") | (F.col("behavior") != "fail")).alias("passed"),
        F.count(F.lit(1)).alias("total_gates"),
        F.count_if("passed").alias("passed_gates"),
        F.count_if(~F.col("passed")).alias("failed_gates"),
        F.sum("total_thresholds").alias("total_thresholds"),
        F.sum("passed_thresholds").alias("passed_thresholds"),
        F.sum(F.col("total_thresholds") - F.col("passed_thresholds")).alias("failed_thresholds"),
    )
