"""Component scores, failure rules, blame and report.

Rules are a fixed array of conditions on one row, so an item costs a projection;
counting needs one aggregation on a handful of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let, text_or_empty, texts_or_empty
from plumbline.operators.evaluate import METRIC_GROUPS

# --- fixed values: rule thresholds and confidences ---------------------------
LOW_PRECISION = 0.3
LOW_RECALL = 0.3
LOW_FAITHFULNESS = 0.4
LOW_RELEVANCY = 0.4
SHORT_ANSWER = 10
LENGTH_RATIO = 5.0
REPORT_CONFIDENCE = 0.3
MAX_RECOMMENDATIONS = 5
GOOD_HEALTH, FAIR_HEALTH = 0.8, 0.5
TARGETS = ["retrieval", "generation", "chunking", "dataset", "unknown"]
# -----------------------------------------------------------------------------

# Advice per blamed component, in the order it is given.
ADVICE = {
    "retrieval": [
        "Check that the index covers the questions and is up to date.",
        "Try another embedding model or a hybrid of words and vectors.",
        "Retrieve more contexts and re-rank them.",
        "Rewrite or expand queries before searching.",
        "Add filters on document metadata.",
    ],
    "generation": [
        "Tell the model to answer from the contexts only.",
        "Lower the sampling temperature.",
        "Use a stronger model.",
        "Ask for citations of the contexts.",
        "Add an answer check before returning.",
    ],
    "chunking": [
        "Use one chunk size throughout.",
        "Let chunks overlap by a tenth to a fifth.",
        "Split at paragraph or sentence ends.",
        "Drop or merge very small chunks.",
        "Keep tables and lists in one piece.",
    ],
    "dataset": [
        "Review the reference answers.",
        "Remove ambiguous questions.",
        "Add the missing ground-truth contexts.",
    ],
    "unknown": [
        "Look at the failing items by hand.",
        "Add metrics that separate the components.",
        "Log the contexts and answers in full.",
    ],
}
HEALTHY = "No significant failures found."

_FAILURE = (
    "array<struct<mode:string,blame:string,confidence:double,reason:string>>"
)


def component_scores(results: DataFrame, metrics: list[str]) -> DataFrame:
    """The retrieval and generation score maps, context and answer sizes.

    Keeps the columns of ``results``; a metric that is null (absent or not
    numeric) is left out of its map.
    """

    def as_map(names: list[str]) -> Column:
        entries = [
            F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names
        ]
        if not entries:
            return F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<double>))")
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    retrieval = [m for m in metrics if m in METRIC_GROUPS["retrieval"]]
    others = [m for m in metrics if m not in METRIC_GROUPS["retrieval"]]
    contexts = texts_or_empty(F.col("contexts"))
    return results.withColumns(
        {
            "retrieval_scores": as_map(retrieval),
            "generation_scores": as_map(others),
            "context_count": F.size(contexts),
            "context_lengths": F.transform(contexts, lambda c: F.length(text_or_empty(c))),
            "answer_length": F.length(text_or_empty(F.col("answer"))),
        }
    )


def _percent(c: Column) -> Column:
    """Whole percent, rounded down: the same in every engine."""
    return F.concat(F.floor(c * 100 + 1e-9).cast("string"), F.lit("%"))


def failure_rules() -> Column:
    """The array of failures of one row of ``component_scores``, in rule order."""
    retrieval, generation = F.col("retrieval_scores"), F.col("generation_scores")
    precision = F.coalesce(retrieval["context_precision"], F.lit(1.0))
    recall = F.coalesce(retrieval["context_recall"], F.lit(1.0))
    faithful = F.coalesce(generation["faithfulness"], F.lit(1.0))
    relevancy = F.coalesce(generation["answer_relevancy"], F.lit(1.0))
    has_contexts = F.col("context_count") > 0
    answered = F.col("answer_length") >= SHORT_ANSWER
    shortest, longest = F.array_min("context_lengths"), F.array_max("context_lengths")
    uneven = (
        (F.col("context_count") >= 2) & (shortest > 0) & (longest / shortest > LENGTH_RATIO)
    )

    def rule(when: Column, mode: str, blame: str, confidence: float, reason: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(mode).alias("mode"),
                F.lit(blame).alias("blame"),
                F.lit(confidence).alias("confidence"),
                reason.alias("reason"),
            ),
        )

    rules = [
        rule(
            ~has_contexts, "empty_retrieval", "retrieval", 0.95,
            F.lit("Nothing was retrieved for the question."),
        ),
        rule(
            has_contexts & (precision < LOW_PRECISION), "low_context_relevance", "retrieval", 0.8,
            F.concat(F.lit("Few contexts are relevant (precision "), _percent(precision), F.lit(").")),
        ),
        rule(
            has_contexts & (recall < LOW_RECALL), "missing_context", "retrieval", 0.75,
            F.concat(F.lit("Relevant contexts are missing (recall "), _percent(recall), F.lit(").")),
        ),
        rule(
            has_contexts & ~answered, "off_topic_answer", "generation", 0.7,
            F.lit("The answer is empty or very short although contexts were found."),
        ),
        rule(
            answered & (faithful < LOW_FAITHFULNESS), "hallucination", "generation", 0.85,
            F.concat(
                F.lit("The contexts do not back the answer (faithfulness "), _percent(faithful), F.lit(").")
            ),
        ),
        rule(
            answered & (relevancy < LOW_RELEVANCY), "off_topic_answer", "generation", 0.75,
            F.concat(
                F.lit("The answer misses the question (relevancy "), _percent(relevancy), F.lit(").")
            ),
        ),
        rule(
            uneven, "chunking_split_info_lost", "chunking", 0.6,
            F.concat(
                F.lit("Context lengths are uneven ("), shortest.cast("string"), F.lit(" to "),
                longest.cast("string"), F.lit(")."),
            ),
        ),
    ]
    return F.filter(F.array(*rules).cast(_FAILURE), lambda f: f.isNotNull())


def primary_blame(failures: Column) -> Column:
    """D3: the blamed target of one row, as a struct (target, confidence, reason).

    Count times mean confidence is the sum of confidences. Ties go to the target
    that failed first.
    """

    def pick(found: Column) -> Column:
        targets = F.array_distinct(F.transform(found, lambda f: f["blame"]))
        scored = F.transform(
            targets,
            lambda t, i: F.struct(
                F.round(
                    F.aggregate(
                        F.filter(found, lambda f: f["blame"] == t),
                        F.lit(0.0),
                        lambda s, f: s + f["confidence"],
                    ),
                    9,
                ).alias("score"),
                (-i).alias("order"),
                t.alias("target"),
            ),
        )
        winner = F.array_max(scored)["target"]

        def describe(target: Column) -> Column:
            own = F.filter(found, lambda f: f["blame"] == target)
            return F.struct(
                target.alias("target"),
                F.array_max(F.transform(own, lambda f: f["confidence"])).alias("confidence"),
                F.array_join(F.transform(F.slice(own, 1, 3), lambda f: f["reason"]), "; ").alias(
                    "reason"
                ),
            )

        none = F.struct(
            F.lit("unknown").alias("target"),
            F.lit(0.0).alias("confidence"),
            F.lit(HEALTHY).alias("reason"),
        )
        return F.when(F.size(found) == 0, none).otherwise(let(winner, describe))

    return let(failures, pick)


def diagnose(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Component scores plus ``failures`` and ``blame`` per item; a pure projection."""
    scored = component_scores(results, metrics)
    found = scored.withColumn("failures", failure_rules())
    return found.withColumn("blame", primary_blame(F.col("failures")))


def failure_rows(diagnosed: DataFrame, *keys: str) -> DataFrame:
    """Long form of D2: one row per failure with its running number.

    Exploded with the outer form: the plain one adds a filter on the size, which
    would be pushed below the scores and compute them again.
    """
    rows = diagnosed.select(*keys, F.posexplode_outer("failures").alias("seq", "f"))
    return rows.where(F.col("seq").isNotNull()).select(
        *keys, "seq", "f.mode", "f.blame", "f.confidence", "f.reason"
    )


def _reported(diagnosed: DataFrame, threshold: float) -> DataFrame:
    return diagnosed.select(F.explode_outer("failures").alias("f")).where(
        F.col("f.confidence") >= threshold
    )


def mode_counts(diagnosed: DataFrame, threshold: float = REPORT_CONFIDENCE) -> DataFrame:
    """Failures per mode."""
    return (
        _reported(diagnosed, threshold)
        .groupBy(F.col("f.mode").alias("mode"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def blame_counts(diagnosed: DataFrame, threshold: float = REPORT_CONFIDENCE) -> DataFrame:
    """Failures per blamed target."""
    return (
        _reported(diagnosed, threshold)
        .groupBy(F.col("f.blame").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def health(diagnosed: DataFrame) -> DataFrame:
    """One row with items, healthy items (no rule hit at all) and their share."""
    clean = F.count_if(F.size("failures") == 0)
    total = F.count(F.lit(1))
    return diagnosed.agg(
        total.alias("total_items"),
        clean.alias("healthy_items"),
        F.when(total == 0, F.lit(1.0)).otherwise(clean / total).alias("overall_health"),
    ).withColumn(
        "health_label",
        F.when(F.col("overall_health") >= GOOD_HEALTH, "good")
        .when(F.col("overall_health") >= FAIR_HEALTH, "fair")
        .otherwise("poor"),
    )


def blame_share(counts: DataFrame) -> DataFrame:
    """Share of each target in percent. ``counts`` has at most five rows."""
    everything = Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(everything) * 100.0)


def recommendations(counts: DataFrame, limit: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """Advice for the most blamed targets first, ``limit`` lines overall.

    Ties between targets go by their declared order. ``counts`` has at most five
    rows, so the final window runs over a few dozen rows.
    """
    spark = counts.sparkSession
    rows = [
        (t, TARGETS.index(t), i, text) for t in TARGETS for i, text in enumerate(ADVICE[t])
    ]
    advice = spark.createDataFrame(rows, "target string, t_no int, a_no int, advice string")
    order = Window.orderBy(F.desc("n"), "t_no", "a_no")
    return (
        counts.join(F.broadcast(advice), "target")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .select(
            "position",
            F.concat(
                F.lit("["), F.upper("target"), F.lit("] ("), F.col("n").cast("string"),
                F.lit(" failures) "), F.col("advice"),
            ).alias("recommendation"),
        )
    )
