"""Entailment labels, evidence per claim, and claim support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import claims, let, strip, text_or_empty, texts_or_empty, word_set


def label_scores(df: DataFrame) -> DataFrame:
    """Label, score and entailed_score from three class scores.

    The highest score wins, the order entailment, contradiction, neutral breaks
    ties; a blank premise or hypothesis is neutral with score 1.
    """
    e, c, n = (F.coalesce(x, F.lit(0.0)) for x in ("entailment", "contradiction", "neutral"))
    blank = (strip(text_or_empty(F.col("premise"))) == "") | (
        strip(text_or_empty(F.col("hypothesis"))) == ""
    )
    label = (
        F.when(blank, "neutral")
        .when((e >= c) & (e >= n), "entailment")
        .when(c >= n, "contradiction")
        .otherwise("neutral")
    )
    return df.withColumns(
        {
            "label": label,
            "score": F.when(blank, F.lit(1.0)).otherwise(F.greatest(e, c, n)),
            "entailed_score": F.when(blank, F.lit(0.0)).otherwise(e),
        }
    )


def word_entailment(claim_words: Column, context_words: Column) -> Column:
    """A model-free stand-in for an entailment score: share of claim words in the context."""
    return F.when(F.size(claim_words) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(claim_words, context_words)) / F.size(claim_words)
    )


def claim_support(
    df: DataFrame,
    entailment: Callable[[Column, Column], Column] = word_entailment,
    threshold: float = 0.5,
) -> DataFrame:
    """M21 on items with ``answer`` and ``contexts``, all within the row.

    Adds ``claims``, ``evidence`` (per claim the best context and its score, the
    first context on ties), ``n_supported`` and ``faithfulness_nli``.
    ``entailment`` scores a claim against a context, both as word sets.
    """
    base = df.withColumns(
        {
            "claims": claims(F.col("answer")),
            "_ctx": F.transform(texts_or_empty(F.col("contexts")), word_set),
        }
    )
    worded = base.withColumn("_cw", F.transform("claims", word_set))

    def best(claim_words: Column, context_words: Column) -> Column:
        scored = F.transform(
            context_words,
            lambda ctx, i: F.struct(
                entailment(claim_words, ctx).alias("entailed_score"), (-i).alias("order")
            ),
        )
        return F.array_max(scored)

    # Bound once per row: a collapsed projection would tokenise contexts per claim.
    found = worded.withColumn(
        "_best",
        let(F.col("_ctx"), lambda ctxs: F.transform("_cw", lambda claim: best(claim, ctxs))),
    )
    evidence = F.transform(
        F.col("_best"),
        lambda b: F.struct(
            (-b["order"]).alias("ctx_idx"),
            b["entailed_score"].alias("entailed_score"),
            F.coalesce(b["entailed_score"] >= threshold, F.lit(False)).alias("supported"),
        ),
    )
    counted = found.withColumn("evidence", evidence).withColumn(
        "n_supported", F.size(F.filter("evidence", lambda e: e["supported"]))
    )
    score = F.when(F.size("claims") == 0, F.lit(1.0)).otherwise(
        F.col("n_supported") / F.size("claims")
    )
    return counted.withColumn("faithfulness_nli", score).drop("_ctx", "_cw", "_best")


def evidence_rows(supported: DataFrame) -> DataFrame:
    """One row per claim from ``claim_support``: claim_idx, claim, ctx_idx, score, supported."""
    return supported.select(
        "item_id", "claims", F.posexplode_outer("evidence").alias("claim_idx", "e")
    ).where(F.col("claim_idx").isNotNull()).select(
        "item_id",
        "claim_idx",
        F.get("claims", F.col("claim_idx")).alias("claim"),
        F.col("e.ctx_idx").alias("ctx_idx"),
        F.col("e.entailed_score").alias("entailed_score"),
        F.col("e.supported").alias("supported"),
    )


def support_from_scores(
    claim_rows: DataFrame, scores: DataFrame, threshold: float = 0.5, items: DataFrame | None = None
) -> DataFrame:
    """M21 on long tables, for scores computed by a model elsewhere.

    ``claim_rows(item_id, claim_idx)`` and ``scores(item_id, claim_idx, ctx_idx,
    entailed_score)``. Returns item_id, n_claims, n_supported, faithfulness_nli for
    every item of ``items(item_id)``, or of those that have claims where it is left
    out. An unscored claim is unsupported; an item without claims scores 1.
    """
    keys = ["item_id", "claim_idx"]
    best = scores.groupBy(*keys).agg(F.max("entailed_score").alias("best"))
    supported = F.count_if(F.coalesce(F.col("best") >= threshold, F.lit(False)))
    counted = (
        claim_rows.select(*keys)
        .join(best, keys, "left")
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("n_claims"), supported.alias("n_supported"))
    )
    if items is not None:
        none = F.lit(0).cast("bigint")
        counted = items.select("item_id").join(counted, "item_id", "left").select(
            "item_id",
            F.coalesce("n_claims", none).alias("n_claims"),
            F.coalesce("n_supported", none).alias("n_supported"),
        )
    share = F.when(F.col("n_claims") == 0, F.lit(1.0)).otherwise(F.col("n_supported") / F.col("n_claims"))
    return counted.withColumn("faithfulness_nli", share)
