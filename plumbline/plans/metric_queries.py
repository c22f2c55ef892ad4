"""Registered queries for item metrics, prompts and run summaries (M, A, K, R10, R12)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.vectors import hash_embedding
from plumbline.operators import cost_metrics as cm
from plumbline.operators import generation_metrics as gm
from plumbline.operators import nli, summary
from plumbline.operators.evaluate import evaluate
from plumbline.operators.judge import JUDGE_CRITERIA, judge_prompt
from plumbline.operators.providers import (
    build_prompt,
    echo_generate,
    echo_retrieve,
    resolve_contexts,
)
from plumbline.plans import views

AT_K = 3


def rounded(c: str | Column, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


def _metric(name: str, k: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate(views.items(spark, sf_dir), [name], k=k)
    return scored.select("item_id", rounded(name))


def m_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.latencies(spark, sf_dir)
    return df.select("event_id", rounded(cm.latency_score(F.col("latency_ms")), "latency"))


def m_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cm.with_cost(evaluate(views.items(spark, sf_dir), ["token_count"]))
    total = cm.total_tokens(F.col("prompt_tokens"), F.col("completion_tokens"))
    return scored.select(
        "item_id",
        total.alias("total_tokens"),
        rounded("token_count"),
        F.round("cost_usd", 9).alias("cost_usd"),
    )


def m_similarity_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.items(spark, sf_dir).select(
        "item_id",
        hash_embedding(F.col("answer")).alias("a"),
        hash_embedding(F.col("ground_truth")).alias("g"),
    )
    return df.select(
        "item_id",
        rounded(gm.vector_similarity(F.col("a"), F.col("g")), "semantic_similarity"),
        rounded(gm.vector_bertscore(F.col("a"), F.col("g")), "bertscore"),
    )


def m_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select(
        "item_id", rounded(gm.word_count(F.col("answer")), "word_count")
    )


def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in JUDGE_CRITERIA])
    return (
        views.items(spark, sf_dir)
        .select("item_id", "question", "answer", F.explode(names).alias("criteria"))
        .select(
            "item_id",
            "criteria",
            judge_prompt(F.col("criteria"), F.col("question"), F.col("answer")).alias("prompt"),
        )
    )


def judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.judge_responses(spark, sf_dir).select(
        "doc_id", rounded(tx.judge_score(F.col("response")), "score")
    )


def nli_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels over event values folded into three scores, blank texts among them."""
    value = F.col("latency_ms")
    scores = views.latencies(spark, sf_dir).select(
        "event_id",
        F.when(F.col("stage") == "error", F.lit(" ")).otherwise(F.col("stage")).alias("premise"),
        F.col("stage").alias("hypothesis"),
        F.round(value % 7 / 7, 6).alias("entailment"),
        F.round(value % 5 / 5, 6).alias("contradiction"),
        F.round(value % 3 / 3, 6).alias("neutral"),
    )
    return nli.label_scores(scores).select(
        "event_id", "label", rounded("score"), rounded("entailed_score")
    )


def nli_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim support with the share of claim words in a context as the entailment score."""
    df = nli.claim_support(views.items(spark, sf_dir), nli.word_entailment, threshold=0.5)
    return df.select(
        "item_id",
        F.size("claims").cast("bigint").alias("n_claims"),
        F.col("n_supported").cast("bigint").alias("n_supported"),
        rounded("faithfulness_nli"),
    )


def nli_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best context per claim, one row per claim."""
    df = nli.claim_support(views.items(spark, sf_dir), nli.word_entailment, threshold=0.5)
    return nli.evidence_rows(df).select(
        "item_id",
        F.col("claim_idx").cast("bigint").alias("claim_idx"),
        F.col("ctx_idx").cast("bigint").alias("ctx_idx"),
        rounded("entailed_score"),
        "supported",
    )


def nli_support_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim support from long tables of claims and scores, for every item."""
    items_ = views.items(spark, sf_dir)
    rows = nli.evidence_rows(nli.claim_support(items_, nli.word_entailment, threshold=0.5))
    scores = rows.select("item_id", "claim_idx", "ctx_idx", "entailed_score")
    return nli.support_from_scores(rows, scores, 0.5, items_).select(
        "item_id", "n_claims", "n_supported", rounded("faithfulness_nli")
    )


def m_faithfulness_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    supported = nli.claim_support(views.items(spark, sf_dir), nli.word_entailment, threshold=0.5)
    scored = evaluate(supported, ["faithfulness"], variants={"faithfulness": "nli"})
    return scored.select("item_id", rounded("faithfulness"))


def m_relevancy_nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of question words in the answer stands for the entailment score."""
    asked, said = tx.word_set(F.col("question")), tx.word_set(F.col("answer"))
    given = views.items(spark, sf_dir).withColumn("relevancy_nli", nli.word_entailment(asked, said))
    scored = evaluate(given, ["answer_relevancy"], variants={"answer_relevancy": "nli"})
    return scored.select("item_id", rounded("answer_relevancy"))


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select(
        "item_id", build_prompt(F.col("question"), F.col("contexts")).alias("prompt")
    )


def mock_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return echo_generate(views.items(spark, sf_dir)).select(
        "item_id", "answer", "prompt_tokens", "completion_tokens", "total_tokens"
    )


def mock_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Items without a reference answer count as having no known contexts.
    known = F.when(F.col("ground_truth").isNotNull(), F.col("ground_truth_contexts"))
    return (
        views.items(spark, sf_dir)
        .select("item_id", F.inline(echo_retrieve(F.col("question"), known, k=2)))
        .select("item_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "content", "score")
    )


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = F.when(F.col("provider").isNotNull(), F.slice("contexts", 1, 2))
    context = F.when(F.col("model") != "gpt-4o", F.col("context"))
    return views.items(spark, sf_dir).select(
        "item_id",
        F.array_join(resolve_contexts(retrieved, context), "|").alias("contexts"),
        F.size(resolve_contexts(retrieved, context)).cast("bigint").alias("n_contexts"),
    )


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.scored_runs(spark, sf_dir)
    errors = F.array_join(F.array_sort(F.map_keys("metric_errors")), ",")
    return df.select(
        "run_id", "item_id", *[rounded(m) for m in views.RUN_METRICS], errors.alias("metric_errors")
    )


def eval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_status(views.scored_runs(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.run_totals(views.scored_runs(spark, sf_dir)).select(
        "run_id", "total", "errors", "total_tokens", rounded("average_latency_ms")
    )


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.metric_means(views.run_results(spark, sf_dir)).select(
        "run_id", "metric", rounded("mean_score"), "n"
    )


def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scored_runs(spark, sf_dir)
    return summary.flat_metrics(scored, views.RUN_METRICS).select(
        "run_id", "metric", rounded("value")
    )


def metric_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = summary.metric_means(views.run_results(spark, sf_dir))
    return summary.metric_bands(means).select("run_id", "metric", rounded("score"), "band")


def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.error_breakdown(views.scored_runs(spark, sf_dir))


def report_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scored_runs(spark, sf_dir)
    return summary.first_examples(scored, 10).select(
        "run_id", "item_id", "question", "answer", rounded("f1_score")
    )


QUERIES = {
    "m_context_precision": partial(_metric, "context_precision", None),
    "m_context_recall": partial(_metric, "context_recall", None),
    "m_precision_at_k": partial(_metric, "precision_at_k", AT_K),
    "m_recall_at_k": partial(_metric, "recall_at_k", AT_K),
    "m_hit_rate": partial(_metric, "hit_rate", None),
    "m_mrr": partial(_metric, "mrr", None),
    "m_ndcg": partial(_metric, "ndcg", None),
    "m_ndcg_at_k": partial(_metric, "ndcg", AT_K),
    "m_exact_match": partial(_metric, "exact_match", None),
    "m_f1": partial(_metric, "f1_score", None),
    "m_bleu": partial(_metric, "bleu", None),
    "m_rouge": partial(_metric, "rouge", None),
    "m_similarity": partial(_metric, "semantic_similarity", None),
    "m_similarity_vec": m_similarity_vec,
    "m_bertscore": partial(_metric, "bertscore", None),
    "m_faithfulness": partial(_metric, "faithfulness", None),
    "m_relevancy": partial(_metric, "answer_relevancy", None),
    "m_hallucination": partial(_metric, "hallucination", None),
    "m_latency": m_latency,
    "m_token_cost": m_token_cost,
    "m_word_count": m_word_count,
    "judge_prompts": judge_prompts,
    "judge_score": judge_score,
    "nli_label": nli_label,
    "nli_faithfulness": nli_faithfulness,
    "nli_evidence": nli_evidence,
    "nli_support_long": nli_support_long,
    "m_faithfulness_nli": m_faithfulness_nli,
    "m_relevancy_nli": m_relevancy_nli,
    "build_prompt": build_prompts,
    "mock_generate": mock_generate,
    "mock_retrieve": mock_retrieve,
    "resolve_contexts": resolve,
    "eval_items": eval_items,
    "eval_status": eval_status,
    "run_summary": run_summary,
    "metric_means": metric_means,
    "flat_metrics": flat_metrics,
    "metric_bands": metric_bands,
    "report_errors": report_errors,
    "report_examples": report_examples,
}
