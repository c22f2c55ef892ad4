"""Registered queries for text primitives, corpus audit and synthesis (T, C, Y, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.dates import document_date
from plumbline.functions.qa_text import parse_qa
from plumbline.operators import audit as au
from plumbline.operators import contradictions as co
from plumbline.operators import coverage as cv
from plumbline.operators import duplicates as du
from plumbline.operators import staleness as st
from plumbline.operators import synthesis as sy
from plumbline.plans import views
from plumbline.plans.metric_queries import rounded
from plumbline.session import cut_lineage

VECTOR_SIMILARITY = 0.4  # no pair of the test vectors is nearer than about 0.5
QUOTA = 3
QUESTIONS_PER_DOCUMENT = 7


def _big(name: str):
    return F.col(name).cast("bigint").alias(name)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.rank_docs(spark, sf_dir)
    return docs.select(
        "doc_id", F.posexplode(tx.claims(F.col("content"))).alias("claim_idx", "claim")
    ).select("doc_id", _big("claim_idx"), "claim")


def best_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.items(spark, sf_dir)
    return df.select(
        "item_id",
        tx.best_context(F.col("answer"), F.col("contexts")).alias("context"),
    )


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every token list, and a digest of the normalised text."""
    c = F.col("content")
    return views.rank_docs(spark, sf_dir).select(
        "doc_id",
        F.size(tx.word_set(c)).cast("bigint").alias("n_word_set"),
        F.size(tx.question_words(c)).cast("bigint").alias("n_question_words"),
        F.size(tx.keywords(c)).cast("bigint").alias("n_keywords"),
        F.size(tx.sentences(c)).cast("bigint").alias("n_sentences"),
        tx.token_count(c).alias("n_tokens"),
        F.md5(tx.normalize_context(c)).alias("normalized"),
    )


def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 between each answer and its question."""
    score = tx.jaccard(tx.word_set(F.col("answer")), tx.word_set(F.col("question")))
    return views.items(spark, sf_dir).select("item_id", rounded(score, "jaccard"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.chunk_documents(views.rank_docs(spark, sf_dir)).select(
        "doc_id", _big("chunk_idx"), "chunk"
    )


def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 between each chunk and the next one of its document."""
    pairs = views.chunk_items(spark, sf_dir).where(F.size("contexts") == 2)
    return pairs.select(
        "item_id",
        tx.char_overlap(F.get("contexts", F.lit(0)), F.get("contexts", F.lit(1)))
        .cast("bigint")
        .alias("chars"),
    )


def topic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rank_docs(spark, sf_dir).select(
        "doc_id", tx.topic_label(F.col("content")).alias("topic")
    )


def extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.corpus(spark, sf_dir)
    found = docs.select("doc_id", document_date(F.col("content")).alias("at"))
    return found.select("doc_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object embedded in a judge reply, and fields of it by path."""
    block = tx.embedded_json(F.col("response"))
    read = views.verdict_responses(spark, sf_dir).select("doc_a", block.alias("block"))
    return read.select(
        "doc_a",
        tx.json_path(F.col("block"), "topic").alias("topic"),
        tx.json_path(F.col("block"), "sources.1.id").cast("bigint").alias("second_source"),
    )


def parse_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        views.responses(spark, sf_dir)
        .select("doc_id", F.posexplode(parse_qa(F.col("response"))).alias("case_no", "p"))
        .select("doc_id", _big("case_no"), "p.question", "p.answer")
    )


def parse_qa_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors = sy.test_cases(_case_responses(spark, sf_dir))
    return errors.select("doc_id", "test_type", "error")


def _case_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in [sy.STANDARD, *sy.ADVERSARIAL_TYPES]])
    return views.responses(spark, sf_dir).select(
        "doc_id",
        F.lit(0).alias("chunk_idx"),
        F.lit("").alias("chunk"),
        F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("test_type"),
        "response",
    )


def synth_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, _ = sy.test_cases(_case_responses(spark, sf_dir), types=["multi_hop", "misleading"])
    return sy.type_counts(cases)


def chunk_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.rank_docs(spark, sf_dir)
    chunked = sy.chunk_documents(docs)
    return sy.chunk_quotas(chunked, QUESTIONS_PER_DOCUMENT * docs.count()).select(
        "doc_id", _big("chunk_idx"), "n_questions"
    )


def synth_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = sy.chunk_documents(views.rank_docs(spark, sf_dir)).withColumn(
        "n_questions", F.lit(QUOTA)
    )
    return sy.standard_prompts(chunked).select(
        "doc_id", _big("chunk_idx"), "test_type", "prompt"
    )


def adversarial_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = sy.chunk_documents(views.rank_docs(spark, sf_dir))
    return sy.adversarial_prompts(chunked, 2).select(
        "doc_id", _big("chunk_idx"), "test_type", "prompt"
    )


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stale_documents(views.corpus(spark, sf_dir), views.AS_OF)


def audit_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir).select("doc_id", "age_days", "severity")


def audit_duplicates_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = du.duplicate_texts(views.rank_docs(spark, sf_dir), 0.8)
    return found.select("doc_a", "doc_b", rounded("similarity"), "n_pairs", "kind")


def audit_duplicates_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document; the pairs of ``audit_duplicates_jaccard`` name groups."""
    return du.members(views.rank_docs(spark, sf_dir))


def audit_duplicates_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = du.duplicate_vectors(
        views.vectors(spark, sf_dir).select("doc_id", "v"), VECTOR_SIMILARITY
    )
    return found.select("doc_a", "doc_b", rounded("similarity"), "n_pairs", "kind")


#: The contradiction queries report the first so many pairs; the limit is the operator.
FIRST_PAIRS = 50


def contradiction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first FIRST_PAIRS pairs in document order."""
    return co.contradiction_candidates(views.rank_docs(spark, sf_dir), FIRST_PAIRS)


def contradiction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, with whole texts, for the first FIRST_PAIRS pairs."""
    docs = views.rank_docs(spark, sf_dir)
    return co.contradiction_prompts(co.contradiction_candidates(docs, FIRST_PAIRS), docs)


def contradiction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = co.contradictions(views.verdict_responses(spark, sf_dir))
    return found.select("doc_a", "doc_b", rounded("confidence"), "topic", "severity")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.vectors(spark, sf_dir).withColumnRenamed("label", "cluster")


def coverage_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cv.topics(_labelled(spark, sf_dir))
    return found.select(_big("cluster"), "size", "representative")


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means topics with labels; the clustering depends on its start, so rows only."""
    vectors = views.vectors(spark, sf_dir).select("doc_id", "v")
    found = cv.topics(cv.cluster_documents(vectors))
    return cv.labelled_topics(found, views.rank_docs(spark, sf_dir))


def coverage_gap_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the thin topics."""
    labelled = _labelled(spark, sf_dir)
    gaps = cv.coverage_gaps(cv.topics(labelled), min_cluster_size=45, clustered=labelled)
    return gaps.select(_big("cluster"), "size", F.explode("document_ids").alias("doc_id"))


def coverage_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for k-means topics however they start: sizes add up to the documents,
    there are as many topics as wanted or fewer, and each names a document."""
    clustered = cut_lineage(cv.cluster_documents(views.vectors(spark, sf_dir).select("doc_id", "v")))
    topics = cv.topics(clustered)
    n = clustered.agg(F.count(F.lit(1)).alias("n_documents"))
    total = topics.agg(F.sum("size").alias("n_in_topics"), F.count(F.lit(1)).alias("n_topics"))
    wanted = F.greatest(F.lit(2), F.floor(F.sqrt("n_documents")))
    named = topics.join(clustered, F.col("representative") == F.col("doc_id"), "left_semi").agg(
        F.count(F.lit(1)).alias("n_named")
    )
    one = [df.withColumn("_k", F.lit(1)) for df in (n, total, named)]
    return one[0].join(one[1], "_k").join(one[2], "_k").select(
        "n_documents",
        "n_in_topics",
        (F.col("n_topics") <= wanted).alias("few_topics"),
        (F.col("n_named") == F.col("n_topics")).alias("all_named"),
    )


def audit_sorted_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 issues from critical to low, by their place (a top-k report)."""
    listed = au.sorted_issues(_issues(spark, sf_dir).select("check", "severity", "title"), 20)
    return listed.select("check", "severity")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.rank_docs(spark, sf_dir)
    labelled = _labelled(spark, sf_dir)
    gaps = cv.coverage_gaps(cv.topics(labelled), min_cluster_size=45, clustered=labelled)
    parts = [
        st.staleness_issues(_stale(spark, sf_dir)),
        du.duplicate_issues(du.duplicate_texts(docs)),
        co.contradiction_issues(co.contradictions(views.verdict_responses(spark, sf_dir))),
        cv.coverage_issues(gaps),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _checks(spark: SparkSession, sf_dir: str, issues: DataFrame) -> DataFrame:
    n_docs = views.rank_docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_documents"))
    topics = _labelled(spark, sf_dir).agg(F.countDistinct("cluster")).scalar()
    sizes = n_docs.select(
        F.explode(F.array(*[F.lit(c) for c in au.CHECKS])).alias("check"),
        "n_documents",
        topics.alias("n_topics"),
    )
    return au.audit_checks(issues, sizes)


def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(spark, sf_dir, _issues(spark, sf_dir))
    return checks.select("check", "n_documents", "n_issues", rounded("health"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = au.tally(_issues(spark, sf_dir))
    return au.audit_summary(_checks(spark, sf_dir, counts), counts)


def audit_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.issue_counts(_issues(spark, sf_dir))


QUERIES = {
    "claims": claims,
    "best_context": best_context,
    "text_statistics": text_statistics,
    "word_jaccard": word_jaccard,
    "chunks": chunks,
    "char_overlap": char_overlap,
    "topic_label": topic_label,
    "extract_dates": extract_dates,
    "json_objects": json_objects,
    "parse_qa": parse_qa_pairs,
    "parse_qa_errors": parse_qa_errors,
    "synth_type_counts": synth_type_counts,
    "chunk_quota": chunk_quota,
    "synth_prompts": synth_prompts,
    "adversarial_prompts": adversarial_prompts,
    "audit_staleness": audit_staleness,
    "audit_duplicates_jaccard": audit_duplicates_jaccard,
    "audit_duplicates_members": audit_duplicates_members,
    "audit_duplicates_vec": audit_duplicates_vec,
    "contradiction_candidates": contradiction_candidates,
    "contradiction_prompts": contradiction_prompts,
    "contradiction_verdicts": contradiction_verdicts,
    "coverage_by_label": coverage_by_label,
    "audit_coverage": audit_coverage,
    "coverage_gap_members": coverage_gap_members,
    "coverage_invariants": coverage_invariants,
    "audit_sorted_issues": audit_sorted_issues,
    "audit_checks": audit_checks,
    "audit_summary": audit_summary,
    "audit_issue_counts": audit_issue_counts,
}
