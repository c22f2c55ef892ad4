"""Health per check, and the merged audit."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import contradictions, coverage, duplicates, staleness
from plumbline.session import cut_lineage

# --- fixed values: weights of the health formulas, severities ----------------
CHECKS = ["staleness", "duplicates", "contradictions", "coverage"]
DUPLICATE_SHARE, DUPLICATE_PENALTY = 0.05, 0.4
CONTRADICTION_SHARE, CONTRADICTION_PENALTY = 0.1, 0.5
GAP_PENALTY = 0.3
SEVERITIES = ["critical", "high", "medium", "low"]
# -----------------------------------------------------------------------------


def _pair_health(n_docs: Column, issues: Column, share: float, penalty: float) -> Column:
    pairs = n_docs.cast("double") * (n_docs - 1) / 2.0
    ratio = issues / F.greatest(pairs * share, F.lit(1.0))
    return F.when(n_docs <= 1, F.lit(1.0)).otherwise(
        1.0 - F.least(ratio * penalty, F.lit(penalty))
    )


def check_health(check: Column, n_docs: Column, issues: Column, topics: Column) -> Column:
    """A health score in [0, 1] from document, issue and topic counts."""
    no_topics = F.coalesce(topics, F.lit(0)) == 0
    return (
        F.when(n_docs == 0, F.lit(1.0))
        .when(check == "staleness", F.greatest(F.lit(0.0), 1.0 - issues / n_docs))
        .when(
            check == "duplicates",
            _pair_health(n_docs, issues, DUPLICATE_SHARE, DUPLICATE_PENALTY),
        )
        .when(
            check == "contradictions",
            _pair_health(n_docs, issues, CONTRADICTION_SHARE, CONTRADICTION_PENALTY),
        )
        .when(no_topics, F.lit(1.0))
        .otherwise(1.0 - F.least(issues / topics * GAP_PENALTY, F.lit(GAP_PENALTY)))
    )


def audit_checks(
    issues: DataFrame, sizes: DataFrame
) -> DataFrame:
    """One row per performed check: check, n_documents, n_issues, health.

    ``sizes(check, n_documents, n_topics)`` names the checks that were run, so a
    check without issues is listed too.
    """
    found = issues.groupBy("check").agg(F.sum("n_issues").alias("n_issues"))
    return (
        sizes.join(found, "check", "left")
        .na.fill(0, ["n_issues"])
        .withColumn(
            "health",
            check_health(
                F.col("check"), F.col("n_documents"), F.col("n_issues"), F.col("n_topics")
            ),
        )
        .select("check", "n_documents", "n_issues", "health")
    )


def tally(issues: DataFrame) -> DataFrame:
    """Issues counted once by check and severity: a few rows from which checks and summary follow."""
    counts = issues.groupBy("check", "severity").agg(F.sum("n_issues").alias("n_issues"))
    return cut_lineage(counts)


def audit_summary(checks: DataFrame, issues: DataFrame) -> DataFrame:
    """C11, from issues or their ``tally``: one row with the merged health (mean of the checks, half-even to 3 places),
    issue counts by severity and a summary line."""
    merged = checks.agg(
        F.max("n_documents").alias("total_documents"),
        F.count(F.lit(1)).alias("n_checks"),
        F.bround(F.avg("health"), 3).alias("health_score"),
    )
    by_severity = issues.agg(
        F.coalesce(F.sum("n_issues"), F.lit(0)).alias("total_issues"),
        *[
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n_issues"))), F.lit(0)).alias(
                f"n_{s}"
            )
            for s in SEVERITIES
        ],
    )
    # Both sides are one row each.
    one = merged.withColumn("_k", F.lit(1)).join(by_severity.withColumn("_k", F.lit(1)), "_k")
    head = F.format_string(
        "%d documents, %d checks, %d issue(s)", "total_documents", "n_checks", "total_issues"
    )
    detail = F.concat_ws(
        ", ",
        *[
            F.when(F.col(f"n_{s}") > 0, F.concat(F.lit(f"{s}: "), F.col(f"n_{s}").cast("string")))
            for s in SEVERITIES
        ],
    )
    text = F.when(F.col("total_issues") == 0, head).otherwise(F.concat(head, F.lit("; "), detail))
    healthy = (F.col("n_critical") == 0) & (F.col("n_high") == 0)
    return one.drop("_k").withColumns({"healthy": healthy, "summary": text})


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by type and severity."""
    return issues.groupBy("issue_type", "severity").agg(F.sum("n_issues").alias("n_issues"))


def sorted_issues(issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Issues from critical to low."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    listed = issues.orderBy(rank, "check", "title")
    return listed if limit is None else listed.limit(limit)


def run_audit(
    docs: DataFrame,
    as_of: str,
    checks: Iterable[str] = ("staleness", "duplicates"),
    *,
    vectors: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    metadata: str | None = None,
    staleness_days: int = staleness.STALENESS_DAYS,
    similarity: float = duplicates.SIMILARITY,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the chosen checks; returns (checks, summary, issues).

    ``vectors(doc_id, v)`` switches duplicates to vector similarity and is needed
    for coverage. ``verdicts(doc_a, doc_b, response)`` holds the judge's replies
    and is needed for contradictions.
    """
    chosen = list(checks)
    unknown = [c for c in chosen if c not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks {unknown}; choose from {', '.join(CHECKS)}")
    if not chosen:
        raise ValueError("choose at least one check")
    if "coverage" in chosen and vectors is None:
        raise ValueError("coverage needs vectors")
    if "contradictions" in chosen and verdicts is None:
        raise ValueError("contradictions need verdicts")
    parts: list[DataFrame] = []
    topics = None
    if "staleness" in chosen:
        stale = staleness.stale_documents(docs, as_of, staleness_days, metadata)
        parts.append(staleness.staleness_issues(stale))
    if "duplicates" in chosen:
        found = (
            duplicates.duplicate_texts(docs, similarity)
            if vectors is None
            else duplicates.duplicate_vectors(vectors, similarity)
        )
        parts.append(duplicates.duplicate_issues(found))
    if "contradictions" in chosen:
        confirmed = contradictions.contradictions(verdicts)
        parts.append(contradictions.contradiction_issues(confirmed))
    if "coverage" in chosen:
        clustered = cut_lineage(coverage.cluster_documents(vectors))
        topics = coverage.topics(clustered)
        parts.append(coverage.coverage_issues(coverage.coverage_gaps(topics, clustered=clustered)))
    issues = reduce(DataFrame.unionByName, parts)
    n_topics = (
        F.lit(0).cast("bigint") if topics is None else topics.agg(F.count(F.lit(1))).scalar()
    )
    sizes = docs.agg(F.count(F.lit(1)).alias("n_documents")).select(
        F.explode(F.array(*[F.lit(c) for c in chosen])).alias("check"),
        "n_documents",
        n_topics.alias("n_topics"),
    )
    counts = tally(issues)
    per_check = audit_checks(counts, sizes)
    return per_check, audit_summary(per_check, counts), issues
