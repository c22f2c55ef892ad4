"""Documents whose date lies too far back. Row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import document_date

# --- fixed values ------------------------------------------------------------
STALENESS_DAYS = 365
# -----------------------------------------------------------------------------


def _severity(age: Column, days: int) -> Column:
    return (
        F.when(age > 3 * days, "critical")
        .when(age > 2 * days, "high")
        .when(age > days, "medium")
        .otherwise("low")
    )


def stale_documents(
    docs: DataFrame,
    as_of: str,
    days: int = STALENESS_DAYS,
    metadata: str | None = None,
    numbers: str | None = None,
    header_chars: int | None = None,
) -> DataFrame:
    """(doc_id, updated_at, age_days, severity) for documents dated before ``as_of`` minus
    ``days``. Documents without a date are no issue. ``as_of`` is always given, so a
    run can be repeated. ``metadata`` and ``numbers`` name map columns of texts and of
    numbers; ``header_chars`` restricts dates in texts to their opening.
    """
    now = F.lit(as_of).cast("timestamp")
    maps = [F.col(c) if c else None for c in (metadata, numbers)]
    cutoff = now - F.make_dt_interval(F.lit(days))
    # Filtering inside an array keeps the date search to one evaluation per row; a
    # filter on the column would be pushed below it and run the search again.
    old = F.filter(F.array(document_date(F.col("content"), *maps, header_chars)), lambda at: at < cutoff)
    dated = docs.select("doc_id", F.explode(old).alias("updated_at"))
    age = F.floor((now.cast("double") - F.col("updated_at").cast("double")) / 86400)
    return (
        dated.withColumn("age_days", age).withColumn("severity", _severity(F.col("age_days"), days))
    )


def staleness_issues(stale: DataFrame) -> DataFrame:
    """Stale documents in the issue layout shared by all checks."""
    day = F.date_format("updated_at", "yyyy-MM-dd")
    return stale.select(
        F.lit("staleness").alias("check"),
        F.lit("staleness").alias("issue_type"),
        "severity",
        F.format_string("Document is %d days old", "age_days").alias("title"),
        F.concat(
            F.lit("The latest date of document "), F.col("doc_id").cast("string"), F.lit(" is "),
            day, F.lit("."),
        ).alias("description"),
        F.array(F.col("doc_id").cast("string")).alias("document_ids"),
        F.lit(1).cast("bigint").alias("n_issues"),
    )
