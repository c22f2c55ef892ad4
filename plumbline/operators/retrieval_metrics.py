"""M1 to M7: ranking quality of retrieved contexts.

Two shapes give the same numbers: the array form works on one row per item and
needs no shuffle; the long form works on ``ranked`` and ``relevant`` tables and
is meant for result lists too long for an array.
Texts must already be normalised (``normalize_context``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let

OUT_OF_RANGE = "score out of range"


def _check_k(k: int | None) -> None:
    if k is not None and k < 0:
        raise ValueError("k must not be negative")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _hits(listed: Column, wanted: Column) -> Column:
    return F.size(F.filter(listed, lambda x: F.array_contains(wanted, x)))


def context_precision(retrieved: Column, relevant: Column) -> Column:
    """Share of retrieved entries that are relevant, repeats counted."""
    return let(relevant, lambda rel: _ratio(_hits(retrieved, rel), F.size(retrieved)))


def context_recall(retrieved: Column, relevant: Column) -> Column:
    """Share of relevant entries that were retrieved, repeats counted."""
    return let(retrieved, lambda ret: _ratio(_hits(relevant, ret), F.size(relevant)))


def _top(retrieved: Column, k: int | None) -> Column:
    return retrieved if k is None else F.slice(retrieved, 1, k)


def precision_at_k(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """Relevant entries among the first k, divided by k even when fewer were retrieved."""
    _check_k(k)
    depth = F.size(retrieved) if k is None else F.lit(k)
    return let(relevant, lambda rel: _ratio(_hits(_top(retrieved, k), rel), depth))


def recall_at_k(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """Distinct relevant entries among the first k over all distinct relevant entries."""
    _check_k(k)
    found = F.size(F.array_intersect(relevant, _top(retrieved, k)))
    return _ratio(found, F.size(F.array_distinct(relevant)))


def hit_rate(retrieved: Column, relevant: Column) -> Column:
    return F.coalesce(F.arrays_overlap(retrieved, relevant), F.lit(False)).cast("double")


def mrr(retrieved: Column, relevant: Column) -> Column:
    """1 / position of the first relevant entry, 0 without one."""

    def first(rel: Column) -> Column:
        marks = F.transform(retrieved, lambda x: F.array_contains(rel, x))
        return F.coalesce(1.0 / F.nullif(F.array_position(marks, True), F.lit(0)), F.lit(0.0))

    return let(relevant, first)


def _discount(position: Column, scheme: str) -> Column:
    """Discount at a 1-based position: log2(position) with position 1 undiscounted,
    or the textbook log2(position + 1)."""
    if scheme == "standard":
        return F.log2(position + 1)
    return F.when(position == 1, F.lit(1.0)).otherwise(F.log2(position))


def _add(total: Column, x: Column) -> Column:
    return total + x


def raw_ndcg(
    retrieved: Column,
    relevant: Column,
    k: int | None = None,
    discount: str = "log2_rank",
    dedupe: bool = False,
) -> Column:
    """NDCG before the range check; repeats of a hit can lift it above 1."""
    _check_k(k)
    depth = F.size(retrieved) if k is None else F.lit(k)

    def score(rel: Column) -> Column:
        listed = _top(retrieved, k)

        def gain(ranked: Column) -> Column:
            gains = F.transform(
                ranked,
                lambda x, i: F.when(
                    F.array_contains(rel, x)
                    & (F.lit(not dedupe) | (F.array_position(ranked, x) == i + 1)),
                    1.0 / _discount(i + 1, discount),
                ).otherwise(0.0),
            )
            return F.aggregate(gains, F.lit(0.0), _add)

        best = F.least(F.size(F.array_distinct(rel)), depth)
        ideal = F.aggregate(
            F.transform(F.sequence(F.lit(1), best), lambda i: 1.0 / _discount(i, discount)),
            F.lit(0.0),
            _add,
        )
        empty = (F.size(retrieved) == 0) | (best == 0)
        return F.when(empty, F.lit(0.0)).otherwise(let(listed, gain) / ideal)

    return let(relevant, score)


def ndcg(retrieved: Column, relevant: Column, k: int | None = None, **options) -> Column:
    """NDCG as stored by a run: a value above 1 is an error and counts as 0."""
    return let(
        raw_ndcg(retrieved, relevant, k, **options),
        lambda s: F.when(s > 1.0, F.lit(0.0)).otherwise(s),
    )


def ndcg_error(retrieved: Column, relevant: Column, k: int | None = None, **options) -> Column:
    return F.when(raw_ndcg(retrieved, relevant, k, **options) > 1.0, F.lit(OUT_OF_RANGE))


def long_form_metrics(
    ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int | None = None
) -> DataFrame:
    """All seven metrics from ``ranked(query_id, rank, doc_id)``,
    ``relevant(query_id, doc_id)`` and ``queries(query_id)``.

    Joins and groups use the query key only. Both sides are reduced to counts
    and sums before the last join, so a query with a very long list costs
    one aggregation buffer, not one long row.
    """
    _check_k(k)
    rel = relevant.select("query_id", "doc_id").distinct()
    marked = ranked.select("query_id", "rank", "doc_id").join(
        rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left"
    )
    within = F.lit(True) if k is None else F.col("rank") <= k
    hit = F.col("hit").isNotNull()
    lists = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("hits"),
        F.count_if(hit & within).alias("hits_k"),
        F.countDistinct(F.when(hit, F.col("doc_id"))).alias("found"),
        F.countDistinct(F.when(hit & within, F.col("doc_id"))).alias("found_k"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(hit & within, 1.0 / _discount(F.col("rank"), "log2_rank"))).alias("dcg"),
    )
    totals = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    joined = (
        queries.select("query_id")
        .join(lists, "query_id", "left")
        .join(totals, "query_id", "left")
        .na.fill(0, ["n", "hits", "hits_k", "found", "found_k", "n_rel"])
    )
    depth = F.col("n") if k is None else F.lit(k)
    best = F.least(F.col("n_rel"), depth)
    ideal = F.aggregate(
        F.transform(
            F.sequence(F.lit(1).cast("bigint"), best), lambda i: 1.0 / _discount(i, "log2_rank")
        ),
        F.lit(0.0),
        _add,
    )
    dcg = F.coalesce("dcg", F.lit(0.0))
    gain = F.when((best == 0) | (F.col("n") == 0), F.lit(0.0)).otherwise(dcg / ideal)
    return joined.select(
        "query_id",
        _ratio(F.col("hits"), F.col("n")).alias("context_precision"),
        F.when(F.col("n") == 0, 0.0)
        .otherwise(_ratio(F.col("found"), F.col("n_rel")))
        .alias("context_recall"),
        _ratio(F.col("hits_k"), depth).alias("precision_at_k"),
        _ratio(F.col("found_k"), F.col("n_rel")).alias("recall_at_k"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        F.when(gain > 1.0, F.lit(0.0)).otherwise(gain).alias("ndcg"),
    )


def with_ranks(results: DataFrame) -> DataFrame:
    """Number a result table by score, best first; ties go to the smaller document id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return results.withColumn("rank", F.row_number().over(order))
