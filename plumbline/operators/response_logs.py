"""Ranked documents from a table of logged search responses (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scores import by_rank, minmax_array
from plumbline.functions.text import json_path
from plumbline.functions.vectors import clamp01
from plumbline.operators.ranking import check_k


def _listed(payload: str, results_path: str | None) -> Column:
    found = F.coalesce(json_path(F.col(payload), results_path), F.col(payload))
    return F.when(F.ltrim(found).startswith("["), F.from_json(found, "array<string>"))


def rejected_payloads(df: DataFrame, payload: str, results_path: str | None = None) -> DataFrame:
    """The rows of ``df`` whose payload holds no list, with the reason as ``error``."""
    reason = F.when(F.col(payload).isNull(), "no payload").otherwise("no list of results")
    return df.where(_listed(payload, results_path).isNull()).withColumn("error", reason)


def logged_documents(
    df: DataFrame,
    payload: str,
    *,
    k: int = 5,
    results_path: str | None = None,
    content_path: str = "content",
    id_path: str | None = None,
    score_path: str | None = None,
    metadata_path: str | None = None,
    score_mode: str = "passthrough",
) -> DataFrame:
    """One row per returned document: the other columns of ``df``, then rank, doc_id,
    content, score and metadata.

    The list is found at ``results_path`` (or is the payload itself) and cut to
    its first k entries. Scores come from ``score_path``, clamped or min-max
    normalised, or from the rank when there is no score path; an entry without a
    score keeps a null one. Entries without content are dropped after the scores are
    set. All of it stays in the row. Payloads without a list give no row here and
    one in ``rejected_payloads``.
    """
    check_k(k)
    if score_mode not in ("passthrough", "minmax"):
        raise ValueError("score_mode is 'passthrough' or 'minmax'")
    listed = F.slice(_listed(payload, results_path), 1, k)
    others = [c for c in df.columns if c != payload]
    hits = df.select(*others, listed.alias("_hits"))
    if score_path:
        raw = F.transform("_hits", lambda h: json_path(h, score_path).cast("double"))
        scores = minmax_array(raw) if score_mode == "minmax" else F.transform(raw, clamp01)
    else:
        scores = F.transform("_hits", lambda _, i: by_rank(i + 1, F.size("_hits")))
    return (
        hits.withColumn("_scores", scores)
        .select(*others, "_scores", F.posexplode_outer("_hits").alias("_pos", "_hit"))
        .select(
            *others,
            (F.col("_pos") + 1).alias("rank"),
            (json_path(F.col("_hit"), id_path) if id_path else F.lit(None).cast("string")).alias(
                "doc_id"
            ),
            json_path(F.col("_hit"), content_path).alias("content"),
            F.get("_scores", F.col("_pos")).alias("score"),
            (
                json_path(F.col("_hit"), metadata_path) if metadata_path else F.lit("{}")
            ).alias("metadata"),
        )
        .where(F.col("content").isNotNull())
    )
