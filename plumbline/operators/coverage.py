"""Topics of a corpus by clustering, and thin topics."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import topic_label
from plumbline.functions.vectors import squared_l2

# --- fixed values ------------------------------------------------------------
MIN_CLUSTER_SIZE = 2
SEED = 42
# -----------------------------------------------------------------------------


def cluster_count(n_docs: int, max_clusters: int | None = None) -> int:
    """The root of the number of documents, at least 2, at most ``max_clusters`` if given."""
    wanted = max(2, math.isqrt(n_docs))
    return wanted if max_clusters is None else min(wanted, max(2, max_clusters))


def cluster_documents(
    vectors: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, max_clusters: int | None = None
) -> DataFrame:
    """``vectors(doc_id, v)`` with a ``cluster`` by k-means; empty when there are fewer
    documents than ``min_cluster_size``."""
    n = vectors.count()
    if n < min_cluster_size:
        return vectors.limit(0).withColumn("cluster", F.lit(0))
    featured = vectors.withColumn("features", array_to_vector("v"))
    model = KMeans(
        k=cluster_count(n, max_clusters), seed=SEED, featuresCol="features", predictionCol="cluster"
    ).fit(featured)
    return model.transform(featured).drop("features")


def topics(clustered: DataFrame) -> DataFrame:
    """(cluster, size, representative) from ``clustered(doc_id, v, cluster)``.

    The representative is the document nearest to the cluster mean, the smaller
    id on ties. Means and minima are combined before the shuffle, so one cluster
    may hold most of the corpus.
    """
    means = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("center"),
    )
    distance = F.round(squared_l2(F.col("v"), F.col("center")), 12)
    nearest = F.min(F.struct(distance.alias("distance"), F.col("doc_id")))
    return (
        clustered.join(means, "cluster")
        .groupBy("cluster", "size")
        .agg(nearest.alias("near"))
        .select("cluster", "size", F.col("near.doc_id").alias("representative"))
    )


def labelled_topics(topic_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Topics with a label from the text of their representative."""
    texts = docs.select(F.col("doc_id").alias("representative"), "content")
    return topic_rows.join(texts, "representative", "left").select(
        "cluster", "size", "representative", topic_label(F.col("content")).alias("topic")
    )


def coverage_gaps(
    topic_rows: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, clustered: DataFrame | None = None
) -> DataFrame:
    """Topics of fewer than ``min_cluster_size`` documents, with all their ``document_ids``
    where ``clustered(doc_id, cluster)`` is given. The lists are as short as the bound."""
    thin = topic_rows.where(F.col("size") < min_cluster_size)
    if clustered is None:
        return thin.withColumn("document_ids", F.array("representative"))
    ids = (
        clustered.join(thin.select("cluster"), "cluster", "left_semi")
        .groupBy("cluster")
        .agg(F.array_sort(F.collect_list("doc_id")).alias("document_ids"))
    )
    return thin.join(ids, "cluster")


def coverage_issues(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        F.lit("coverage").alias("check"),
        F.lit("coverage_gap").alias("issue_type"),
        F.lit("low").alias("severity"),
        F.concat(F.lit("Thin topic around document "), F.col("representative").cast("string")).alias(
            "title"
        ),
        F.concat(F.lit("Only "), F.col("size").cast("string"), F.lit(" document(s).")).alias(
            "description"
        ),
        F.col("document_ids").cast("array<string>").alias("document_ids"),
        F.lit(1).cast("bigint").alias("n_issues"),
    )
