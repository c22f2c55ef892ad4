"""Registered queries for ranking and score normalising (R)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.functions.vectors import hash_embedding
from plumbline.operators import ranking, vector_ranking
from plumbline.operators.response_logs import logged_documents, rejected_payloads
from plumbline.operators.retrieval_metrics import long_form_metrics
from plumbline.plans import views
from plumbline.plans.metric_queries import rounded
from plumbline.session import cut_lineage

TOP = 5


def _rank():
    return F.col("rank").cast("bigint").alias("rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.bm25_topk(
        views.rank_queries(spark, sf_dir), views.rank_docs(spark, sf_dir), TOP
    )
    return ranked.select("query_id", _rank(), "doc_id", rounded("score"))


def bm25_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.bm25_topk(
        views.rank_queries(spark, sf_dir), views.rank_docs(spark, sf_dir), TOP, tokenizer="simple"
    )
    return ranked.select("query_id", _rank(), "doc_id", rounded("score"))


def bm25_hits_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.bm25_hits(
        views.rank_queries(spark, sf_dir), views.rank_docs(spark, sf_dir), TOP
    )
    return hits.select("query_id", _rank(), "doc_id", rounded("score"))


def retrieval_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank documents by BM25, then score the lists against the relevant documents."""
    queries, docs = views.rank_queries(spark, sf_dir), views.rank_docs(spark, sf_dir)
    ranked = ranking.bm25_topk(queries, docs, TOP)
    # Few rows, read twice.
    relevant = cut_lineage(views.relevant(spark, sf_dir))
    scored = long_form_metrics(ranked, relevant, queries, k=3)
    names = [c for c in scored.columns if c != "query_id"]
    return scored.select("query_id", *[rounded(n) for n in names])


def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.relevant(spark, sf_dir)


def _knn(kernel: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.vectors(spark, sf_dir).select("doc_id", "v")
    found = vector_ranking.topk_vectors(views.vector_queries(spark, sf_dir), docs, TOP, kernel)
    return found.select("query_id", _rank(), "doc_id", rounded("score"))


def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against all vectors, under the true-norm cosine and the linear L2 score."""
    docs = views.vectors(spark, sf_dir).select("doc_id", "v")
    queries = docs.withColumnRenamed("doc_id", "query_id")
    parts = [
        vector_ranking.topk_vectors(queries, docs, TOP, kernel).withColumn("kernel", F.lit(kernel))
        for kernel in ("cosine", "l2_linear")
    ]
    return parts[0].unionByName(parts[1]).select(
        "kernel", "query_id", _rank(), "doc_id", rounded("score")
    )


def norm_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as result lists: one list per order."""
    lines = views.table(spark, sf_dir, "lineitem")
    score = scores.minmax(F.col("l_extendedprice").cast("double"), scores.list_of("l_orderkey"))
    return lines.select("l_orderkey", "l_linenumber", rounded(score, "score"))


def norm_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    size = F.count(F.lit(1)).over(scores.list_of("l_orderkey"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        rounded(scores.by_rank(F.row_number().over(best), size), "score"),
    )


def norm_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = (
        F.when(F.col("stage") == "click", "cosine")
        .when(F.col("stage") == "view", "l2")
        .when(F.col("stage") == "error", "ip")
        .when(F.col("stage") == "signup", "similarity")
        .otherwise("other")
    )
    df = views.latencies(spark, sf_dir).withColumn("space", space)
    distance = F.col("latency_ms") / 100.0 - 0.5
    return df.select(
        "event_id", "space", rounded(scores.by_distance(distance, F.col("space")), "score")
    )


def response_log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses logged as JSON, one per item, read back under three score modes."""
    hits = F.transform(
        "contexts",
        lambda c, i: F.struct(
            F.concat(F.lit("c"), i.cast("string")).alias("_id"),
            (F.length(c) / 1000.0).alias("_score"),
            F.struct(F.when(F.length(c) >= 200, c).alias("text")).alias("_source"),
        ),
    )
    payload = F.to_json(F.struct(F.lit(3).alias("took"), F.struct(hits.alias("hits")).alias("hits")))
    logs = views.items(spark, sf_dir).select("item_id", payload.alias("payload"))
    paths = {
        "k": 3, "results_path": "hits.hits", "content_path": "_source.text", "id_path": "_id",
    }
    modes = {
        "passthrough": {"score_path": "_score"},
        "minmax": {"score_path": "_score", "score_mode": "minmax"},
        "rank": {},
    }
    parts = [
        logged_documents(logs, "payload", **paths, **extra).withColumn("mode", F.lit(mode))
        for mode, extra in modes.items()
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("mode", "item_id", _rank(), "doc_id", "content", rounded("score"))


def response_log_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which one in four holds a list."""
    docs = views.rank_docs(spark, sf_dir)
    body = F.to_json(F.struct(F.array("content").alias("hits")))
    broken = [F.lit('{"hits": {"n": 1}}'), F.lit("no json"), F.lit(None).cast("string")]
    payload = F.get(F.array(body, *broken), (F.col("doc_id") % 4).cast("int"))
    logs = docs.select("doc_id", payload.alias("payload"))
    return rejected_payloads(logs, "payload", "hits").select("doc_id", "error")


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.rank_docs(spark, sf_dir)
    return docs.select(
        "doc_id", F.posexplode(hash_embedding(F.col("content"), 32)).alias("i", "x")
    ).select("doc_id", F.col("i").cast("bigint").alias("i"), rounded("x"))


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_topk_simple": bm25_simple,
    "bm25_hits_minmax": bm25_hits_minmax,
    "relevant_documents": relevant_documents,
    "retrieval_metrics_long": retrieval_metrics_long,
    "knn_cosine": partial(_knn, "unit_dot"),
    "knn_l2": partial(_knn, "l2_inverse"),
    "knn_scores": knn_scores,
    "norm_minmax": norm_minmax,
    "norm_rank": norm_rank,
    "norm_distance": norm_distance,
    "response_log_docs": response_log_docs,
    "response_log_rejected": response_log_rejected,
    "hash_embed": hash_embed,
}
