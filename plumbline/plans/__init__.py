"""Registered queries over the test tables, by name."""

from plumbline.plans import corpus_queries, metric_queries, ranking_queries, run_queries, source_queries

QUERIES = {
    **metric_queries.QUERIES,
    **ranking_queries.QUERIES,
    **corpus_queries.QUERIES,
    **run_queries.QUERIES,
    **source_queries.QUERIES,
}
