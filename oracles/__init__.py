"""Equivalent DuckDB SQL for the registered queries."""

from oracles import corpus, metrics, ranking, runs, sources

ORACLES = {**metrics.ORACLES, **ranking.ORACLES, **corpus.ORACLES, **runs.ORACLES, **sources.ORACLES}
