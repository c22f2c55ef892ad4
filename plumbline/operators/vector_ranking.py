"""Exact top-k over vector tables, as a blocked matrix product.

Both sides are cut into blocks of bounded size; each pair of blocks is one
NumPy product in one task, and only k rows per query leave it. No nested-loop
join is planned and no vector passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import check_k

BLOCK_ROWS = 16384  # each side is sent once for every block of the other
SLICE_ROWS = 128  # queries of a block that are scored at a time
HEAD_ROWS = 1024  # documents that give the first bound of a query
LEAST_ROWS = 256  # smaller blocks are not worth a task


def _dot(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = q @ d.T
    return s, np.clip(s, 0.0, 1.0)


def _cosine(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]
    s = np.divide(q @ d.T, scale, out=np.zeros_like(scale), where=scale > 0)
    return s, np.clip(s, 0.0, 1.0)


def _squared(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    squared = (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2.0 * (q @ d.T)
    return np.maximum(squared, 0.0)


def _l2_inverse(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dist = _squared(q, d)
    return -dist, 1.0 / (1.0 + dist)


def _l2_linear(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dist = np.sqrt(_squared(q, d))
    return -dist, np.maximum(0.0, 1.0 - dist)


# name -> (order value, higher is nearer; score in [0, 1])
KERNELS: dict[str, Callable] = {
    "unit_dot": _dot,        # R2, and the inner-product form of R3
    "l2_inverse": _l2_inverse,  # R3: 1 / (1 + squared distance)
    "cosine": _cosine,       # R4 with true norms
    "l2_linear": _l2_linear,    # R4: 1 - distance, not below 0
}


def block_count(df: DataFrame, block_rows: int, tasks: int = 1) -> int:
    """How many blocks hold the table, about ``tasks`` where its rows are enough for so many;
    the count is a metadata read on Parquet."""
    n = df.count()
    return max(1, math.ceil(n / block_rows), min(tasks, math.ceil(n / LEAST_ROWS)))


def block_of(id_col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _nearest(order: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, order rounded to 12 places) of the ``kept`` highest values of each row,
    the highest first, ties to the first column.

    The kept-th of the first columns is a bound that the others must reach, so only a few
    values are rounded and sorted.
    """
    head = max(HEAD_ROWS, kept)
    if kept < order.shape[1]:
        best = np.partition(order[:, :head], -kept, axis=1)[:, -kept:]
        bound = best[:, :1] - 1e-11 - 1e-12 * np.abs(best[:, :1])
        if np.isfinite(best).all() and not np.isnan(order.sum()):
            rows, cols = np.nonzero(order >= bound)
            near = np.round(order[rows, cols], 12)
            ranked = np.lexsort((cols, -near, rows))
            sizes = np.bincount(rows, minlength=len(order))
            place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            chosen = ranked[place < kept]
            return rows[chosen], cols[chosen], near[chosen]
    near = np.round(order, 12)
    cols = np.argsort(-near, axis=1, kind="stable")[:, :kept].ravel()
    rows = np.repeat(np.arange(len(order)), kept)
    return rows, cols, near[rows, cols]


def topk_vectors(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 5,
    kernel: str = "unit_dot",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, doc_id, score) for ``queries(query_id, v)`` and ``docs(doc_id, v)``.

    Ids are BIGINT, vectors ARRAY<DOUBLE> of one length. Ties go to the smaller id.
    """
    check_k(k)
    score = KERNELS[kernel]
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    q_blocks, d_blocks = block_count(queries, block_rows), block_count(docs, block_rows, tasks)
    left = queries.select(
        "query_id",
        "v",
        block_of("query_id", q_blocks).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))).alias("db"),
    )
    right = docs.select(
        "doc_id",
        "v",
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
        block_of("doc_id", d_blocks).alias("db"),
    )

    def best_of_blocks(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame(columns=["query_id", "doc_id", "near", "score"])
        d = d.sort_values("doc_id", kind="stable")
        stored, ids, kept, parts = _matrix(d["v"]), d["doc_id"].to_numpy(), min(k, len(d)), []
        for at in range(0, len(q), SLICE_ROWS):
            some = q.iloc[at : at + SLICE_ROWS]
            order, value = score(_matrix(some["v"]), stored)
            rows, cols, near = _nearest(order, kept)
            found = {
                "query_id": some["query_id"].to_numpy()[rows],
                "doc_id": ids[cols],
                "near": near,
                "score": value[rows, cols],
            }
            parts.append(pd.DataFrame(found))
        return pd.concat(parts)

    partial = (
        left.groupBy("qb", "db")
        .cogroup(right.groupBy("qb", "db"))
        .applyInPandas(best_of_blocks, "query_id long, doc_id long, near double, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )
