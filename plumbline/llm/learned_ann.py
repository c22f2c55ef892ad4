"""Approximate nearest neighbours through learned partitions.

On a bounded sample the neighbour graph is split into balanced parts with few cut
edges, and a small network learns which part a vector belongs to. Every vector is
stored under its most probable part; a query is compared exactly with all vectors
of its several most probable parts. How many parts that takes for the wanted
recall is measured on sample rows that the network was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage

#: Rows that the parts and the network are learned from, the first by a hash of their id.
SAMPLE = 8192
PARTS = 32
RECALL = 0.98
NEIGHBOURS = 10
HIDDEN = 128
#: Rows of a part, and of the queries for it, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances from the differences themselves, so that equal vectors tie exactly."""
    out = np.empty((len(queries), len(rows)))
    step = max(1, 2_000_000 // max(1, rows.size))
    for at in range(0, len(queries), step):
        gap = queries[at : at + step, None, :] - rows[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("qrd,qrd->qr", gap, gap))
    return out


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    square = (x * x).sum(axis=1)
    for at in range(0, len(x), 512):
        gap = square[None, :] - 2 * x[at : at + 512] @ x.T
        gap[np.arange(len(gap)), np.arange(at, at + len(gap))] = np.inf
        out[at : at + 512] = np.argpartition(gap, k - 1, axis=1)[:, :k]
    return out


def _halved(x: np.ndarray, graph: np.ndarray, rows: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Which half each of ``rows`` goes to: equal halves, few graph edges between them."""
    part = x[rows] - x[rows].mean(axis=0)
    _, _, axes = np.linalg.svd(part[:: max(1, len(part) // 2000)], full_matrices=False)
    side = np.zeros(len(rows), bool)
    side[np.argsort(part @ axes[0], kind="stable")[len(rows) // 2 :]] = True
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    source = np.repeat(np.arange(len(rows)), graph.shape[1])
    target = place[graph[rows].ravel()]
    source, target = source[target >= 0], target[target >= 0]
    for _ in range(rounds):
        # Edges to the other half less edges to the own one, both ways.
        cross = np.where(side[source] != side[target], 1, -1)
        gain = np.bincount(source, cross, len(rows)) + np.bincount(target, cross, len(rows))
        left = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
        right = np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")]
        n = min(len(left), len(right))
        swap = int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2
        if not swap:
            break
        side[left[:swap]], side[right[:swap]] = True, False
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, of nearly equal sizes; ``parts`` is a power of two."""
    label = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:
        for part in range(n):
            rows = np.flatnonzero(label == part)
            if len(rows) > 1:
                label[rows[_halved(x, graph, rows)]] += n
        n *= 2
    return label


@dataclass
class Router:
    """A network with one hidden layer that tells the parts of a vector by probability."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(0, (x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts, the likeliest first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def _fit(x: np.ndarray, label: np.ndarray, parts: int, epochs: int = 40, batch: int = 256) -> Router:
    random = np.random.default_rng(0)
    d = x.shape[1]
    router = Router(
        x.mean(axis=0),
        np.maximum(x.std(axis=0), 1e-9),
        [
            random.normal(0, (2 / d) ** 0.5, (d, HIDDEN)),
            np.zeros(HIDDEN),
            random.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)),
            np.zeros(parts),
        ],
    )
    z = (x - router.mean) / router.scale
    first = [np.zeros_like(w) for w in router.layers]
    second = [np.zeros_like(w) for w in router.layers]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at : at + batch]
            w1, b1, w2, b2 = router.layers
            hidden = np.maximum(0, z[rows] @ w1 + b1)
            logits = hidden @ w2 + b2
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = (p @ w2.T) * (hidden > 0)
            slopes = [z[rows].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ p + 1e-4 * w2, p.sum(axis=0)]
            step += 1
            for n, slope in enumerate(slopes):
                first[n] = 0.9 * first[n] + 0.1 * slope
                second[n] = 0.999 * second[n] + 0.001 * slope**2
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                router.layers[n] = router.layers[n] - 0.003 * move
    return router


def learn(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, k: int = NEIGHBOURS) -> Router:
    """Parts and router from sample rows; a fifth of them only measures the recall of the probes."""
    parts = 1 << max(0, min(parts, len(x) // 32).bit_length() - 1)
    kept = np.arange(len(x)) % 5 != 0
    train = x[kept] if kept.sum() > 1 else x
    label = balanced_parts(train, neighbour_graph(train, k), parts) if len(train) > k else np.zeros(len(train), np.int64)
    router = _fit(train, label, parts)
    tests = np.flatnonzero(~kept)
    if parts == 1 or not len(tests):
        router.probes = parts
        return router
    near = neighbour_graph(x, k)[tests]
    home = router.ranked(x, 1)[:, 0]
    order = router.ranked(x[tests], parts)
    found = np.cumsum((home[near][:, :, None] == order[:, None, :]).sum(axis=1), axis=1).sum(axis=0) / near.size
    router.probes = int(min(parts, np.searchsorted(found, recall) + 1))
    return router


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, of rows that take part."""
    values = F.col("embedding").cast("array<double>")
    whole = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists("v", lambda v: v != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(
    vectors: DataFrame,
    is_query,
    k: int = NEIGHBOURS,
    parts: int = PARTS,
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row where ``is_query``.

    ``vectors`` has vec_id and embedding; rows with a null id, a null, zero or
    non-finite vector, or a vector of another size than most, take no part. Nearest
    is the smallest Euclidean distance in doubles, ties go to the smaller vec_id. A
    row never finds rows of its own vec_id; a query id that is repeated is searched
    once. A part is cut into blocks by its counted size, so a vector that many rows
    share fills many blocks and not one task.
    """
    usable = _usable(vectors)
    picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    x = np.array([r["v"] for r in picked.select("v").collect()], np.float64)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(x):
        return vectors.sparkSession.createDataFrame([], schema)
    router = vectors.sparkSession.sparkContext.broadcast(learn(x, parts, recall, k))
    probes = router.value.probes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = router.value.ranked(_matrix(batch["v"]), probes)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(list(order))], ["vec_id", "v", "parts"])

    routed = cut_lineage(usable.mapInArrow(route, "vec_id long, v array<double>, parts array<long>"))
    homes = routed.withColumn("part", F.col("parts")[0])
    queries = routed.where(is_query).dropDuplicates(["vec_id"]).withColumn("part", F.explode("parts"))
    count = {r["part"]: r["count"] for r in homes.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    plan = [(p, -(-n // BLOCK_ROWS), -(-asked.get(p, 0) // BLOCK_QUERIES)) for p, n in count.items()]
    sizes = F.broadcast(vectors.sparkSession.createDataFrame(plan, "part long, blocks int, asked int"))

    def dealt(rows: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        """Rows in a block of their own by id, once for each block of the other side."""
        spread = rows.join(sizes, "part").where("asked > 0")
        return spread.select(
            "vec_id",
            "v",
            "part",
            F.pmod(F.xxhash64("vec_id"), F.col(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(other),
        )

    key = ["part", "block", "asked_block"]
    rows = dealt(homes, "block", "blocks", "asked_block", "asked")
    ask = dealt(queries, "asked_block", "asked", "block", "blocks")
    ask = ask.toDF("query_id", "q", "q_part", "q_asked_block", "q_block")

    def compare(asking: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(asking) and len(stored):
            stored = stored.sort_values("vec_id", kind="stable")
            ids, table = stored["vec_id"].to_numpy(), np.stack(stored["v"].to_numpy())
            for at in range(0, len(asking), 64):
                some = asking.iloc[at : at + 64]
                gaps = _distances(np.stack(some["q"].to_numpy()), table)
                for query, gap in zip(some["query_id"], gaps, strict=True):
                    gap[ids == query] = np.inf
                    best = np.argsort(gap, kind="stable")[:k]
                    best = best[np.isfinite(gap[best])]
                    out["query_id"].append(np.full(len(best), query))
                    out["vec_id"].append(ids[best])
                    out["score"].append(gap[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    found = ask.groupBy("q_part", "q_block", "q_asked_block").cogroup(rows.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
