"""Join of similar vectors against all pairs, and how many vectors it sends around."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import metric_join as mj


def clustered(n, clusters, size, spread, seed):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(clusters, size))
    return middle[random.integers(0, clusters, n)] + random.normal(size=(n, size)) * spread


def table(spark, vectors):
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)], "id long, v array<double>")


def all_pairs(vectors, threshold):
    with np.errstate(all="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        sims = unit @ unit.T
        rows, cols = np.nonzero(np.triu(sims >= threshold, 1))
    return {(a, b): sims[a, b] for a, b in zip(rows.tolist(), cols.tolist())}


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.97, 1.0])
@pytest.mark.parametrize("guests", [40, 1 << 20])
def test_equals_all_pairs(spark, monkeypatch, threshold, guests):
    for name, value in (("CELL_ROWS", 20), ("BLOCK_ROWS", 15), ("GUESTS", guests)):
        monkeypatch.setattr(mj, name, value)
    random = np.random.default_rng(3)
    vectors = np.concatenate([clustered(150, 9, 6, 0.4, 1), random.normal(size=(60, 6)), [[2.0, 0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0, 0], [0] * 6]])
    # A third of all vectors in one spot, so that one band of one cell has many blocks.
    vectors = np.concatenate([vectors, vectors[0] + random.normal(size=(100, 6)) * 0.01])
    odd = spark.createDataFrame([(9000, [float("nan")] * 6), (9001, [float("inf")] + [1.0] * 5), (9002, None), (9003, [None] * 6)], "id long, v array<double>")
    rows = mj.metric_pairs(table(spark, vectors).unionByName(odd), threshold).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    want = all_pairs(vectors, threshold)
    assert len(rows) == len(got)
    sure = {p for p, s in want.items() if s >= threshold + 1e-9}
    assert sure <= set(got) <= set(all_pairs(vectors, threshold - 1e-9))
    assert all(got[p] == pytest.approx(want[p]) for p in sure)


def test_few_guests_between_clusters(spark, monkeypatch):
    monkeypatch.setattr(mj, "CELL_ROWS", 100)
    monkeypatch.setattr(mj, "BLOCK_ROWS", 200)
    vectors = clustered(6000, 60, 16, 0.05, 5)
    blocks = 6000 / 200
    assert mj.guests(table(spark, vectors), 0.95) < 0.2 * 6000 * blocks / 2


def test_visits_do_not_grow_with_cells(spark, monkeypatch):
    """Vectors that pivots do not tell apart visit few blocks, and still find every pair."""
    for name, value in (("CELL_ROWS", 20), ("MOST_VISITS", 4), ("SLICE", 50)):
        monkeypatch.setattr(mj, name, value)
    vectors = np.random.default_rng(5).normal(size=(1500, 16))
    assert mj.guests(table(spark, vectors), 0.4) <= 5 * len(vectors)
    got = {(r.a, r.b) for r in mj.metric_pairs(table(spark, vectors), 0.4).collect()}
    assert {p for p, s in all_pairs(vectors, 0.4).items() if s >= 0.4 + 1e-9} <= got <= set(all_pairs(vectors, 0.4 - 1e-9))


def test_empty_and_single(spark):
    one = table(spark, np.ones((1, 3)))
    assert mj.metric_pairs(one, 0.9).count() == 0 and mj.metric_pairs(one.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError):
        mj.metric_pairs(one, 0.0)
