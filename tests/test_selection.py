"""The first rows of an order by counting, against sorted lists."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import selection as se
from plumbline.sources import datasets as ds


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("few", [1, 5, 4096])
def test_places(spark, monkeypatch, few):
    """Also with one key in a range, few splits, nulls and a key that many rows have."""
    monkeypatch.setattr(se, "FEW_KEYS", few)
    monkeypatch.setattr(se, "SPLITS", 6)
    pick = random.Random(2)
    rows = [(pick.choice([None, 1, 2, 3, 9, 50]), pick.choice(["a", "b", None, "é", "￿", "𝄞"])) for _ in range(150)] + [(3, "b")] * 90
    order = sorted(rows, key=key)
    table = spark.createDataFrame(rows, "x int, y string").repartition(5)
    for number in (0, 1, 17, 100, 150, len(rows) - 1):
        place = se.place_of(table, ["x", "y"], number)
        assert tuple(place.key[c] for c in ("x", "y")) == order[number]
        assert place.before == number - order.index(order[number])
    assert se.place_of(table, ["x", "y"], len(rows)) is None and se.place_of(table.limit(0), ["x"], 0) is None
    for n in (0, 1, 120, 10_000):
        assert sorted((tuple(r) for r in se.first_rows(table, ["x", "y"], n).collect()), key=key) == order[:n]


def test_large_sample_is_no_top_n(spark):
    items = spark.range(20_000).withColumnRenamed("id", "item_id")
    half = ds.sample_items(items, 10_000)
    assert "TakeOrdered" not in half._jdf.queryExecution().executedPlan().toString()
    got = [r.item_id for r in half.collect()]
    assert len(set(got)) == 10_000
    assert got[:50] == [r.item_id for r in ds.sample_items(items.repartition(3), 50).collect()]
