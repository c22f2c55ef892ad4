"""The first n rows in an order, without a sort of the table and without one task that holds them.

The key of the last row is found by counting: some keys of the table split it into
ranges, the rows of each range are counted, and the range with the wanted place is
split again, until it has few keys. The first rows are then a plain filter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Keys that split a range in a round, and keys that the driver looks through at the end.
SPLITS, FEW_KEYS = 127, 4096


@dataclass(frozen=True)
class Place:
    """The key of a row in an order, and how many rows of the same key stand before it."""

    key: Row
    before: int

    def below(self, order: list[str]) -> Column:
        """Whether a row's key is smaller; nulls are smallest."""
        return _less(order, self.key)

    def same(self, order: list[str]) -> Column:
        return reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(self.key[c])) for c in order])


def _less(order: list[str], key: Row) -> Column:
    less, equal = F.lit(False), F.lit(True)
    for name in order:
        column, value = F.col(name), key[name]
        smaller = F.lit(False) if value is None else column.isNull() | (column < F.lit(value))
        less = less | (equal & F.coalesce(smaller, F.lit(False)))
        equal = equal & column.eqNullSafe(F.lit(value))
    return less


def _split_keys(keys: DataFrame, order: list[str]) -> list[Row]:
    """Some keys of a range, in order, chosen by a hash."""
    return keys.select(*order).orderBy(F.xxhash64(F.lit(5), *order), *order).limit(SPLITS).orderBy(*order).collect()


def place_of(rows: DataFrame, order: list[str], number: int) -> Place | None:
    """The place of the row with this number (from 0) when ``rows`` ascend by the columns ``order``; None beyond the end.

    Rows of one key are counted together first, so a key that a third of the table has
    is one row. Every round keeps about one range of 128.
    """
    if number < 0:
        return None
    keys = cut_lineage(rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")))
    left = keys.count()
    while left > FEW_KEYS:
        splits = _split_keys(keys, order)
        # A key belongs to the number of splits that are smaller than it.
        bucket = reduce(Column.__add__, [(~_less(order, s)).cast("int") for s in splits])
        counted = keys.groupBy(bucket.alias("_b")).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys"))
        found = None
        for r in sorted(counted.collect(), key=lambda r: r["_b"]):
            if number < r["rows"]:
                found = r
                break
            number -= r["rows"]
        if found is None:
            return None
        at = found["_b"]
        inside = F.lit(True)
        if at > 0:
            inside = inside & ~_less(order, splits[at - 1])
        if at < len(splits):
            inside = inside & _less(order, splits[at])
        keys, left = keys.where(inside), found["keys"]
    for r in keys.orderBy(*order).collect():
        if number < r["_n"]:
            return Place(r, number)
        number -= r["_n"]
    return None


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by the columns ``order`` (ascending, nulls first), in no order; all if there are fewer.

    Of rows with the key of the last one, as many as fit are taken.
    """
    if n <= 0:
        return rows.limit(0)
    last = place_of(rows, order, n - 1)
    if last is None:
        return rows
    return rows.where(last.below(order)).unionByName(rows.where(last.same(order)).limit(last.before + 1))
