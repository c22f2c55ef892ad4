"""Packing of tokenised documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows; what is left of every
document is shorter than a window. Best-fit decreasing looks at nothing but
lengths, and there are at most ``capacity`` of them, so the packing is decided on
the count of each length: a segment tree indexed by remaining capacity finds the
tightest open window, and equal windows are handled as one run. The decision is
exactly that of item-by-item best fit, and its size depends on the capacity and
not on the number of documents. Documents take their place in a run by their
number among all pieces of their length, which Spark counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_batches
from plumbline.llm.token_text import encoder, id_bytes, together

CAPACITY = 4096
END_ID = 2
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length and one bucket are numbered together.
BUCKET_ROWS = 500_000
MIN_BUCKETS = 256


class Run(NamedTuple):
    """Pieces ``first`` … ``first + count - 1`` of one length: ``per`` in a row go to one window."""

    length: int
    first: int
    count: int
    per: int
    window: int
    offset: int


class OpenWindows:
    """Open windows by remaining capacity; a max-tree over the capacities finds the tightest fit."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, remaining: int, filled: bool) -> None:
        node = remaining + self.size
        self.filled[node] = filled
        node >>= 1
        while node:
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]
            node >>= 1

    def put(self, remaining: int, window: int, count: int) -> None:
        if remaining and count:
            self.groups.setdefault(remaining, []).append((window, count))
            self._mark(remaining, True)

    def take(self, remaining: int) -> tuple[int, int]:
        group = self.groups[remaining].pop()
        if not self.groups[remaining]:
            self._mark(remaining, False)
        return group

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open window that holds ``length``."""
        node = length + self.size
        if self.filled[node]:
            return length
        while node > 1:
            if not node & 1 and self.filled[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place every piece; ``counts`` has the number of pieces of each length."""
    windows, runs, next_window = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            remaining = windows.tightest(length)
            if remaining is None:
                remaining = capacity
                per = capacity // length
                window, count = next_window, -(-left // per)
                next_window += count
            else:
                per = remaining // length
                window, count = windows.take(remaining)
            whole = min(count, left // per)
            rest = left - whole * per if whole < count else 0
            offset = capacity - remaining
            if whole:
                runs.append(Run(length, done, whole * per, per, window, offset))
                windows.put(remaining - per * length, window, whole)
            if rest:
                runs.append(Run(length, done + whole * per, rest, rest, window + whole, offset))
                windows.put(remaining - rest * length, window + whole, 1)
            touched = whole + bool(rest)
            windows.put(remaining, window + touched, count - touched)
            done += whole * per + rest
            left -= whole * per + rest
    return runs


def cut_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: full windows first, then what is left.

    A null text is empty and yields one piece that holds ``end_id`` alone. With
    ``with_ids`` a binary column ``ids`` (little-endian 32-bit) is added.
    """
    small_batches(docs.sparkSession)
    step = 4 * capacity

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(tokenizer_path), id_bytes([end_id])
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        for batch in together(batches):
            rows = []
            coded = tokens.encode_all(batch["text"].to_pylist())
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), coded, strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)
                    rows.append((*row, part) if with_ids else row)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, …) of 1 … ``capacity`` ids.

    Offsets of a sequence are gapless from 0. Repeated rows are pieces of their own;
    an empty table gives an empty table. ``pieces`` is read twice and should be cheap
    to read again (checkpointed or stored). Only the count of each length reaches the
    driver, at most ``capacity`` rows.
    """
    total = pieces.count()
    buckets = max(MIN_BUCKETS, total // BUCKET_ROWS)
    place = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets))
    placed = pieces.withColumn("_bucket", place)
    sizes = placed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = sorted(best_fit_decreasing(counts, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, 6)

    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    numbered = (
        placed.join(starts, ["length", "_bucket"])
        .withColumn("_number", F.col("_before") + F.row_number().over(order) - 1)
        .drop("_bucket", "_before")
    )
    shift = np.int64(1) << np.int64(48)
    keys = table[:, 0] * shift + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        run = table[np.searchsorted(keys, length.to_numpy() * shift + number.to_numpy(), side="right") - 1]
        within = number.to_numpy() - run[:, 1]
        return pd.DataFrame(
            {
                "sequence_id": run[:, 4] + within // run[:, 3],
                "offset": run[:, 5] + within % run[:, 3] * run[:, 0],
            }
        )

    spot = numbered.withColumn("_at", locate("length", "_number"))
    return spot.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    return pack(cut_lineage(cut_documents(docs, tokenizer_path, capacity, end_id)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids): the ids of every sequence, from pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
