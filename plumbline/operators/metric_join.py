"""Exact join of similar vectors through cells around pivots and the triangle inequality.

Two vectors with a cosine of at least t are, scaled to length 1, no further apart than
sqrt(2 - 2t). Each vector lives in the cell of its nearest pivot, and in it in a band
of distances to that pivot. It is sent as a guest to another cell only if the ball of
that cell, and the plane half-way between the two pivots, are within this distance, and
there only to the bands that its own distance to the pivot allows. Cells are small where
that keeps most guests away, else about as large as blocks. Bands are dealt over blocks of
bounded size; a task holds the vectors that live in one block and lets the
guests pass by in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Vectors of a cell on average, at most so many pivots, and vectors that live in a block.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 1024, 1024, 32768
#: Where a vector would visit more blocks than this on average, fewer and larger cells are taken.
MOST_VISITS = 16
#: Vectors by which the visits are estimated, and vectors that are compared at a time.
SAMPLE, SLICE = 4096, 1024
#: Guests of a block that pass through one task.
GUESTS = 1 << 20
#: Bands are at least this wide, so that a cell has a bounded number of them.
LEAST_BAND = 0.05
#: More than the distances of unit vectors are off by rounding.
SLACK = 1e-6
_SENT = "cell int, band int, block int, part int, guest boolean, id long, v array<double>"


class Cells:
    """Pivots, the bands that have vectors with their blocks, and the radius of each cell."""

    def __init__(self, pivots: np.ndarray, reach: float, parts: int = 1) -> None:
        self.pivots, self.reach, self.parts = pivots, reach, parts
        self.width = max(reach, LEAST_BAND)
        self.radius = np.zeros(len(pivots))
        self.blocks: dict[tuple[int, int], int] = {}
        self.apart = self.distances(pivots)

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2.0 - 2.0 * (unit @ self.pivots.T), 0.0))

    def band(self, distance):
        return np.floor(np.asarray(distance) / self.width).astype(np.int64)

    def places(self, unit: np.ndarray, own: np.ndarray, near: np.ndarray, deal: np.ndarray) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """(row, cell, band, block, part, guest) of everything that is sent of vectors in the cells ``own``."""
        far = self.distances(unit)
        # Behind the plane half-way to another pivot, and inside the ball of its cell.
        apart = np.maximum(self.apart[own], SLACK)
        behind = (far**2 - near[:, None] ** 2) / (2.0 * apart)
        may = (behind <= self.reach + SLACK / apart) & (far - self.radius <= self.reach + SLACK) & (np.arange(far.shape[1]) > own[:, None])
        low, high = self.band(np.maximum(far - self.reach - SLACK, 0.0)), self.band(far + self.reach + SLACK)
        bands = self.band(near).tolist()
        for row, (cell, band, number) in enumerate(zip(own.tolist(), bands, deal.tolist(), strict=True)):
            part = number % self.parts
            home = (number // self.parts) % self.blocks[cell, band]
            for each in range(self.parts):
                yield row, cell, band, home, each, False
            for block in range(home + 1, self.blocks[cell, band]):
                yield row, cell, band, block, part, True
            # A vector of the same cell is at most ``reach`` nearer to the pivot or further away.
            for other in range(band + 1, int(high[row, cell]) + 1):
                for block in range(self.blocks.get((cell, other), 0)):
                    yield row, cell, other, block, part, True
            for guest in np.flatnonzero(may[row]).tolist():
                for other in range(int(low[row, guest]), int(high[row, guest]) + 1):
                    for block in range(self.blocks.get((guest, other), 0)):
                        yield row, guest, other, block, part, True


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def _assigned(usable: DataFrame, cells: Cells) -> DataFrame:
    """(id, v, cell, near): the nearest pivot of each vector, decided once."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = cells.distances(_unit(_matrix(batch["v"])))
                columns = [batch["id"], batch["v"], pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "near"])

    return cut_lineage(usable.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell int, near double"))


def _visits(sample: np.ndarray, count: int, reach: float, n: int) -> float:
    """About how many blocks a vector visits as a guest, with the first ``count`` of the sample as pivots."""
    cells = Cells(sample[:count], reach)
    far = cells.distances(sample)
    own, near = far.argmin(axis=1), far.min(axis=1)
    places, sizes = np.unique(np.stack([own, cells.band(near)], axis=1), axis=0, return_counts=True)
    for (cell, band), size in zip(places.tolist(), sizes.tolist()):
        cells.blocks[cell, band] = math.ceil(size * n / len(sample) / BLOCK_ROWS)
    np.maximum.at(cells.radius, own, near)
    some = slice(-512, None)
    deal = np.arange(len(sample))
    return sum(p[5] for p in cells.places(sample[some], own[some], near[some], deal[some])) / len(sample[some])


def _cells(usable: DataFrame, reach: float) -> tuple[Cells, DataFrame] | None:
    """Cells and the vectors in them. Pivots are the first vectors by a hash of the id.

    Small cells tell clusters apart, but where the pivots tell little apart every vector
    visits most cells, so the number of cells is halved until few are visited or a cell fills a block.
    At most SAMPLE vectors and a row for each band reach the driver.
    """
    n = usable.count()
    if not n:
        return None
    first = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = _unit(np.array([r["v"] for r in first], dtype=np.float64))
    count = min(MOST_PIVOTS, len(sample), math.ceil(n / CELL_ROWS))
    while count > math.ceil(n / BLOCK_ROWS) and _visits(sample, count, reach, n) > MOST_VISITS:
        count = math.ceil(count / 2)
    cells = Cells(sample[:count], reach, max(1, math.ceil(n / GUESTS)))
    assigned = _assigned(usable, cells)
    band = F.floor(F.col("near") / cells.width).alias("band")
    for r in assigned.groupBy("cell", band).agg(F.count("*").alias("n"), F.max("near").alias("far")).collect():
        cells.blocks[r["cell"], r["band"]] = math.ceil(r["n"] / BLOCK_ROWS)
        cells.radius[r["cell"]] = max(cells.radius[r["cell"]], r["far"])
    return cells, assigned


def _sent(assigned: DataFrame, cells: Cells) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, near, deal = (batch[c].to_numpy() for c in ("cell", "near", "deal"))
            at = list(cells.places(_unit(_matrix(batch["v"])), own, near, deal))
            rows, *keys = (np.array(c) for c in zip(*at, strict=True))
            for first in range(0, len(rows), 4096):
                some = slice(first, first + 4096)
                taken = pa.array(rows[some])
                columns = [pa.array(k[some].astype(np.int32)) for k in keys[:4]] + [pa.array(keys[4][some].astype(bool))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, batch["id"].take(taken), batch["v"].take(taken)], ["cell", "band", "block", "part", "guest", "id", "v"]
                )

    deal = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40)).alias("deal")
    return assigned.select("id", "v", "cell", "near", deal).mapInArrow(send, _SENT)


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors with a length; the others are similar to nothing."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("id", "v").where((square > 0) & (square < float("inf")))


def guests(vectors: DataFrame, threshold: float) -> int:
    """How many vectors are sent to blocks that they do not live in."""
    usable = _usable(vectors)
    found = _cells(usable, math.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    return _sent(found[1], found[0]).where("guest").count() if found else 0


def metric_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """Every pair (a, b, similarity) with a < b and cosine at or above a positive ``threshold``.

    ``vectors(id, v)`` has unique ids and vectors of one length. Vectors without a length
    (zeros) or with components that are null or not finite are in no pair.
    """
    if threshold <= 0.0:
        raise ValueError("threshold must be above 0")
    usable = cut_lineage(_usable(vectors))
    made = _cells(usable, math.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    schema = "a long, b long, similarity double"
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    cells, assigned = made
    order = ["cell", "band", "block", "part"]
    dealt = _sent(assigned, cells).repartition(*order).sortWithinPartitions(*order, "guest")

    def found(a: np.ndarray, b: np.ndarray, sims: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        rows, cols = np.nonzero(keep)
        x, y = a[rows], b[cols]
        columns = [np.minimum(x, y), np.maximum(x, y), sims[rows, cols]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "similarity"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple | None = None
        ids: list[np.ndarray] = []
        units: list[np.ndarray] = []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in order] + [batch["guest"].to_numpy(zero_copy_only=False).astype(np.int32)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            numbers, v = batch["id"].to_numpy(), _matrix(batch["v"]) if batch.num_rows else None
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                key, guest = tuple(keys[low][:4]), bool(keys[low][4])
                if key != here:
                    here, ids, units = key, [], []
                for at in range(low, high, SLICE):
                    some, unit = numbers[at : min(at + SLICE, high)], _unit(v[at : min(at + SLICE, high)])
                    for known, other in zip(ids, units):
                        if guest or key[3] == 0:
                            sims = other @ unit.T
                            yield found(known, some, sims, sims >= threshold)
                    if not guest:
                        if key[3] == 0:
                            sims = unit @ unit.T
                            yield found(some, some, sims, np.triu(sims >= threshold, 1))
                        ids.append(some)
                        units.append(unit)

    return dealt.mapInArrow(compare, schema)
