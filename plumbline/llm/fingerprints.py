"""Fingerprints of whole texts from their most improbable byte windows.

A text stands between zero bytes, so that short texts and the ends of all texts have
windows too. Every window of 64 bytes has an entropy. How often each entropy occurs over all
documents ranks the windows: the rarer, the better; windows of very low entropy
(runs, rules, padding) come last. Of every 64 neighbouring windows the leftmost of
the best rank gains a point, and windows with 16 points or more are the features of
a text. Features go into Bloom filters of 2048 bits, five bits each, 160 features a
filter; a full filter is followed by the next. Two fingerprints are alike by the bits
that their filters share beyond chance, as a share of the most they could.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder, small_batches
from plumbline.llm.shingles import mix

#: Bytes of a window, and neighbouring windows that compete for a point.
WINDOW, RIVALS, LEAST_POINTS = 64, 64, 16
#: Entropies are told apart in thousandths of the largest one; lower ones than WEAK come last.
STEPS, WEAK = 1000, 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Bytes that are worked on together. Longer texts are worked on in pieces of this size.
PIECE = 1 << 18

_SCALE = 1 << 16
_COUNTS = np.arange(WINDOW + 1)
#: c log2 c for a byte that is c times in a window, in whole numbers, and its growth by one more.
_PART = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * _SCALE).astype(np.int64)
_GROWTH = np.diff(_PART)
_MOST = int(_PART[WINDOW])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of ``data`` (bytes, a window at least) in steps of 1/STEPS."""
    n = len(data)
    entering, leaving = np.zeros(n - WINDOW, np.uint8), np.zeros(n - WINDOW, np.uint8)
    for far in range(1, WINDOW):
        same = (data[far:] == data[:-far]).view(np.uint8)
        entering += same[WINDOW - far :]
        leaving += same[: n - WINDOW]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _PART[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_GROWTH[entering] - _GROWTH[leaving], out=total[1:])
    total[1:] += total[0]
    return ((_MOST - total) * STEPS // _MOST).astype(np.int32)


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts that are worked on together, as ranges of their numbers."""
    first, held = 0, 0
    for number, size in enumerate(sizes):
        if held and held + size > PIECE:
            yield first, number
            first, held = number, 0
        held += size
    if held:
        yield first, len(sizes)


class Windows:
    """The windows of some texts, each of them between zero bytes; an empty text has none."""

    def __init__(self, coded: list[bytes]) -> None:
        around = bytes(WINDOW - 1)
        self.coded = [around + c + around if c else c for c in coded]

    def groups(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, bytes, number of windows of each text): long texts alone, others together."""
        for first, end in _pieces([len(c) for c in self.coded]):
            data = np.frombuffer(b"".join(self.coded[first:end]), np.uint8)
            sizes = np.array([len(c) for c in self.coded[first:end]])
            yield first, end, data, sizes

    @staticmethod
    def _owned(sizes: np.ndarray) -> np.ndarray:
        """Whether the window that begins at each byte ends within the same text."""
        inside = np.ones(sizes.sum(), bool)
        for end in np.cumsum(sizes[sizes > 0]):
            inside[end - WINDOW + 1 : end] = False
        return inside

    def count(self) -> np.ndarray:
        """How many windows have each entropy."""
        found = np.zeros(STEPS + 1, np.int64)
        for _, _, data, sizes in self.groups():
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                own = self._owned(sizes)[: len(data) - WINDOW + 1] if len(sizes) > 1 else slice(None)
                if len(sizes) > 1:
                    found += np.bincount(entropies(data)[own], minlength=STEPS + 1)
                    break
                found += np.bincount(entropies(data[at : at + PIECE + WINDOW - 1]), minlength=STEPS + 1)
        return found

    def features(self, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(text, hashes of its features in order), each feature once; texts without windows are left out."""
        for first, _, data, sizes in self.groups():
            if len(sizes) > 1:
                chosen = _popular(ranks[entropies(data)], self._owned(sizes)[: len(data) - WINDOW + 1])
                hashes = _hashes(data, chosen)
                ends = np.cumsum(sizes)
                cuts = np.searchsorted(chosen, ends)
                for number, (a, b) in enumerate(zip([0, *cuts], cuts)):
                    if sizes[number]:
                        yield first + number, _first_of_each(hashes[a:b])
            else:
                yield first, _first_of_each(np.concatenate(list(self._long(data, ranks))))

    @staticmethod
    def _long(data: np.ndarray, ranks: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of the features of one text, piece by piece; a piece sees the rivals on both sides of it."""
        n = len(data) - WINDOW + 1
        for at in range(0, n, PIECE):
            low, high = max(0, at - RIVALS + 1), min(n, at + PIECE + RIVALS - 1)
            part = data[low : high + WINDOW - 1]
            chosen = _popular(ranks[entropies(part)], None)
            chosen = chosen[(chosen >= at - low) & (chosen < at - low + PIECE)]
            yield _hashes(part, chosen)


def _popular(ranks: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Places of the windows with enough points. Windows that are not ``own`` take no part."""
    n = len(ranks)
    kind = np.int32 if n + 2 * RIVALS < 1 << 20 else np.int64
    shift = 20 if kind is np.int32 else 40
    none = np.iinfo(kind).max
    best = np.full(n + 2 * (RIVALS - 1), none, kind)
    places = np.arange(n, dtype=kind)
    keys = (ranks.astype(kind) << shift) | places
    best[RIVALS - 1 : n + RIVALS - 1] = keys if own is None else np.where(own, keys, none)
    step = 1
    while step < RIVALS:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    points = np.bincount(best[best != none] & ((1 << shift) - 1), minlength=n)
    return np.flatnonzero(points >= LEAST_POINTS)


def _hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].view("<u8")
    value = np.full(len(places), _ODD)
    for column in range(WINDOW // 8):
        value = mix(value * _ODD + words[:, column])
    return value


def _first_of_each(hashes: np.ndarray) -> np.ndarray:
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def _filters(hashes: np.ndarray) -> bytes:
    """Chained Bloom filters of the features, in order."""
    chain = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES)) * FILTER_BITS, np.uint8)
    for number in range(HASHES):
        place = (hashes >> np.uint64(11 * number)) & np.uint64(FILTER_BITS - 1)
        bits[chain * FILTER_BITS + place.astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fingerprint_texts(texts: list[str | None], ranks: np.ndarray) -> list[str]:
    """``features:filters`` of each text, the filters in base 64; ``0:`` for null and empty texts."""
    prints = ["0:"] * len(texts)
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for number, hashes in Windows(coded).features(ranks):
        prints[number] = f"{len(hashes)}:{base64.b64encode(_filters(hashes)).decode()}"
    return prints


def _parsed(told: str) -> tuple[int, np.ndarray]:
    features, _, filters = told.partition(":")
    return int(features), np.frombuffer(base64.b64decode(filters), "<u8").reshape(-1, FILTER_BITS // 64)


def likeness_of(one: str, other: str) -> float:
    """0 to 1, the same both ways: how far the filters of the shorter chain recur in the other.

    Each filter takes its best partner and counts by its features. Bits shared by chance
    are taken off. Equal fingerprints give 1; one without features and another give 0.
    """
    if one == other:
        return 1.0
    (n, a), (_, b) = sorted((_parsed(one), _parsed(other)), key=lambda x: (x[0], x[1].tobytes()))
    if not n:
        return 0.0
    ones, others = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for number, bits in enumerate(a):
        shared = np.bitwise_count(b & bits).sum(axis=1, dtype=np.int64)
        chance = ones[number] * others / FILTER_BITS
        most = np.minimum(ones[number], others) - chance
        total += max(0.0, float((np.maximum(shared - chance, 0) / most).max())) * min(FILTER_FEATURES, n - number * FILTER_FEATURES)
    return total / n


def entropy_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(entropy, n) over all windows of all documents."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            found += Windows([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()]).count()
        yield pa.RecordBatch.from_arrays([pa.array(range(STEPS + 1), pa.int32()), pa.array(found)], ["entropy", "n"])

    counted = docs.select(F.col(text_column)).mapInArrow(count, "entropy int, n long")
    return counted.groupBy("entropy").agg(F.sum("n").alias("n"))


def rarity(counts: DataFrame) -> np.ndarray:
    """Rank of each entropy, 0 the rarest (at most STEPS + 1 rows reach the driver)."""
    n = np.zeros(STEPS + 1, np.int64)
    for row in counts.collect():
        n[row["entropy"]] = row["n"]
    order = sorted(range(STEPS + 1), key=lambda e: (e < WEAK, -e if e < WEAK else n[e], e))
    ranks = np.empty(STEPS + 1, np.int32)
    ranks[order] = np.arange(STEPS + 1)
    return ranks


def fingerprint(text: Column, ranks: np.ndarray) -> Column:
    """Fingerprint of a text column; see ``fingerprint_texts``."""

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprint_texts(texts.tolist(), ranks))

    return told(text)


def likeness(one: Column, other: Column) -> Column:
    """Likeness of two columns of fingerprints; see ``likeness_of``."""

    @F.pandas_udf("double")
    def alike(ones: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(a, b) for a, b in zip(ones, others, strict=True)])

    return alike(one, other)


_TOLD = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _TOLD.split(", ")]


def _edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(rows: list[tuple], ranks: np.ndarray) -> list[tuple]:
    """(doc_id, text, fingerprint, next text, next fingerprint) to rows of _TOLD."""
    edits = [_edited(r[1], r[3]) for r in rows]
    prints = fingerprint_texts(edits, ranks)
    return [
        (r[0], len(r[1]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), r[2], p, likeness_of(r[2], p), likeness_of(r[2], r[4]))
        for r, e, p in zip(rows, edits, prints, strict=True)
    ]


def successors(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Each document against its text with half of it taken from the next document, and against that document.

    Columns: see _TOLD. Documents follow each other by doc_id (null first, repeated
    rows by a hash of their text); the first follows the last. A null text is empty; two
    empty texts are alike. Every row gives a row. The texts are sorted in one shuffle; a
    task knows the next document of all its rows but the last, and these few rows, two
    for each task, are paired afterwards from the written result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "_hash", "_salt"]
    marked = content.withColumn("_hash", F.xxhash64("text")).withColumn("_salt", F.monotonically_increasing_id())
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = f"{_TOLD}, kind int, part int, text string"

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 10
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_NAMES, "kind", "part", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch["text"].to_pylist()
            rows = list(zip(batch["doc_id"].to_pylist(), texts, fingerprint_texts(texts, ranks), strict=True))
            if last is None:
                part = batch["part"][0].as_py()
                yield made([(rows[0][0], None, None, rows[0][2], None, None, None, 1, part, rows[0][1])])
            else:
                rows.insert(0, last)
            pairs = [(*row, *after[1:]) for row, after in zip(rows, rows[1:])]
            yield made([(*r, 0, None, None) for r in _pairs(pairs, ranks)])
            last = rows[-1]
        if last is not None:
            yield made([(last[0], None, None, last[2], None, None, None, 2, part, last[1])])

    path = shared_folder(spark, "fingerprints")
    ordered.mapInArrow(walk, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)

    ends = written.where("kind > 0")
    parts = sorted(r["part"] for r in ends.where("kind = 1").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, _next int")
    heads = ends.where("kind = 1").select(F.col("part").alias("_next"), F.col("text").alias("_text"), F.col("fingerprint").alias("_print"))
    tails = ends.where("kind = 2").join(follows, "part").join(heads, "_next").select("doc_id", "text", "fingerprint", "_text", "_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield made([(*r, 0, None, None) for r in _pairs(rows, ranks)])

    return written.where("kind = 0").unionByName(tails.mapInArrow(close, schema)).select(*_NAMES)
