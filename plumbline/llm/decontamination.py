"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distances.

Texts and benchmark items are strings of words. The CGK random walk copies a string
step by step and moves on, or not, by a random bit for the step and the word; two
strings with few edits between them soon walk in step again, so their edit distance
becomes a Hamming distance. Sampled places of the walks are hash keys: a window of
a text that shares one with an item is compared with it by exact edit distance.
How many places and tables that takes for the wanted recall is measured on edited
copies of the items themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free_name, small_batches
from plumbline.llm.shingles import mix, pair_hashes, word_hashes

#: Edits (words changed, added or left out) for each word of an item.
RATE = 0.15
RECALL = 0.98
#: Shorter items turn up by chance.
MIN_WORDS = 8
#: Items of a size class differ in length by this factor at most; its shortest sets the window.
CLASS_FACTOR = 1.15
#: Items that are searched for in one pass over the texts.
BLOCK_ITEMS = 5_000
WALKS, MAX_TABLES = 4, 256
#: Edited copies on which the recall of a size class is measured.
TRIALS = 400
#: Windows that are embedded at a time.
WINDOWS = 4096
_PAD = np.uint64(0)


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def embed(strings: np.ndarray, seed: int) -> np.ndarray:
    """CGK walk of each row of word hashes: two steps for every word."""
    n, width = strings.shape
    steps = 2 * width
    padded = np.hstack([strings, np.full((n, 1), _PAD, np.uint64)])
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    for step, odd in enumerate(_odd(seed, steps)):
        out[:, step] = padded[rows, at]
        move = (out[:, step] * odd + odd) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), width)
    return out


def edited(words: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    """A copy with so many words changed, added or left out, as a window of the same length would see it."""
    out = list(words)
    for kind, place in zip(random.integers(0, 3, edits), random.random(edits), strict=True):
        at, new = int(place * len(out)), np.uint64(random.integers(1, 1 << 62))
        if kind == 0 and out:
            out[min(at, len(out) - 1)] = new
        elif kind == 1:
            out.insert(at, new)
        elif out:
            out.pop(min(at, len(out) - 1))
    tail = random.integers(1, 1 << 62, len(words)).astype(np.uint64)
    return np.concatenate([np.array(out, np.uint64), tail])[: len(words)]


@dataclass
class SizeClass:
    """Items of similar length: the window, its walks and tables, and their keys in order."""

    width: int
    edits: int
    places: np.ndarray | None
    keys: np.ndarray | None = None
    items: np.ndarray | None = None
    sieve: np.ndarray | None = None

    def table_keys(self, strings: np.ndarray) -> np.ndarray:
        """One key for each string and table; the tables take turns at the walks."""
        tables, sampled = self.places.shape
        keys = np.empty((len(strings), tables), np.uint64)
        for walk in range(min(WALKS, tables)):
            walked = embed(strings, walk + 1)
            mine = np.arange(walk, tables, WALKS)
            key = np.tile(mine.astype(np.uint64) + np.uint64(1), (len(strings), 1))
            for n in range(sampled):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + walked[:, self.places[mine, n]])
            keys[:, mine] = key
        return keys

    def fill(self, numbers: np.ndarray, strings: np.ndarray) -> None:
        if self.places is None:
            # Without tables: every different word of each item, in order.
            pairs = np.unique(np.stack([strings.ravel(), np.repeat(numbers.astype(np.uint64), self.width)], axis=1), axis=0)
            self.keys, self.items = pairs[:, 0], pairs[:, 1].astype(np.int64)
            return
        keys = self.table_keys(strings)
        items = np.repeat(numbers, keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.items = keys.ravel()[order], items[order]
        self.sieve = _sieve(self.keys)

    def candidates(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, item) pairs that share a key; without tables, those that share so many words as a match must."""
        if self.places is None:
            return self._sharing(strings)
        keys = self.table_keys(strings)
        maybe = np.flatnonzero(self.sieve[keys.ravel().astype(np.uint16)])
        asked = keys.ravel()[maybe]
        first = np.searchsorted(self.keys, asked, side="left")
        met = self.keys[np.minimum(first, len(self.keys) - 1)] == asked
        hit, first = maybe[met], first[met]
        count = np.searchsorted(self.keys, asked[met], side="right") - first
        spots = np.repeat(first, count) + _counting(count)
        pairs = np.unique(np.stack([np.repeat(hit // keys.shape[1], count), self.items[spots]], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]


    def _sharing(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        least = max(1, self.width - self.edits)
        for row, string in enumerate(strings):
            first = np.searchsorted(self.keys, string, side="left")
            count = np.searchsorted(self.keys, string, side="right") - first
            items, n = np.unique(self.items[np.repeat(first, count) + _counting(count)], return_counts=True)
            items = items[n >= least]
            found.append((np.full(len(items), row, np.int64), items))
        rows, items = zip(*found, strict=True)
        return np.concatenate(rows), np.concatenate(items)


def _sieve(keys: np.ndarray) -> np.ndarray:
    """Which low 16 bits some key has; most others need no search."""
    found = np.zeros(1 << 16, bool)
    found[keys.astype(np.uint16)] = True
    return found


def _counting(counts: np.ndarray) -> np.ndarray:
    """0 … n-1 for each n in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def choose_tables(strings: np.ndarray, edits: int, recall: float = RECALL) -> np.ndarray | None:
    """Sampled places of each table: the most places, then the fewest tables, that reach ``recall``.

    ``edits`` is the number of edits at which the recall is measured. None if no setting
    reaches it; such items are searched for by their words.
    """
    random = np.random.default_rng(11)
    chosen = strings[random.integers(0, len(strings), TRIALS)]
    copies = np.stack([edited(s, edits, random) for s in chosen])
    for sampled in (6, 5, 4, 3, 2, 1):
        places = np.sort(random.integers(0, 2 * strings.shape[1], (MAX_TABLES, sampled)), axis=1)
        whole = SizeClass(strings.shape[1], edits, places)
        met = np.maximum.accumulate(whole.table_keys(chosen) == whole.table_keys(copies), axis=1).mean(axis=0)
        enough = np.flatnonzero(met >= recall)
        if len(enough):
            return places[: enough[0] + 1]
    return None


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between ``item`` and any stretch of ``text``, and where the first such stretch ends."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for n, word in enumerate(item, 1):
        new = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([n], new)) - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def stretch_of(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, begin, end) of the closest stretch of ``text``; the shortest one that ends there."""
    edits, end = edit_distance_within(item, text)
    row, steps = np.arange(end + 1), np.arange(end + 1)
    for n, word in enumerate(item[::-1], 1):
        new = np.minimum(row[:-1] + (text[:end][::-1] != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([n], new)) - steps) + steps
    return edits, end - int(row.argmin()), end


class BenchmarkIndex:
    """Items of one block by size class, with the words and pairs of neighbouring words that occur in each class."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float = RATE, min_words: int = MIN_WORDS) -> None:
        self.rate = rate
        words = [(item_id, word_hashes(text)) for item_id, text in items]
        self.items = sorted(((i, w) for i, w in words if len(w) >= min_words), key=lambda x: (len(x[1]), str(x[0])))
        self.classes: list[SizeClass] = []
        vocabulary: dict[int, int] = defaultdict(int)
        neighbours: dict[int, int] = defaultdict(int)
        at = 0
        while at < len(self.items):
            width, end = len(self.items[at][1]), at
            while end < len(self.items) and len(self.items[end][1]) <= width * CLASS_FACTOR and end - at < 100_000:
                end += 1
            strings = np.stack([w[:width] for _, w in self.items[at:end]])
            edits = int(rate * len(self.items[end - 1][1]))
            # Edits spread over the item; the recall is measured for the share of them in the window.
            own = SizeClass(width, edits, choose_tables(strings, int(rate * width)))
            own.fill(np.arange(at, end), strings)
            for _, w in self.items[at:end]:
                for word in w.tolist():
                    vocabulary[word] |= 1 << len(self.classes)
                for pair in pair_hashes(w[:-1], w[1:]).tolist():
                    neighbours[pair] |= 1 << len(self.classes)
            self.classes.append(own)
            at = end
        self.words, self.of_class = self._table(vocabulary)
        self.pairs, self.pair_of_class = self._table(neighbours)

    def _table(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The keys in order, and a row for each class that tells which of them it has."""
        known = sorted(found)
        return np.array(known, np.uint64), np.array([[found[k] >> c & 1 for k in known] for c in range(len(self.classes))], bool)

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, object, int, int, int, int]]:
        """(text, item_id, edits, item words, begin, end) of the best stretch for each text and item."""
        lengths = np.array([len(t) for t in texts], np.int64)
        if not len(self.items) or not lengths.sum():
            return
        flat = np.concatenate(texts)
        text_end = np.cumsum(lengths)
        text_begin = text_end - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        stop = text_end[owner]
        spot = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        known = self.words[spot] == flat
        # Only two known words that stand together, in one text, can be a known pair.
        twos = np.flatnonzero(known[:-1] & known[1:] & (owner[:-1] == owner[1:]) & (len(self.pairs) > 0))
        pair = pair_hashes(flat[twos], flat[twos + 1])
        pair_spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        met = self.pairs[pair_spot] == pair
        twos, pair_spot = twos[met], pair_spot[met]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for number, own in enumerate(self.classes):
            # An item with so many edits leaves all the other words of its window in place.
            least = max(1, own.width - own.edits)
            # An edit parts two pairs of neighbours at most; the third is for windows beside the best stretch.
            least_pairs = own.width - 1 - 3 * own.edits
            begins = self._begins(twos[self.pair_of_class[number][pair_spot]], own.width, least_pairs, len(flat))
            begins = begins[begins + least <= stop[begins]]
            if not len(begins):
                continue
            total = np.concatenate(([0], np.cumsum(known & self.of_class[number][spot])))
            ends = np.minimum(begins + own.width, stop[begins])
            begins = begins[total[ends] - total[begins] >= least]
            for at in range(0, len(begins), WINDOWS):
                some = begins[at : at + WINDOWS]
                places = some[:, None] + np.arange(own.width)
                strings = np.where(places < stop[some][:, None], flat[np.minimum(places, len(flat) - 1)], _PAD)
                row, item = own.candidates(strings)
                for text, it, low, high in self._stretches(owner, some[row], item):
                    low, high = max(low, text_begin[text]), min(high, text_end[text])
                    words = self.items[it][1]
                    if edit_distance_within(words, flat[low:high])[0] <= int(self.rate * len(words)):
                        edits, begin, end = stretch_of(words, flat[low:high])
                        found = (edits, int(low - text_begin[text]) + begin, int(low - text_begin[text]) + end)
                        best[text, it] = min(best.get((text, it), found), found)
        for (text, it), (edits, begin, end) in sorted(best.items()):
            yield text, self.items[it][0], edits, len(self.items[it][1]), begin, end

    def _begins(self, at: np.ndarray, width: int, least: int, n: int) -> np.ndarray:
        """Windows of ``width`` words, of ``n`` places, with ``least`` of the pairs that begin at ``at``."""
        if least <= 0:
            return np.arange(n)
        # Of any so many pairs in a row that a window can hold, it begins at the first of them or before.
        last = at[least - 1 :]
        some = np.flatnonzero(last - at[: len(last)] <= width - 2)
        if not len(some):
            return some
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(last[some] - (width - 2), 0), 1)
        np.add.at(change, at[some] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def _stretches(self, owner: np.ndarray, begins: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to) to compare exactly; close windows of one item and text are read as one."""
        order = np.lexsort((begins, owner[begins], items)).tolist()
        at = 0
        while at < len(order):
            item, first = int(items[order[at]]), int(begins[order[at]])
            text, n_words, last = int(owner[first]), len(self.items[item][1]), first
            while at < len(order) and items[order[at]] == item:
                begin = int(begins[order[at]])
                if owner[begin] != text or begin - last > n_words or begin - first > 4 * n_words:
                    break
                last = begin
                at += 1
            slack = int(self.rate * n_words)
            yield text, item, first - slack, last + n_words + slack


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of a bounded size."""
    n = benchmark.count()
    blocks = -(-n // block_items)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for block in range(blocks):
        rows = benchmark.where(place == block).select("item_id", "text").distinct().collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    min_words: int = MIN_WORDS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """doc_id, item_id, edits, item_words, begin, end: the best stretch of a text for each item it holds.

    A text holds an item if some stretch of its words is at most ``rate`` edits for
    each word of the item away from it; ``begin`` and ``end`` count words. All texts
    are searched whole. Null and empty texts hold nothing; items that are null or
    shorter than ``min_words`` are not searched for. Repeated items with one text and
    id count once, repeated documents each have their rows. Items are searched in
    blocks of ``block_items``, one pass over the texts each, so what a pass carries
    does not grow with the benchmark.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = "doc_id {}, item_id {}, edits long, item_words long, begin long, end long".format(*kinds)
    names = ["doc_id", "item_id", "edits", "item_words", "begin", "end"]
    item_type = pa.string() if kinds[1] == "string" else pa.int64() if kinds[1] == "bigint" else pa.int32()
    found = None
    for items in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(BenchmarkIndex(items, rate, min_words))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(shared.value.hits([word_hashes(t) for t in batch["text"].to_pylist()]))
                rows, ids, *numbers = zip(*hits, strict=True) if hits else [()] * 6
                columns = [pa.array(ids, item_type), *(pa.array(n, pa.int64()) for n in numbers)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), *columns], names)

        part = docs.select("doc_id", "text").mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; a null doc_id is looked up by its text."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    held = contaminated(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias(row))
    return keyed.join(held.distinct(), row, "left_anti").select(*docs.columns)
