"""Language identification with bit-sliced Bloom filters over letter n-grams.

Each slot of the filter is one word with a bit per language, so one lookup (k
slots, joined by AND) returns every language that holds an n-gram; each 63 languages
have a word of their own in every slot. A text's count for a language is the number of
its n-grams with that bit, less the ones that the filter is expected to report by
mistake.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import small_batches

UNDETERMINED = "und"
SIZE = 3
HASHES = 3
#: An n-gram belongs to a language if at least this share of its texts has it ...
MIN_SHARE = 0.002
#: ... and this part of the share in the language where it is most common.
PART_OF_LARGEST = 0.3
#: Slots for each n-gram and hash; a power of two above is taken.
SLOTS_PER_GRAM = 8
#: Languages of one word.
WORD_LANGUAGES = 63
#: N-grams that a worker holds before it passes counts on.
HELD_GRAMS = 1_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, size: int = SIZE) -> np.ndarray:
    """Hashes of the letter n-grams of a whole text, in lower case; words have a blank on either side."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint64)
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if len(codes) < size:
        codes = np.concatenate((codes, np.zeros(size - len(codes), np.uint64)))
    key = np.zeros(len(codes) - size + 1, np.uint64)
    for at in range(size):
        key = key * np.uint64(0x110001) + codes[at : at + len(key)]
    return _mix(key + _M1)


def _slots(gram: np.ndarray, hashes: int, n_slots: int) -> Iterator[np.ndarray]:
    """Places of n-grams in the filter by double hashing; ``n_slots`` is a power of two."""
    first, step = gram, (gram >> np.uint64(32)) | np.uint64(1)
    for number in range(hashes):
        yield ((first + np.uint64(number) * step) & np.uint64(n_slots - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``words`` has a row of slots for each WORD_LANGUAGES languages, with a bit for each; ``mistakes`` the false positive rates."""

    languages: list[str]
    words: np.ndarray
    hashes: int
    size: int
    mistakes: np.ndarray

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """All languages that hold each n-gram, a row for each row of ``words``."""
        found = None
        for slot in _slots(gram, self.hashes, self.words.shape[1]):
            found = self.words[:, slot] if found is None else found & self.words[:, slot]
        return found

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and share of the text's n-grams that it explains; ``und`` without letters."""
        each = [grams(t, self.size) for t in texts]
        ends = np.cumsum([len(g) for g in each])
        n = np.diff(ends, prepend=0)
        if not self.languages or not len(each) or not ends[-1]:
            return [(UNDETERMINED, 0.0)] * len(texts)
        masks = self.masks(np.concatenate(each))
        counts = np.zeros((len(texts), len(self.languages)))
        for number in range(len(self.languages)):
            row, bit = masks[number // WORD_LANGUAGES], masks.dtype.type(number % WORD_LANGUAGES)
            running = np.concatenate(([0], np.cumsum((row >> bit) & masks.dtype.type(1), dtype=np.int64)))
            counts[:, number] = running[ends] - running[ends - n]
        expected = n[:, None] * self.mistakes
        counts = np.maximum(counts - expected, 0) / np.maximum(1 - self.mistakes, 1e-9)
        best = counts.argmax(axis=1)
        shares = np.clip(counts[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        return [
            (self.languages[b], float(s)) if k else (UNDETERMINED, 0.0)
            for b, s, k in zip(best, shares, n, strict=True)
        ]


def _gram_counts(docs: DataFrame, size: int) -> DataFrame:
    """(lang, gram, n_texts) added up within partitions."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram = np.concatenate([g for g, _ in parts])
        count = np.concatenate([c for _, c in parts])
        order = np.argsort(gram, kind="stable")
        gram, count = gram[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        return gram[first], np.add.reduceat(count, first)

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, count = merged(parts)
            columns = [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(count)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n_texts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                gram = np.unique(grams(text, size))
                if len(gram):
                    held.setdefault(lang, []).append((gram, np.ones(len(gram), np.int64)))
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            if sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n_texts long")
    return counts.groupBy("lang", "gram").agg(F.sum("n_texts").alias("n_texts"))


def learn(
    docs: DataFrame,
    size: int = SIZE,
    hashes: int = HASHES,
    min_share: float = MIN_SHARE,
    part_of_largest: float = PART_OF_LARGEST,
) -> LanguageFilter:
    """Filters from all rows of ``docs`` (lang, text) with a language.

    N-grams are counted per language over all texts. Since each text has a bounded
    number of them, at most (mean n-grams of a text) / ``min_share`` of a language
    pass; only the filled slots for those come to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1), np.uint8), hashes, size, np.zeros(0))
    n_words = -(-len(languages) // WORD_LANGUAGES)
    numbered = [(x, n // WORD_LANGUAGES, 1 << n % WORD_LANGUAGES, totals[x]) for n, x in enumerate(languages)]
    numbers = spark.createDataFrame(numbered, "lang string, word int, flag long, n long")
    shares = _gram_counts(known, size).join(F.broadcast(numbers), "lang")
    shares = shares.select("gram", F.struct((F.col("n_texts") / F.col("n")).alias("share"), "word", "flag").alias("one"))
    by_gram = shares.groupBy("gram").agg(F.collect_list("one").alias("all"), F.max("one.share").alias("top"))
    chosen = F.filter("all", lambda x: (x["share"] >= min_share) & (x["share"] >= F.col("top") * part_of_largest))

    def mask(word: int):
        own = F.filter("chosen", lambda x: x["word"] == word)
        return F.aggregate(own, F.lit(0).cast("long"), lambda done, x: done.bitwiseOR(x["flag"]))

    words_of = F.array(*(F.struct(F.lit(w).alias("word"), mask(w).alias("mask")) for w in range(n_words)))
    held = by_gram.where(F.col("top") >= min_share).select("gram", chosen.alias("chosen"))
    kept = held.select("gram", F.inline(words_of)).where("mask != 0").cache()
    n_slots = 1 << max(10, (kept.select("gram").distinct().count() * hashes * SLOTS_PER_GRAM - 1).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = batch["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            for slot in _slots(gram, hashes, n_slots):
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch["word"], batch["mask"]], ["slot", "word", "mask"])

    placed = kept.mapInArrow(place, "slot long, word int, mask long")
    filled = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    kept.unpersist()
    bits = next(b for b in (8, 16, 32, 64) if b >= min(len(languages), WORD_LANGUAGES))
    words = np.zeros((n_words, n_slots), np.dtype(f"u{bits // 8}"))
    words[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["mask"].to_numpy().astype(words.dtype)
    one = words.dtype.type(1)
    fill = np.array([np.count_nonzero(words[n // WORD_LANGUAGES] >> words.dtype.type(n % WORD_LANGUAGES) & one) for n in range(len(languages))])
    return LanguageFilter(languages, words, hashes, size, (fill / n_slots) ** hashes)


def _shared(spark: SparkSession, model: LanguageFilter):
    """The filter on every executor; its size does not depend on the number of texts."""
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: LanguageFilter, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All columns of ``docs``, with ``pred`` and ``score``, from the whole ``text``.

    A text that is null or has no letter is ``und`` with score 0. Rows stay as they
    are, repeated ones included. A tie goes to the language that sorts first. Columns of
    ``docs`` that have the names of the new ones give way to them.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, model)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())))
    names = docs.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.decide(batch["text"].to_pylist())
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *columns], [*names, pred, score])

    found = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *found])
    return docs.mapInArrow(decide, schema)
