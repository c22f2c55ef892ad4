"""Toxicity scores by a support vector machine on a gap-weighted subsequence kernel.

The kernel of two strings sums, over all letter sequences of a fixed length that
occur in both with gaps, a weight that falls with the spans they take up. Insults
with inserted, left out or appended letters keep most of their subsequences. A
sentence is seen through its windows (words, and neighbouring short pieces written
together); it is as toxic as its worst window, and a text as its worst sentence.
Nyström features relate a window to landmark words; a linear support vector
machine on these features is trained on labelled sentences. Since the machine is
linear, its score is one weight for each subsequence, which is what the workers use.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import small_batches

#: Letters of a subsequence, the longest stretch it may take up, and the price of each letter of it.
LENGTH, SPAN, DECAY = 4, 6, 0.5
#: Subsequences are told apart by this many bits of a hash.
BITS = 20
#: Longer words are read in overlapping pieces.
PIECE, STEP = 20, 14
LANDMARKS = 400
#: Labelled texts of each label that the machine is trained on, the first by a hash of their id.
SAMPLE = 1500
#: Other labelled texts, of each label, on which the scores are turned into probabilities.
CALIBRATION = 1000
#: Rounds of training, and the windows of texts without toxic label that each round takes.
ROUNDS, NEGATIVES = 4, 8000

SENTENCE = re.compile(r"[^.!?\n]+")
#: Three or more short pieces in a row may be a word that was written apart.
APART = re.compile(r"(?<!\S)(?:[^\W_]{1,2}[^\w\s]?\s){2,}[^\W_]{1,2}(?![^\W_])")
# Characters that are written for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})


@cache
def _offsets() -> tuple[tuple[tuple[int, ...], float], ...]:
    """Places of a subsequence's letters after its first one, with the weight of the stretch."""
    rest = itertools.combinations(range(1, SPAN), LENGTH - 1)
    return tuple(((0, *r), DECAY ** (r[-1] + 1)) for r in rest)


class Folded(dict):
    """Written word to its letters, without case or marks; lookalikes inside a word become letters."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        text = word
        if not word.isalpha() and any(c.isalpha() for c in word):
            text = word.rstrip("!|.,;:?").translate(LOOKALIKES)
        if not text.isascii():
            text = unicodedata.normalize("NFKC", text)
        self[word] = folded = "".join(c for c in text.casefold() if c.isalpha())
        return folded


_FOLDED = Folded()


def windows(sentence: str) -> set[str]:
    """Letters of each word, and of each row of short pieces written together."""
    found = set(map(_FOLDED.__getitem__, sentence.split()))
    for row in APART.findall(sentence):
        found.add("".join(map(_FOLDED.__getitem__, row.split())))
    found.discard("")
    return found


def pieces(window: str) -> list[str]:
    """The window with its beginning marked, in overlapping parts if it is long."""
    marked = "^" + window
    return [marked[at : at + PIECE] for at in range(0, max(1, len(marked) - PIECE + STEP), STEP)]


@cache
def _primes() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(n)) | 1 for n in range(LENGTH)], np.uint64)


def features(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of all subsequences, a row for each string; weight 0 where there is none.

    Rows have length 1 unless a string is too short for any subsequence. A string
    that holds one subsequence twice is rare enough to count both as two.
    """
    codes = np.zeros((len(strings), PIECE + SPAN), np.uint64)
    flat = np.frombuffer("".join(s.ljust(PIECE, "\0") for s in strings).encode("utf-32-le"), "<u4")
    codes[:, :PIECE] = flat.reshape(len(strings), PIECE)
    scaled = [codes * p for p in _primes()]
    n, width = len(_offsets()), PIECE - LENGTH + 1
    places = np.empty((len(strings), n, width), np.int32)
    weights = np.empty((len(strings), n, width), np.float32)
    for at, (offset, weight) in enumerate(_offsets()):
        key = sum(c[:, o : o + width] for o, c in zip(offset, scaled, strict=True))
        key ^= key >> np.uint64(31)
        places[:, at] = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        weights[:, at] = np.where(codes[:, offset[-1] : offset[-1] + width] > 0, np.float32(weight), np.float32(0))
    places, weights = places.reshape(len(strings), -1), weights.reshape(len(strings), -1)
    norms = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
    return places, weights / np.maximum(norms, 1e-9)


@dataclass
class ToxicityModel:
    """A weight for each subsequence, the machine's offset, and the slope and offset of the probability."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def window_scores(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        for at in range(0, len(strings), 4096):
            place, weight = features(strings[at : at + 4096])
            out[at : at + 4096] = np.einsum("ij,ij->i", self.weights[place], weight)
        return out + self.offset

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -40, 40)))


class WindowScores(dict):
    """Score of each window met by a worker; long windows and a full table are scored anew."""

    def __init__(self, model: ToxicityModel, most: int = 400_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def meet(self, found: set[str]) -> None:
        new = list(found.difference(self))
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(found)
        parts = [pieces(w) for w in new]
        scores = self.model.window_scores(list(itertools.chain.from_iterable(parts)))
        ends = np.cumsum([len(p) for p in parts])
        if len(new):
            self.update(zip(new, np.maximum.reduceat(scores, np.r_[0, ends[:-1]]).tolist(), strict=True))


def worst_windows(texts: list[str | None], scores: WindowScores, none: float) -> np.ndarray:
    """Highest score of any window in any sentence of each text; ``none`` without any."""
    found = [windows(t or "") for t in texts]
    scores.meet(set().union(*found))
    return np.array([max(map(scores.__getitem__, f), default=none) for f in found])


def _odds(sentences: list[set[str]], labels: np.ndarray) -> np.ndarray:
    """First guess at the weight of each subsequence: standard deviations by which toxic texts hold it more often."""
    seen = np.zeros((2, 1 << BITS))
    for found, label in zip(sentences, labels, strict=True):
        if found:
            place, weight = features(list(found))
            seen[int(label)][np.unique(place[weight > 0])] += 1
    n = np.maximum(1, np.bincount(labels, minlength=2))[:, None]
    rates, both = seen / n, seen.sum(axis=0) / n.sum()
    spread = np.sqrt(both * (1 - both) * (1 / n).sum())
    return np.maximum(0, (rates[1] - rates[0]) / np.maximum(spread, 1e-9)).astype(np.float32)


class Landmarks:
    """Nyström features: the kernel with each landmark, times the inverse root of theirs."""

    def __init__(self, strings: list[str]) -> None:
        place, weight = features(strings)
        self.used, column = np.unique(place, return_inverse=True)
        explicit = np.zeros((len(strings), len(self.used)))
        np.add.at(explicit, (np.arange(len(strings))[:, None], column.reshape(place.shape)), weight)
        values, vectors = np.linalg.eigh(explicit @ explicit.T)
        keep = values > 1e-3 * values.max()
        self.table = explicit.T @ (vectors[:, keep] / np.sqrt(values[keep]))
        self.lookup = np.full(1 << BITS, len(self.used), np.int32)
        self.lookup[self.used] = np.arange(len(self.used))

    def features(self, strings: list[str]) -> np.ndarray:
        out = np.empty((len(strings), self.table.shape[1]))
        for at in range(0, len(strings), 512):
            place, weight = features(strings[at : at + 512])
            dense = np.zeros((len(place), len(self.used) + 1))
            np.add.at(dense, (np.arange(len(place))[:, None], self.lookup[place]), weight)
            out[at : at + 512] = dense[:, :-1] @ self.table
        return out

    def weights(self, theta: np.ndarray) -> np.ndarray:
        """The machine as one weight for each subsequence."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.used] = self.table @ theta
        return out


def _train(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """The machine, from the sentences of labelled texts.

    A toxic text has some toxic sentence, but which one is not told. Each round trains
    on the worst window of every toxic text, as the round before sees it, against the
    worst windows of sentences without toxic label and a spread of their others.
    """
    held = [{p for sentence in SENTENCE.findall(t) for w in windows(sentence) for p in pieces(w)} for t in texts]
    good = sorted(set().union(*(h for h, y in zip(held, labels, strict=True) if not y)))
    toxic = [sorted(h) for h, y in zip(held, labels, strict=True) if y and h]
    only = sorted(set().union(*toxic))
    model = ToxicityModel(_odds(held, labels), 0.0, 4.0, 0.0)
    spread = sorted(good, key=xxhash.xxh32_intdigest)
    marks = None
    for _ in range(ROUNDS):
        guess = dict(zip(only, model.window_scores(only).tolist(), strict=True))
        bad = sorted({max(words, key=guess.__getitem__) for words in toxic})
        near = np.argsort(-model.window_scores(good), kind="stable")[: NEGATIVES // 2]
        against = list(dict.fromkeys([*(good[n] for n in near), *spread[: NEGATIVES // 2]]))
        if marks is None:
            best = sorted(only, key=lambda w: -guess[w])[: LANDMARKS // 2]
            chosen = dict.fromkeys([*best, *against[: LANDMARKS // 4], *spread[: LANDMARKS // 4]])
            marks = Landmarks(list(chosen))
        x = marks.features([*bad, *against])
        y = np.r_[np.ones(len(bad)), -np.ones(len(against))]
        share = np.where(y > 0, 0.5 / max(1, len(bad)), 0.5 / max(1, len(against)))
        theta, offset = _svm(x, y, share)
        model = ToxicityModel(marks.weights(theta), offset, 4.0, 0.0)
    return model


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    rate = 1 / (2 * np.linalg.norm(a * np.sqrt(share)[:, None], 2) ** 2 + 2 * penalty)
    w = ahead = np.zeros(a.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (a @ ahead))
        slope = -2 * a.T @ (share * y * slack) + 2 * penalty * ahead
        new = ahead - rate * slope
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _probability_line(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, which passes 0.5 where fewest labels are told wrong."""
    if not len(labels) or labels.min() == labels.max():
        return 4.0, 0.0
    order = np.argsort(worst, kind="stable")
    s, y = worst[order], labels[order]
    wrong = np.r_[0, np.cumsum(y == 1)] + np.r_[np.cumsum((y == 0)[::-1])[::-1], 0]
    low = np.r_[s[0] - 1, s]
    high = np.r_[s, s[-1] + 1]
    best = np.flatnonzero((wrong == wrong[(high > low)].min()) & (high > low))
    widest = best[np.argmax((high - low)[best])]
    cut = (low[widest] + high[widest]) / 2
    return 6.0, -6.0 * float(cut)


def sampled(docs: DataFrame, labels: DataFrame, n: int, salt: int) -> list[tuple[str, int]]:
    """Texts and labels of at most ``n`` ids of each label, the first by a hash of the id.

    The ids are chosen among the labels, and repeated rows of an id give one text, the
    smallest, so the broadcast and the result are as bounded as ``n``, whatever the size
    of the tables.
    """
    keyed = labels.select("doc_id", "toxic", F.xxhash64(F.lit(salt), "doc_id").alias("_k"))
    parts = [keyed.where(F.col("toxic") == y).orderBy("_k", "doc_id").limit(n) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select("doc_id", "toxic")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"]))]


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION
) -> ToxicityModel:
    """Train on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0 or 1).

    Bounded samples by hash: ``sample`` ids of each label train the machine and
    ``calibration`` others set the probability. Labels that are null, or whose text is
    null or missing, are no examples. Without examples of both labels every score is
    below 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    pick = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3))
    rows = sampled(docs, known.where(pick != 0), sample, 1)
    checks = sampled(docs, known.where(pick == 0), calibration, 2)
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), -1.0, 4.0, 0.0)
    model = _train([t for t, _ in rows], labels)
    tests = checks if len({y for _, y in checks}) == 2 else rows
    worst = worst_windows([t for t, _ in tests], WindowScores(model), -1.0)
    model.slope, model.shift = _probability_line(worst, np.array([y for _, y in tests]))
    return model


def score(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` with ``name`` (0 to 1), from the whole ``text``.

    A text without letters, and a null one, scores as a text without any toxic
    window. Rows stay as they are. A column of ``docs`` with this name gives way.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c.lower() != name.lower()))
    names = docs.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowScores(shared.value)
        for batch in batches:
            worst = worst_windows(batch["text"].to_pylist(), known, -1.0)
            found = pa.array(shared.value.probability(worst))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), found], [*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(read, schema)
