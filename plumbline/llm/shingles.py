"""Word n-gram sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word; the table starts anew when it is full."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = WordHashes()


def words_of(text: str | None) -> list[str]:
    """Words of a text in lower case: runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each two words that follow each other."""
    return mix(first * _BASE + second)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Distinct n-grams of words; a text of fewer words is one n-gram, a text of none has none."""
    words = word_hashes(text)
    if len(words) == 0:
        return words
    size = min(n, len(words))
    key = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        key = key * _BASE + words[at : at + len(key)]
    return np.unique(mix(key + np.uint64(size)))
