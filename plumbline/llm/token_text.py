"""Token ids of texts, with the ids of recurring words kept per worker.

The byte-level and the word-end vocabularies cut a text at white space before
they merge bytes: no token crosses the place in front of a single space or
either side of a single line end, nor the place between a letter and the marks
that end a word. The ids of a text are therefore the ids of its words in order, and a word
met before needs no second encoding. Words of Latin letters are known by their stem,
without last marks and, where the vocabulary folds case, capitals. Texts with other white space (tabs, two
spaces in a row) go through the tokenizer whole, so the ids are those of the
library in every case.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, to one of the libraries at least, other than space and line end.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Marks that neither join letters nor begin or end a special string.
_MARKS = ".,;:!?*#$%&()"
#: Letters below this are letters in every version of the character tables.
_LATIN = "ɐ"
#: Letters up to U+017F of which each has one letter in lower case, no further than that.
_LETTERS = ascii_letters + "".join(map(chr, {*range(0xC0, 0x180)} - {0xD7, 0xF7, 0x130}))
#: Characters of the texts that are worked on together.
_PIECE = 4_000_000


def id_bytes(ids) -> bytes:
    """Little-endian 32-bit ids."""
    return np.asarray(ids, dtype="<u4").tobytes()


def _strung(table: np.ndarray, begin: np.ndarray, length: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``begin`` … ``begin + length - 1`` of ``table`` for all places in turn, and where each place ends."""
    n = length[places]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
    spots = np.repeat((begin[places] - ends + n).astype(kind), n)
    spots += np.arange(total, dtype=kind)
    return table[spots], ends


def _plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or (max(word) < _LATIN and len(word.lower()) == len(word)))


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as a table for ``translate``.

    Bytes that are visible in Latin-1 stand for themselves, the others for the letters from 256 on.
    """
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + n for n, b in enumerate(hidden)}


class WordIds(dict):
    """Word to the ids of the word with what leads it in a text (``lead``, a space or nothing).

    A word that begins with a line end is not led by a space. ``marks`` has the ids
    of rows of marks that end words. Between two groups of texts at most ``max_words``
    words are kept. Beyond that, half as many stay, first those that came in more than one
    group, since most words come once and would only fill memory.
    """

    def __init__(self, tokenizer, lead: str, folds_case: bool, max_words: int, max_chars: int) -> None:
        super().__init__()
        self.tokenizer, self.lead, self.folds_case = tokenizer, lead, folds_case
        self.max_words, self.max_chars = max_words, max_chars
        self.marks: dict[str, bytes] = {}
        self.again: dict[str, None] = {}
        self.model, self.letters = tokenizer.model, byte_letters()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _base(self, word: str) -> str:
        """The word without last marks and capitals, where that cannot change its other ids."""
        stem = word if word.isalpha() else word.rstrip(_MARKS)
        if len(stem) < len(word) and not _plain(stem[-1:]):
            stem = word
        return stem.lower() if self.folds_case and (stem.isascii() or _plain(stem)) else stem

    def _mark_ids(self, marks: str) -> bytes:
        if not marks:
            return b""
        ids = self.marks.get(marks)
        if ids is None:
            ids = id_bytes(self._encode(marks))
            if len(marks) <= 4:
                self.marks[marks] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        base = self._base(word)
        if base != word:
            ids = self[base] + self._mark_ids(word[len(base) :])
        else:
            ids = id_bytes(self._encode(word if word.startswith("\n") else self.lead + word))
        if len(word) <= self.max_chars:
            self[word] = ids
        return ids

    def make_room(self) -> None:
        """After a group of texts: if there are too many words, keep those that were met again, then the newest."""
        if len(self) > self.max_words:
            half = self.max_words // 2
            kept = dict.fromkeys([*islice(self.again, half), *islice(reversed(self), half)])
            kept = [(w, self[w]) for w in islice(kept, half)]
            self.clear()
            self.update(kept)
            self.again = {}

    def meet(self, words: Iterable[str]) -> None:
        """Learn the plain words among ``words`` that are not known yet, and their forms with marks and capitals.

        Neither the normaliser nor the split of the tokenizer changes a plain word, so its
        model and its byte alphabet alone give the ids.
        """
        words = list(words)
        self.again.update((w, None) for w in words if w in self)
        forms = [(w, self._base(w)) for w in words if w not in self]
        new = [
            w for w in dict.fromkeys(base for _, base in forms)
            if w not in self and len(w) <= self.max_chars and _plain(w) and (not self.folds_case or w == w.lower())
        ]
        told = self._letters_of(new)
        lead, tokenize = "".join(chr(self.letters[ord(c)]) for c in self.lead), self.model.tokenize
        for word, letters in zip(new, told, strict=True):
            self[word] = array("I", [t.id for t in tokenize(lead + letters)]).tobytes()
        for word, base in forms:
            if word != base and base in self and len(word) <= self.max_chars:
                self[word] = self[base] + self._mark_ids(word[len(base) :])

    def _letters_of(self, words: list[str]) -> list[str]:
        """The words in the byte alphabet of the vocabulary."""
        if not words:
            return []
        return "\n".join(words).encode().decode("latin-1").translate(self.letters).split(chr(self.letters[10]))

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of different stems, words of ``_LETTERS`` in the case that the vocabulary has."""
        found = list(map(self.get, stems))
        self.again.update(dict.fromkeys(w for w, ids in zip(stems, found, strict=True) if ids is not None))
        new = [n for n, ids in enumerate(found) if ids is None]
        tokenize, lead = self.model.tokenize, "".join(chr(self.letters[ord(c)]) for c in self.lead)
        for n, letters in zip(new, self._letters_of([stems[n] for n in new]), strict=True):
            word = stems[n]
            if len(word) <= self.max_chars:
                self[word] = found[n] = array("I", [t.id for t in tokenize(lead + letters)]).tobytes()
            else:
                found[n] = id_bytes(self._encode(self.lead + word))
        return found

    def code(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words in a row, and how many each word has.

        Most words are Latin letters and marks behind them. These are taken apart by columns:
        only different stems and different rows of marks are looked up, and only stems are
        kept, not each of their forms. The other words are looked up as they are.
        """
        marks = pc.utf8_ltrim(words, _LETTERS)
        simple = pc.and_(pc.equal(pc.ascii_ltrim(marks, _MARKS), ""), pc.less(pc.binary_length(marks), pc.binary_length(words)))
        marks = marks.filter(simple).dictionary_encode()
        stems = pc.ascii_rtrim(words.filter(simple), _MARKS)
        stems = (pc.utf8_lower(stems) if self.folds_case else stems).dictionary_encode()
        rest = words.filter(pc.invert(simple)).to_pylist()
        self.meet(rest)
        parts = self._stems(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        parts += map(self._mark_ids, marks.dictionary.to_pylist())
        parts += [self[w] if w or self.lead else b"" for w in rest]
        parts.append(b"")

        simple = simple.to_numpy(zero_copy_only=False)
        pairs = np.full((len(words), 2), len(parts) - 1, np.int64)
        pairs[simple, 0] = stems.indices.to_numpy()
        pairs[simple, 1] = marks.indices.to_numpy() + len(stems.dictionary)
        pairs[~simple, 0] = np.arange(len(rest)) + len(stems.dictionary) + len(marks.dictionary)
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        table = np.frombuffer(b"".join(parts), "<u4")
        return _strung(table, np.cumsum(length) - length, length, pairs.ravel())[0], length[pairs].sum(axis=1)


class TextEncoder:
    """Ids of whole texts by a tokenizer file, without added begin or end tokens."""

    def __init__(self, path: str, max_words: int = 200_000, max_chars: int = 40) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers") or [{}]
        kinds = {step.get("type") for step in norm.get("normalizers", [])}
        #: White space is part of the tokens, or it is dropped; other tokenizers get whole texts.
        self.keeps_space = pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex") and not pre["add_prefix_space"]
        self.drops_space = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        lead = " " if self.keeps_space else ""
        self.words = WordIds(self.tokenizer, lead, self.drops_space and "Lowercase" in kinds, max_words, max_chars)

    def _whole(self, text: str) -> bytes:
        return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _spaced(self, text: str | None) -> str | None:
        """A text whose words stand between single spaces; None where the text must be encoded whole."""
        if not text or _ODD.search(text):
            return None
        if self.drops_space:
            return text.replace("\n", " ")
        if self.keeps_space and not any(pair in text for pair in _PAIRS):
            return text.replace("\n", " \n")
        return None

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of spaced texts: each different word is looked up once, and its ids are taken for all its places."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        different, places = coded.dictionary, coded.indices.to_numpy()
        table, length = self.words.code(different)
        self.words.make_room()
        if self.keeps_space:
            # No space stands in front of the first word of a text.
            first = coded.indices.take(starts[:-1]).dictionary_encode()
            ids = [self._whole(w) if w else b"" for w in different.take(first.dictionary).to_pylist()]
            places = places.copy()
            places[starts[:-1]] = first.indices.to_numpy() + len(length)
            table = np.concatenate([table, np.frombuffer(b"".join(ids), "<u4")])
            length = np.concatenate([length, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])
        out, ends = _strung(table, np.cumsum(length) - length, length, places)
        cuts = np.concatenate([[0], ends])[starts]
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null. A text is encoded once, however often it comes."""
        found: dict[str | None, bytes] = {None: b"", "": b""}
        group, held = {}, 0
        for text in texts:
            if text in found or text in group:
                continue
            spaced = self._spaced(text)
            if spaced is None:
                found[text] = self._whole(text)
                continue
            group[text] = spaced
            held += len(spaced)
            if held >= _PIECE:
                found.update(zip(group, self._by_words(list(group.values())), strict=True))
                group, held = {}, 0
        if group:
            found.update(zip(group, self._by_words(list(group.values())), strict=True))
        return [found[t] for t in texts]


def together(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.Table]:
    """Neighbouring batches as one table, as far as the texts together are no longer than some words' worth of memory."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= _PIECE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and file."""
    return TextEncoder(path)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library's version."""
    import tokenizers

    digest = hashlib.sha256(tokenizers.__version__.encode())
    with open(path, "rb") as file:
        for block in iter(lambda: file.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()
