"""Token counts and packing against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest_llm import make_docs, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.common import shared_folder
from plumbline.llm.packing import best_fit_decreasing, cut_documents, pack, pack_documents, sequences
from plumbline.llm.shingles import WordHashes
from plumbline.llm.token_counts import count_tokens, stored_counts
from plumbline.llm.token_text import TextEncoder, tokenizer_version

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "a", "\n", " ", "  x", " a\n", "a \n b", "a\n\nb", "a\tb", "\na", "a\n", "tab\x1cx", "it's. don't, I'M. he's,",
    "<|endoftext|> x<|endoftext|>y. z", "é, É. ＡＢ. ǅ. 3. 4, a3.", "x́, ́a.", "ΑΣ. ΑΣ ß? İ. K. ﬁ. ſ, x", "l,'s x's's. A.'s",
    "🙂. a🙂, 🙂🙂 é", "中文。 中, 文.", "a" * 5000 + ". " + "b" * 50, "!!! ??? a.. b,. . , a", "\0 a \0b",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("max_words", [3, 100_000])
def test_ids_are_those_of_the_library(path, max_words):
    plain, own = Tokenizer.from_file(path), TextEncoder(path, max_words)
    texts = [*ODD, *(prose(n, 60) for n in range(20)), None]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t.,;'!aAbé中İßſ3\x85 ​̀🙂", max_size=40))
def test_any_text(text):
    for path in (BYTES, WORDS):
        expected = Tokenizer.from_file(path) if path not in _PLAIN else _PLAIN[path]
        _PLAIN[path] = expected
        own = _OWN.setdefault(path, TextEncoder(path))
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == expected.encode(text, add_special_tokens=False).ids


_PLAIN: dict = {}
_OWN: dict = {}


def test_counts_and_cache(spark):
    texts = [*ODD, None, "same text", "same text", "same text"]
    docs, cache = make_docs(spark, texts), shared_folder(spark, "counts")
    docs = docs.unionByName(docs.where("doc_id = 1"))
    plain = Tokenizer.from_file(BYTES)
    expected = Counter(
        (n, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for n, t in [*enumerate(texts), (1, texts[1])]
    )
    assert Counter(tuple(r) for r in count_tokens(docs, cache, BYTES).collect()) == expected
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    # A second call finds every count; a new text adds one.
    more = make_docs(spark, [*texts, "one more"])
    assert count_tokens(more, cache, BYTES).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert stored_counts(docs, cache, "other version").count() == 0
    assert tokenizer_version(BYTES) != tokenizer_version(WORDS)
    assert count_tokens(docs.limit(0), shared_folder(spark, "counts"), BYTES).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    found = {(r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, shared_folder(spark, "counts"), BYTES).collect()}
    assert found == {(None, 3, 2), (None, 1, 1), (1, 0, 0)}
    assert pack_documents(docs, WORDS).count() == 3


def plain_best_fit(lengths, capacity):
    """Item by item: the tightest open window, else a new one."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return Counter(free)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_runs_are_best_fit_decreasing(lengths):
    runs = best_fit_decreasing(Counter(lengths), 40)
    windows, placed = defaultdict(list), Counter()
    for length, _, count, per, window, offset in runs:
        placed[length] += count
        for n in range(count):
            windows[window + n // per].append((offset + n % per * length, length))
    assert placed == Counter(lengths)
    for spots in windows.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 40
    assert Counter(40 - sum(length for _, length in s) for s in windows.values()) == plain_best_fit(lengths, 40)


def test_pack_documents(spark):
    texts = [*ODD, None, prose(1, 30_000), *["copy of this"] * 400, *(prose(n, n * 7) for n in range(60))]
    docs = make_docs(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3"))
    pieces = cut_documents(docs, WORDS, with_ids=True).cache()
    packed = pack(pieces).collect()
    plain = Tokenizer.from_file(WORDS)
    rows = defaultdict(list)
    windows = defaultdict(list)
    for r in packed:
        rows[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for doc_id, found in rows.items():
        ids = np.array([*plain.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in found) == len(ids) * (2 if doc_id == 3 else 1)
        for r in found:
            part = ids[r.start : r.start + r.length].tobytes()
            assert (zlib.crc32(part), part, len(ids)) == (r.ids_crc32, r.ids, r.doc_tokens)
    assert len(rows) == len(texts)
    for spots in windows.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    whole = {r.sequence_id: (r.n_ids, len(r.ids)) for r in sequences(pack(pieces)).collect()}
    assert all(n * 4 == size for n, size in whole.values()) and len(whole) == len(windows)
    assert pack_documents(docs.limit(0), WORDS).count() == 0


def test_words_kept_by_a_worker_are_bounded():
    plain, own = Tokenizer.from_file(WORDS), TextEncoder(WORDS, max_words=300)
    often = [f"often{c}" for c in "abcdefghij"]
    for n in range(8):
        text = " ".join([*(f"x{n}y{k}" for k in range(100)), *often])
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(own.words) <= 300 and (n == 0 or own.words.keys() >= set(often))
    most = TextEncoder(WORDS)
    many = [" ".join(f"x{n}y{k}" for k in range(n * 50_000, (n + 1) * 50_000)) for n in range(5)]
    for text in many:
        most.encode_all([text])
    assert len(most.words) <= 200_000
    hashes = WordHashes()
    for text in many:
        assert [hashes[w] for w in text.split()[:3]] == [xxhash.xxh64_intdigest(w) for w in text.split()[:3]]
        any(hashes[w] is None for w in text.split())
        assert len(hashes) <= 100_000


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_forms_of_a_word_are_kept_once(path):
    plain, own = Tokenizer.from_file(path), TextEncoder(path)
    stems = [f"{a}an{b}" for a in "bdfgkéñø" for b in "lmrstöß"]
    cases = stems if path == BYTES else [*stems, *(w.capitalize() for w in stems), *(w.upper() for w in stems if "ß" not in w)]
    words = [w + marks for w in cases for marks in ("", ".", ",", "!!", "***", "?)...")]
    for text in (" ".join(["", *words]), "\n".join(words) if path == WORDS else " ".join(["x", *reversed(words)])):
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(own.words) <= len(stems) + 2


def test_words_at_the_edge_of_the_columns():
    words = ["İx", "xİ.", "Ⱥb", "ⱥ.", "ſ", "ŉa,", "a×b", "×", "÷.", "Ÿ", "ĳ", "Ĳ.", "ǅ", "ɐa", "é" * 41 + ".", "a" * 41, "É" * 40, "a.b.", ".a", "..", "ª", "µ."]
    texts = [" ".join(words), *words, " ".join(w + " " + w.swapcase() for w in words), *(w + " a" for w in words), *("a " + w for w in words)]
    for path in (BYTES, WORDS):
        plain, own = Tokenizer.from_file(path), TextEncoder(path)
        for text, ids in zip(texts, own.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
