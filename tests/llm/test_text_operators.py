"""Language ID, near copies, benchmark passages and toxicity on small fixtures."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest_llm import make_docs, prose

from plumbline.llm import components, decontamination, jaccard_join, language_id, toxicity
from plumbline.llm.shingles import shingle_set, word_hashes


def test_language_filter(spark):
    texts = [prose(n, 40, "aeiounrst") for n in range(30)] + [prose(n, 40, "bcdfgkwz") for n in range(30)]
    langs = {n: "xx" if n < 30 else "yy" for n in range(60)}
    docs = make_docs(spark, texts, langs)
    model = language_id.learn(docs.unionByName(docs.limit(1).selectExpr("doc_id", "text", "cast(null as string) lang", *docs.columns[3:])))
    assert model.languages == ["xx", "yy"]
    tests = [prose(99, 30, "aeiounrst"), prose(98, 30, "bcdfgkwz"), None, "", "12 34 !?", "ç" * 3, prose(97, 60_000, "bcdfgkwz")]
    found = language_id.identify(make_docs(spark, tests), model)
    assert found.columns == [*docs.columns, "lang_pred", "lang_score"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in found.collect()}
    assert [got[n][0] for n in range(5)] == ["xx", "yy", "und", "und", "und"]
    assert got[5] == ("xx", 0.0) and got[6][0] == "yy" and all(0 <= s <= 1 for _, s in got.values())
    empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs.limit(2), empty).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_filter_matches_plain_sets():
    """Without mistakes of the filter, counts are plain set lookups."""
    words = np.zeros((1, 1 << 16), np.uint8)
    one, two = language_id.grams("abc abd"), language_id.grams("abc xyz")
    for gram, bit in ((one, 1), (two, 2)):
        for slot in language_id._slots(gram, 3, words.shape[1]):
            np.bitwise_or.at(words[0], slot, bit)
    model = language_id.LanguageFilter(["p", "q"], words, 3, 3, np.zeros(2))
    assert set(model.masks(one)[0].tolist()) == {1, 3} and model.decide(["abd", "xyz", "1"]) == [("p", 1.0), ("q", 1.0), ("und", 0.0)]


def test_many_languages(spark):
    """More languages than one word holds; every text is of its own one."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4 * 130)]
    texts = [prose(n, 30, letters[4 * (n % 130) : 4 * (n % 130) + 4]) for n in range(260)]
    langs = {n: f"l{n % 130:03}" for n in range(260)}
    docs = make_docs(spark, texts, langs)
    model = language_id.learn(docs)
    assert len(model.languages) == 130 and model.words.shape[0] == 3
    assert all(r.lang_pred == r.lang and r.lang_score > 0.9 for r in language_id.identify(docs, model).collect())


def test_columns_with_the_names_of_results(spark):
    """Own columns give way to results of these names, and helper columns touch none."""
    docs = make_docs(spark, [prose(n, 40) for n in range(6)]).selectExpr("*", "'old' as lang_pred", "doc_id as Lang_Score", "doc_id as toxicity", "doc_id + 5 as _row")
    found = language_id.identify(docs, language_id.learn(docs))
    assert sorted(found.columns) == sorted([*(c for c in docs.columns if c != "Lang_Score"), "lang_score"])
    assert {r.lang_pred for r in found.collect()} == {"en"}
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(0 as int) as toxic").limit(0))
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(docs, model).collect())
    items = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    kept = decontamination.without_benchmark(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._row) for r in kept.collect()) == [(n, n + 5) for n in (0, 1, 2, 4, 5)]


@pytest.mark.parametrize("tables", [True, False])
def test_items_without_enough_recall_are_found_by_words(spark, monkeypatch, tables):
    if not tables:
        monkeypatch.setattr(decontamination, "choose_tables", lambda *args: None)
    random_words = np.random.default_rng(1)
    items = [(n, prose(n, 30 + n % 3)) for n in range(12)]
    texts = []
    for n, text in items:
        words = text.split()
        for at in random_words.integers(0, len(words), 3):
            words[at] = f"changed{at}"
        texts.append(f"{prose(100 + n, 50)} {' '.join(words)} {prose(200 + n, 50)}")
    docs = make_docs(spark, [*texts, prose(999, 400)])
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(n, n) for n in range(12)}


def plain_classes(rows, threshold=0.8):
    sets = {i: frozenset(shingle_set(t).tolist()) for i, t in rows}
    distinct = sorted({s for s in sets.values() if s}, key=sorted)
    links, parent = Counter(), {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, one in enumerate(distinct):
        for two in distinct[:a]:
            if len(one & two) >= threshold * len(one | two) - 1e-9:
                links[one] += 1
                links[two] += 1
                parent[root(one)] = root(two)
    lowest = {}
    for i, s in sets.items():
        if s:
            lowest[root(s)] = min(lowest.get(root(s), i), i)
    return {i: (lowest[root(s)], links[s], sum(t == s for t in sets.values()) - 1) if s else (i, 0, 0) for i, s in sets.items()}


@pytest.mark.parametrize("block_grams", [4_000, 250_000])
def test_jaccard_join(spark, block_grams):
    pick = random.Random(3)
    bases = [prose(n, pick.randint(5, 90)).split() for n in range(20)]
    texts = []
    for base, copies in zip([*bases, prose(77, 120).split()], [*(pick.randint(1, 5) for _ in bases), 80], strict=True):
        for _ in range(copies):
            copy = list(base)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = pick.choice(base)
            texts.append(" ".join(copy))
    texts += ["a b", "A, b!", "", None, "x", prose(5, 20_000), prose(5, 20_000) + " end", *["copy me now please again ok"] * 50]
    docs = make_docs(spark, texts)
    found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.jaccard_join(docs, block_grams=block_grams).collect()}
    assert found == plain_classes(list(enumerate(texts)))
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, *_) in found.items() if i == c)


def test_jaccard_join_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_copies) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == {(1, 1, 2): 2, (None, 1, 2): 1, (None, None, 0): 1}
    assert jaccard_join.one_of_each(docs).count() == 3
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0
    bands, rows = jaccard_join.choose_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands * rows <= jaccard_join.MAX_HASHES


def test_one_set_for_repeated_rows(spark):
    """A class sends its n-grams once, however many rows of its first doc_id there are, or of no doc_id."""
    text, other = prose(1, 60), prose(2, 60)
    rows = [(1, text)] * 30 + [(2, text + " end")] + [(None, other)] * 20 + [(4, other + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {}
    for t in {t for _, t in rows}:
        grams = shingle_set(t, jaccard_join.NGRAM)
        keys[t] = bytearray(jaccard_join.xxhash.xxh3_128_digest(grams.tobytes()))
    members = spark.createDataFrame(
        [(keys[text], 1, 1, 0, 1), (keys[text + " end"], 2, 1, 0, 1), (keys[other], None, 2, 0, 1), (keys[other + " end"], 4, 2, 0, 1)],
        "set_key binary, doc_id long, group long, block int, blocks int",
    )
    sets = jaccard_join._sets(docs, members, jaccard_join.NGRAM).collect()
    assert sorted(r.set_key for r in sets) == sorted(keys.values())
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == Counter({(1, 1, 1, 29): 30, (2, 1, 1, 0): 1, (None, 4, 1, 19): 20, (4, 4, 1, 0): 1})


def test_components(spark):
    pick = random.Random(1)
    edges = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 30)] + [(pick.randint(200, 260), pick.randint(200, 260)) for _ in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loose = {u for u, v in edges if u == v}
    assert {n: r for n, r in found.items()} == {n: root(n) for n in parent if n in found}
    assert set(parent) - set(found) <= loose


def plain_distance(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for n, word in enumerate(item, 1):
        new = [n]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (word != other), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    items = [prose(1000 + n, 12 + 3 * n) for n in range(12)]
    pick = random.Random(4)
    texts = []
    for n, item in enumerate(items):
        words = item.split()
        for _ in range(n % 3):
            words[pick.randrange(len(words))] = "changed"
        texts.append(f"{prose(n, 30)} {' '.join(words)} {prose(n + 50, 40)}")
        texts.append(" ".join(words))
    texts += [prose(n, 200) for n in range(300, 310)] + [None, "", "x", f"{prose(9, 9000)} {items[3].upper()}", " ".join([items[0]] * 30)]
    docs = make_docs(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (98, None), (99, "too short")], "item_id long, text string")
    found = decontamination.contaminated(docs, bench)
    got = {(r.doc_id, r.item_id): r.edits for r in found.collect()}
    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            words = word_hashes(item)
            best = plain_distance(words.tolist(), word_hashes(text).tolist())
            if best <= int(decontamination.RATE * len(words)):
                expected[d, i] = best
    assert got == expected
    clean = decontamination.without_benchmark(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    blocks = decontamination.contaminated(docs, bench, block_items=4)
    assert {(r.doc_id, r.item_id): r.edits for r in blocks.collect()} == expected
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_stretch():
    item, text = np.array([1, 2, 3, 4, 5], np.uint64), np.array([9, 9, 1, 2, 7, 4, 5, 8], np.uint64)
    assert decontamination.stretch_of(item, text) == (1, 2, 7)


def test_toxicity(spark):
    stems, pick = ["grumbolt", "snarkwit", "dulpate"], random.Random(2)
    texts, labels = [], []
    for n in range(240):
        words = prose(n, 40, "aeilnorst").split()
        if n % 3 == 0:
            words.insert(pick.randrange(40), pick.choice(stems) + pick.choice(["", "s", "ish", "er"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(n % 3 == 0))
    rows = [(n, t, y) for n, (t, y) in enumerate(zip(texts, labels, strict=True))] + [(990, None, 1), (991, "x", None)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(labelled.drop("toxic"), labelled.drop("text"))
    clean = prose(999, 40, "aeilnorst")
    tests = [clean, f"{clean} snarkwits", f"{clean} g-r-u-m-b-o-l-t", f"{clean} s n a r k w i t", f"{clean} grummbolt", None, "", "1 2", f"{prose(5, 20_000, 'aeilnorst')} dulpate"]
    docs = make_docs(spark, tests)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    assert [got[n] >= 0.5 for n in range(9)] == [False, True, True, True, True, False, False, False, True]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.learn(docs, labelled.drop("text").limit(0))
    assert all(r.toxicity < 0.5 for r in toxicity.score(docs, none).collect())


def test_sample_has_one_text_per_id(spark):
    docs = spark.createDataFrame([(1, "copy")] * 50 + [(1, "other")] * 3 + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.sampled(docs, labels, 5, 1) == [("copy", 1), ("b", 0)]


def test_kernel_features():
    """The explicit features give the kernel of the definition, but for a sequence that one string holds twice."""
    from itertools import combinations

    def plain(a, b):
        def weights(s):
            out = Counter()
            for spots in combinations(range(len(s)), toxicity.LENGTH):
                span = spots[-1] - spots[0] + 1
                if span <= toxicity.SPAN:
                    out["".join(s[i] for i in spots)] += toxicity.DECAY**span
            return out

        x, y = weights(a), weights(b)
        return sum(x[u] * y[u] for u in x)

    strings = ["^idiot", "^idxiot", "^stupid", "^clown"]
    place, weight = toxicity.features(strings)
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            if i < j:
                own = sum(w * v for p, w in zip(place[i], weight[i], strict=True) for q, v in zip(place[j], weight[j], strict=True) if p == q and w and v)
                assert own == pytest.approx(plain(a, b) / (plain(a, a) * plain(b, b)) ** 0.5, abs=0.01)


def test_few_keys_are_searched_and_none_is_lost():
    random = np.random.default_rng(4)
    strings = random.integers(1, 1 << 62, (30, 12)).astype(np.uint64)
    own = decontamination.SizeClass(12, 1, decontamination.choose_tables(strings, 1))
    own.fill(np.arange(30), strings)
    others = random.integers(1, 1 << 62, (200, 12)).astype(np.uint64)
    rows, items = own.candidates(np.concatenate([others, strings]))
    assert {(200 + n, n) for n in range(30)} <= set(zip(rows.tolist(), items.tolist()))
    keys = own.table_keys(others).ravel()
    assert own.sieve[own.keys.astype(np.uint16)].all() and own.sieve[keys.astype(np.uint16)].mean() < 0.2


def test_only_windows_with_pairs_of_an_item_are_embedded(monkeypatch):
    pick, asked = random.Random(8), []
    items = [(n, prose(3000 + n, 20)) for n in range(12)]
    words = [w for _, text in items for w in text.split()]
    near = []
    for _, text in items:
        copy = text.split()
        copy[len(copy) // 2] = "zzother"
        near.append(" ".join([*pick.choices(words, k=40), *copy, *pick.choices(words, k=40)]))
    index = decontamination.BenchmarkIndex(items)
    ask = decontamination.SizeClass.candidates
    monkeypatch.setattr(decontamination.SizeClass, "candidates", lambda own, strings: asked.append(len(strings)) or ask(own, strings))
    assert {(t, i) for t, i, *_ in index.hits([word_hashes(t) for t in near])} == {(n, n) for n in range(12)}
    asked.clear()
    # All words are those of items, in another order.
    assert not list(index.hits([word_hashes(" ".join(pick.choices(words, k=3000)))]))
    assert sum(asked) < 300
    # Items of one word have no pairs.
    short = decontamination.BenchmarkIndex([(1, "abc"), (2, "def")], min_words=1)
    assert {(t, i) for t, i, *_ in short.hits([word_hashes("x abc y"), word_hashes("def"), word_hashes("abc def")])} == {(0, 1), (1, 2), (2, 1), (2, 2)}


def test_windows_hold_enough_pairs():
    pick = random.Random(9)
    for _ in range(200):
        at = np.array(sorted(pick.sample(range(40), pick.randint(0, 20))), np.int64)
        width, least = pick.randint(2, 12), pick.randint(-1, 6)
        expected = [b for b in range(40) if sum(b <= x <= b + width - 2 for x in at) >= least]
        assert decontamination.BenchmarkIndex._begins(None, at, width, least, 40).tolist() == expected
