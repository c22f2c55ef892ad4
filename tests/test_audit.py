from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit as au
from plumbline.operators import contradictions as co
from plumbline.operators import coverage as cv
from plumbline.operators import duplicates as du
from plumbline.operators import metric_join
from plumbline.operators import staleness as st

AS_OF = "2024-01-01 00:00:00"


def docs_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def random_texts(n=60, seed=3):
    """Families of near copies, exact copies and word-order variants, one family hot."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    bases = [rng.sample(vocab, rng.randint(3, 20)) for _ in range(8)]
    texts = []
    for _ in range(n):
        words = list(bases[0] if rng.random() < 0.4 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rng.shuffle(words)
        texts.append(" ".join(words))
    return texts + ["", "  "]


def jac(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.92, 1.0])
def test_duplicate_texts_equal_brute_force(spark, threshold):
    texts = random_texts()
    got = du.duplicate_texts(docs_df(spark, texts), threshold).collect()
    pairs = [(i, j, jac(texts[i], texts[j])) for i, j in itertools.combinations(range(len(texts)), 2)]
    hits = [p for p in pairs if p[2] >= threshold]
    assert sum(r["n_pairs"] for r in got) == len(hits)
    exact = [p for p in hits if p[2] > 0.99]
    assert sum(r["n_pairs"] for r in got if r["kind"] == "exact") == len(exact)
    for r in got:
        if r["doc_b"] is not None:
            assert r["similarity"] == pytest.approx(jac(texts[r["doc_a"]], texts[r["doc_b"]]))


def test_few_texts_are_verified(spark):
    """Texts that share rare words by chance are told apart before their words are joined."""
    rng = random.Random(7)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(2000)], 120)) for _ in range(300)]
    texts += [t + " one more" for t in texts[:20]]
    groups = du._word_groups(docs_df(spark, texts)).withColumn("words", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    index = du._prefixes(groups, 0.8).cache()
    found = {(r["a_id"], r["b_id"]) for r in du._candidates(index, 0.8).collect()}
    close = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jac(texts[i], texts[j]) >= 0.8}
    by_word = index.toDF(*(f"{c}_b" for c in index.columns)).join(index, F.col("word") == F.col("word_b"))
    assert by_word.where("id < id_b").select("id", "id_b").distinct().count() > 1000
    assert {(min(p), max(p)) for p in found} >= close and len(found) < 2 * len(close)


def test_duplicate_texts_of_either_parities(spark, monkeypatch):
    """Sets with all parities, with half of them, and pairs of both."""
    monkeypatch.setattr(du, "HALF", 12)
    texts = random_texts(80, 5)
    got = du.duplicate_texts(docs_df(spark, texts), 0.7).agg(F.sum("n_pairs")).first()[0]
    pairs = [(a, b) for a, b in itertools.combinations(texts, 2) if jac(a, b) >= 0.7]
    sizes = [(len(set(a.split())) > 12) + (len(set(b.split())) > 12) for a, b in pairs]
    assert got == len(pairs) and set(sizes) == {0, 1, 2}


@pytest.mark.parametrize("threshold", [0.6, 0.92])
def test_duplicate_texts_with_crowded_buckets(spark, monkeypatch, threshold):
    """Few buckets and one word list of several slices change no pair."""
    monkeypatch.setattr(du, "FREQUENCY_BUCKETS", 4)
    monkeypatch.setattr(du, "PREFIX_WORDS", 30)
    texts = random_texts(80, 5)
    got = du.duplicate_texts(docs_df(spark, texts), threshold).agg(F.sum("n_pairs")).first()[0]
    assert got == sum(jac(a, b) >= threshold for a, b in itertools.combinations(texts, 2))


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_duplicate_vectors_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(metric_join, "CELL_ROWS", block_rows)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 4))
    vecs = [base[i % 6] + rng.normal(size=4) * 0.2 * (i % 3) for i in range(30)] + [np.zeros(4)] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id long, v array<double>")
    got = du.duplicate_vectors(df, 0.92).collect()

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / n if n else 0.0

    want = sum(cos(a, b) >= 0.92 for a, b in itertools.combinations(vecs, 2))
    assert sum(r["n_pairs"] for r in got) == want


def significant(t):
    return {w for w in t.lower().split() if len(w) > 4}


@pytest.mark.parametrize("max_pairs", [1, 7, 50, 10000])
def test_contradiction_candidates_equal_brute_force(spark, max_pairs):
    rng = random.Random(5)
    vocab = [f"word{i:02d}" for i in range(18)] + ["of", "the"]
    texts = ["lonely"] * 9 + [" ".join(rng.choices(vocab, k=8)) for _ in range(40)]
    got = co.contradiction_candidates(docs_df(spark, texts), max_pairs).collect()
    want = [
        (i, j, len(significant(texts[i]) & significant(texts[j])))
        for i, j in itertools.combinations(range(len(texts)), 2)
    ]
    want = [p for p in want if p[2] >= 3][:max_pairs]
    assert sorted(map(tuple, got)) == want


def test_contradictions_read_replies(spark):
    rows = [
        (1, 2, 'Yes {"contradicts": true, "confidence": 0.95, "topic": "t"} end'),
        (1, 3, '{"contradicts": true, "confidence": 0.8}'),
        (1, 4, '{"contradicts": true, "confidence": 0.7}'),
        (1, 5, '{"contradicts": false, "confidence": 1.0}'),
        (1, 6, "no json"), (1, 7, None), (1, 8, '{"contradicts": true}'),
    ]
    df = spark.createDataFrame(rows, "doc_a long, doc_b long, response string")
    got = {r["doc_b"]: (r["severity"], r["topic"]) for r in co.contradictions(df).collect()}
    assert got == {2: ("high", "t"), 3: ("medium", "shared topic")}


def test_staleness_severity(spark):
    texts = [f"updated {d}" for d in ("2023-12-01", "2022-12-31", "2022-06-01", "2021-06-01", "2020-01-15")]
    got = {r["doc_id"]: (r["age_days"], r["severity"]) for r in st.stale_documents(docs_df(spark, texts), AS_OF).collect()}
    assert got == {1: (366, "medium"), 2: (579, "medium"), 3: (944, "high"), 4: (1447, "critical")}


def test_topics_and_gaps(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.4, 0.0], 0), (4, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, v array<double>, cluster int")
    got = {r["cluster"]: (r["size"], r["representative"]) for r in cv.topics(df).collect()}
    assert got == {0: (3, 3), 1: (1, 4)}
    assert [r["cluster"] for r in cv.coverage_gaps(cv.topics(df)).collect()] == [1]
    assert [cv.cluster_count(n) for n in (2, 9, 24, 1000)] == [2, 3, 4, 31]
    assert cv.cluster_count(1000, max_clusters=20) == 20


def test_kmeans_coverage_invariants(spark, sf_dir):
    from plumbline.plans import views

    vectors = views.vectors(spark, sf_dir).select("doc_id", "v")
    clustered = cv.cluster_documents(vectors)
    rows = cv.topics(clustered).collect()
    assert sum(r["size"] for r in rows) == vectors.count()
    assert len(rows) <= cv.cluster_count(500)
    home = {r["doc_id"]: r["cluster"] for r in clustered.collect()}
    assert all(home[r["representative"]] == r["cluster"] for r in rows)


def test_health_formulas(spark):
    rows = [("staleness", 10, 3, 0), ("duplicates", 10, 1, 0), ("duplicates", 1, 0, 0), ("contradictions", 10, 100, 0),
            ("coverage", 10, 1, 4), ("coverage", 10, 0, 0), ("staleness", 0, 0, 0)]
    df = spark.createDataFrame(rows, "c string, d long, i long, t long")
    got = [r["h"] for r in df.select(au.check_health(F.col("c"), F.col("d"), F.col("i"), F.col("t")).alias("h")).collect()]
    assert got == pytest.approx([0.7, 1 - 0.4 / 2.25, 1.0, 0.5, 1 - 0.3 / 4, 1.0, 1.0])


def test_run_audit_merges_checks(spark):
    texts = ["date 2020-01-01 alpha beta gamma", "date 2020-01-01 alpha beta gamma", "no date at all"]
    docs = docs_df(spark, texts)
    checks, summary, issues = au.run_audit(docs, AS_OF)
    by_check = {r["check"]: (r["n_issues"], round(r["health"], 3)) for r in checks.collect()}
    assert by_check == {"staleness": (2, round(1 / 3, 3)), "duplicates": (1, 0.6)}
    row = summary.first()
    assert (row["total_issues"], row["n_critical"], row["healthy"]) == (3, 2, False)
    assert row["health_score"] == pytest.approx(round((1 / 3 + 0.6) / 2, 3))
    assert [r["severity"] for r in au.sorted_issues(issues).collect()] == ["critical", "critical", "low"]
    with pytest.raises(ValueError):
        au.run_audit(docs, AS_OF, ["nope"])
    with pytest.raises(ValueError):
        au.run_audit(docs, AS_OF, ["coverage"])


def test_pairs_are_named_once(spark):
    """A pair of near copies leaves the join by words once, not once for each rare word it shares."""
    rng = random.Random(9)
    base = rng.sample([f"w{i}" for i in range(3000)], 150)
    texts = [" ".join([*base[:n], *base[n + 1 :], f"own{n}"]) for n in range(0, 120, 3)]
    groups = du._word_groups(docs_df(spark, texts)).withColumn("words", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    found = du._candidates(du._prefixes(groups, 0.8).cache(), 0.8)
    rows = found.count()
    assert rows == len(texts) * (len(texts) - 1) // 2
    assert joined_rows(found) < 1.5 * rows


def test_repeated_ids_and_many_buckets(spark, monkeypatch):
    """Texts are found whatever bucket they are in; an id of two texts stands for both."""
    monkeypatch.setattr(du, "SETS", 3)
    texts = random_texts(70, 11)
    docs = [(i % 60, t) for i, t in enumerate(texts)]
    got = du.duplicate_texts(spark.createDataFrame(docs, "doc_id long, content string"), 0.6).where("doc_b is not null")
    groups = du._word_groups(spark.createDataFrame(docs, "doc_id long, content string"))
    hashed = groups.withColumn("words", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))
    pairs = du._candidates(du._prefixes(hashed, 0.6), 0.6).collect()
    sets = [(r.id, r.copies, set(r.text.split())) for r in groups.collect()]
    want = []
    for (x, nx, a), (y, ny, b) in itertools.product(sets, sets):
        similarity = len(a & b) / len(a | b)
        if similarity >= 0.6:
            want += [(min(x, y), max(x, y), similarity, nx * ny)] * sum((p.a_id, p.b_id) == (x, y) for p in pairs)
    assert sorted((r.doc_a, r.doc_b, r.similarity, r.n_pairs) for r in got.collect()) == sorted(want)


def joined_rows(found):
    """Rows that the join by words gives to the count of pairs."""
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()

    def walk(node):
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    final = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
    counts = []
    todo = list(walk(final))
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo += list(walk(node.plan()))
        elif "Join" in node.nodeName():
            metric = node.metrics().get("numOutputRows")
            counts.append(metric.get().value())
    return counts[0]
