from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.functions.vectors import hash_embedding
from plumbline.operators import ranking, vector_ranking
from plumbline.operators.numbering import number_rows
from plumbline.operators.response_logs import logged_documents
from plumbline.plans import views


def brute_bm25(queries, docs, k):
    """Okapi scores of every pair, in plain Python."""
    toks = {d: t.split() for d, t in docs}
    n = len(toks)
    avg = sum(map(len, toks.values())) / n
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in raw.items()}
    out = {}
    for q, text in queries:
        got = {}
        for d, words in toks.items():
            s = 0.0
            for w in text.split():
                tf = words.count(w)
                if w in idf:
                    s += idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
            got[d] = round(s, 9) + 0.0
        lo, hi = min(got.values()), max(got.values())
        best = sorted(got.items(), key=lambda p: (-p[1], p[0]))[:k]
        out[q] = [(d, 1.0 if hi == lo else (s - lo) / (hi - lo)) for d, s in best]
    return out


DOCS = [(1, "the cat sat on the mat"), (2, "the dog ate the cat"), (3, "birds fly high"),
        (4, "birds of prey fly low and high"), (5, ""), (6, "the cat sat on the mat"), (7, "lone")]
TINY = [(1, "a b"), (2, "a b c"), (3, "a b")]  # most words in most documents: negative idf
QUERIES = [(1, "cat mat"), (2, "birds birds high"), (3, "nothing here"), (4, "the"), (5, "a b c"), (6, "a")]


@pytest.mark.parametrize("docs", [DOCS, TINY])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_bm25_equals_brute_force(spark, docs, k):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, content string")
    got = {}
    for r in ranking.bm25_topk(q, d, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute_bm25(QUERIES, docs, k)
    for query, rows in want.items():
        assert [x for x, _ in got[query]] == [x for x, _ in rows], query
        assert [s for _, s in got[query]] == pytest.approx([s for _, s in rows])


def test_bm25_checks_k(spark):
    with pytest.raises(ValueError):
        ranking.bm25_topk(None, None, 0)


def test_bm25_hits_are_matches_only(spark):
    q = spark.createDataFrame(QUERIES[:3], "query_id long, text string")
    d = spark.createDataFrame(DOCS, "doc_id long, content string")
    rows = ranking.bm25_hits(q, d, 2).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in rows} == {1, 2}
    assert [r["score"] for r in rows if r["query_id"] == 1] == [1.0, 1.0]


@pytest.mark.parametrize("kernel", list(vector_ranking.KERNELS))
@pytest.mark.parametrize("block_rows", [7, 1000])
def test_topk_vectors_equals_numpy(spark, kernel, block_rows):
    rng = np.random.default_rng(1)
    docs = rng.normal(size=(40, 5))
    queries = np.vstack([rng.normal(size=(9, 5)), np.zeros((1, 5))])
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, v array<double>")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, v array<double>")
    got = vector_ranking.topk_vectors(q, d, 3, kernel, block_rows).orderBy("query_id", "rank").collect()
    near, value = vector_ranking.KERNELS[kernel](queries, docs)
    for i in range(len(queries)):
        order = sorted(range(len(docs)), key=lambda j: (-round(near[i, j], 12), j))[:3]
        mine = [r for r in got if r["query_id"] == i]
        assert [r["doc_id"] for r in mine] == order
        assert [r["score"] for r in mine] == pytest.approx([value[i, j] for j in order])


@pytest.mark.parametrize("odd", [0.0, np.nan, np.inf])
def test_nearest_equals_sorting(monkeypatch, odd):
    """The bound of the first columns loses nothing, with ties, rounding and odd values."""
    monkeypatch.setattr(vector_ranking, "HEAD_ROWS", 20)
    order = np.round(np.random.default_rng(2).normal(size=(30, 300)), 1)
    order[:, 100:] += 1e-13
    order[3, 7] = order[4, 250] = odd
    near = np.round(order, 12)
    rows, cols, got = vector_ranking._nearest(order, 5)
    want = np.argsort(-near, axis=1, kind="stable")[:, :5].ravel()
    assert rows.tolist() == np.repeat(np.arange(30), 5).tolist() and cols.tolist() == want.tolist()
    assert np.array_equal(got, near[rows, cols], equal_nan=True)


def test_vectors_are_sent_to_few_blocks(spark):
    """Each side is sent once for every block of the other, so blocks must be large."""
    assert vector_ranking.block_count(spark.range(60_000), vector_ranking.BLOCK_ROWS) <= 4


def test_score_normalising(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 10.0), (2, 3.0), (2, 3.0)], "q int, s double")
    rows = df.select("q", scores.minmax(F.col("s"), scores.list_of("q")).alias("x")).collect()
    assert sorted((r["q"], r["x"]) for r in rows) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]
    ranks = df.select(scores.by_rank(F.lit(2), F.lit(3)).alias("x")).first()["x"]
    assert ranks == pytest.approx(2 / 3)
    dist = df.select(*[scores.by_distance(F.lit(v), s).alias(f"c{i}") for i, (v, s) in enumerate(
        [(0.0, "cosine"), (1.0, "cosine"), (3.0, "l2"), (-1.0, "ip"), (0.4, "other")])]).first()
    assert tuple(dist) == (0.0, 0.5, 1.0, 0.0, 0.4)


def test_hash_embedding_is_unit_length_and_equals_hashlib(spark):
    import hashlib

    raw = [int.from_bytes(hashlib.sha256(f"{i}:héllo".encode()).digest()[:2], "big") / 65535 * 2 - 1 for i in range(32)]
    size = math.sqrt(sum(x * x for x in raw))
    df = spark.createDataFrame([("héllo",)], "t string")
    got = df.select(hash_embedding(F.col("t")).alias("v")).first()["v"]
    assert got == pytest.approx([x / size for x in raw])


def test_logged_documents(spark):
    payload = '{"hits": [{"t": "a", "s": 4}, {"s": 2}, {"t": "c", "s": 1}, {"t": "d", "s": 9}]}'
    df = spark.createDataFrame([(1, payload), (2, '[{"t": "x"}]')], "id int, p string")
    kw = {"k": 3, "results_path": "hits", "content_path": "t"}
    rows = logged_documents(df, "p", score_path="s", score_mode="minmax", **kw).where("id = 1").collect()
    assert [(r["rank"], r["content"], r["score"]) for r in rows] == [(1, "a", 1.0), (3, "c", 0.0)]
    ranked = logged_documents(df, "p", **kw).collect()
    assert [(r["id"], r["rank"]) for r in ranked] == [(1, 1), (1, 3), (2, 1)]
    assert [r["score"] for r in ranked] == pytest.approx([1.0, 1 / 3, 1.0])


def test_number_rows_with_a_hot_leading_key(spark):
    rows = [(1, i) for i in range(200)] + [(k, 0) for k in range(2, 60)]
    df = spark.createDataFrame(rows, "a long, b int").repartition(7)
    got = sorted((r["row_no"], r["a"], r["b"]) for r in number_rows(df, "a", "b").collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted(rows))]


def test_relevant_documents_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Queries are sent to the texts, also by parts; repeated rows stay."""
    docs = [(1, "one two three four five"), (1, "one two three four five"), (2, "ones two three fours"), (3, "four"), (None, "one two"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries = [(1, "one two three"), (2, "four"), (2, "two three four"), (3, "no such words"), (None, "four"), (4, None)]
    spark.createDataFrame(queries, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(1, 1), (1, 1), (2, 1), (2, 1), (2, 1), (2, 1), (2, 2), (2, 2), (2, 3)]
    found = views.relevant(spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(views, "RELEVANT", 2)
    assert sorted(map(tuple, views.relevant(spark, str(tmp_path)).collect())) == want
