"""Null scores, exact means, items of long talks, and pairs that are rare."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores
from plumbline.operators import contradictions as co
from plumbline.operators import duplicates as du
from plumbline.operators import generation_metrics as gm
from plumbline.operators.nli import support_from_scores
from plumbline.operators.response_logs import logged_documents, rejected_payloads
from plumbline.operators.summary import metric_means, wide_means
from plumbline.plans import views


def test_null_scores_stay_null(spark):
    df = spark.createDataFrame([(None, None, [1.0, None, 3.0])], "x double, v array<double>, a array<double>")
    got = df.select(
        scores.by_distance(F.col("x")).alias("distance"),
        scores.minmax_array(F.col("a")).alias("scaled"),
        gm.given_bertscore(F.col("x")).alias("bert"),
        gm.vector_similarity(F.col("v"), F.array(F.lit(1.0))).alias("similarity"),
    ).first()
    assert (got.distance, got.bert, got.similarity, got.scaled) == (None, None, None, [0.0, None, 1.0])


def test_logged_documents_without_score_or_list(spark):
    rows = [(1, '{"hits": [{"content": "a", "s": 0.5}, {"content": "b"}]}'), (2, '{"hits": 3}'), (3, "oops"), (4, None), (5, '[{"content": "c", "s": 7}]')]
    logs = spark.createDataFrame(rows, "id long, payload string")
    hits = logged_documents(logs, "payload", results_path="hits", score_path="s").collect()
    assert sorted((r.id, r.content, r.score) for r in hits if r.score is not None) == [(1, "a", 0.5), (5, "c", 1.0)]
    assert [(r.id, r.content) for r in hits if r.score is None] == [(1, "b")]
    rejected = {r.id: r.error for r in rejected_payloads(logs, "payload", "hits").collect()}
    assert rejected == {2: "no list of results", 3: "no list of results", 4: "no payload"}


def test_means_do_not_depend_on_the_order(spark):
    pick = random.Random(1)
    rows = [("r", "m", pick.random() * 10 ** pick.randint(-6, 0)) for _ in range(5000)]
    seen = set()
    for n in (1, 16):
        pick.shuffle(rows)
        df = spark.createDataFrame(rows, "run_id string, metric string, score double").repartition(n)
        seen.add(metric_means(df).first()["mean_score"])
        seen.add(wide_means(df, ["score"]).first()["mean_score"])
    assert len(seen) == 1
    assert seen.pop() == pytest.approx(sum(r[2] for r in rows) / len(rows), abs=1e-6)
    half = spark.createDataFrame([(0.0000005,), (0.0000005,), (None,)], "score double")
    assert half.agg(scores.exact_mean(F.col("score")).alias("m")).first()["m"] == 1e-6
    assert half.limit(0).agg(scores.exact_mean(F.col("score")).alias("m")).first()["m"] is None


def test_support_for_items_without_claims(spark):
    claims = spark.createDataFrame([(1, 0), (1, 1)], "item_id long, claim_idx int")
    found = spark.createDataFrame([(1, 0, 0, 0.9)], "item_id long, claim_idx int, ctx_idx int, entailed_score double")
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    got = {r.item_id: (r.n_claims, r.n_supported, r.faithfulness_nli) for r in support_from_scores(claims, found, items=items).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}


def test_items_of_long_talks(spark, tmp_path):
    """The question may be any number of turns back, and no turn since the last answer is cut."""
    talk = [(1, 0, "user", "q0"), (1, 1, "assistant", "a1")]
    talk += [(1, n, "assistant", f"a{n}") for n in range(2, 9)]
    talk += [(2, n, "user", f"u{n}") for n in range(200)] + [(2, 200, "assistant", "end"), (3, 0, "assistant", "first")]
    folder = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(folder)
    got = {r.item_id: r for r in views.items(spark, str(tmp_path)).collect()}
    assert got["1:8"].question == "q0" and got["1:8"].ground_truth == "a7" and got["1:8"].contexts == ["a7"]
    assert got["2:200"].contexts == [f"u{n}" for n in range(200)] and got["2:200"].question == "u199"
    assert got["3:0"].question is None and got["3:0"].contexts == [] and len(got) == 10


def test_rare_contradiction_pairs(spark):
    """So few pairs that the last batch of ids is reached."""
    texts = {n: f"uniqueword{n} otherword{n}" for n in range(60)}
    texts[3] += " alpha1 bravo1 charlie"
    texts[57] += " alpha1 bravo1 charlie"
    texts[58] += " bravo1 charlie alpha1 delta1"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    words = {n: {w for w in t.split() if len(w) >= 5} for n, t in texts.items()}
    expected = [(a, b, len(words[a] & words[b])) for a, b in combinations(sorted(texts), 2) if len(words[a] & words[b]) >= 3]
    assert [tuple(r) for r in co.contradiction_candidates(docs, 10).collect()] == expected
    assert [tuple(r) for r in co.contradiction_candidates(docs, 1).collect()] == expected[:1]
    assert co.contradiction_candidates(docs.limit(0), 5).count() == 0
    whole = co.contradiction_prompts(co.contradiction_candidates(docs, 1), docs.withColumn("content", F.repeat("content", 300))).first()["prompt"]
    assert len(whole) > 2 * 300 * 30


def test_members_of_duplicate_groups(spark):
    docs = spark.createDataFrame([(5, "b a"), (2, "a b"), (9, "A  b"), (1, "c"), (7, ""), (8, None)], "doc_id long, content string")
    assert {r.doc_id: r.group_id for r in du.members(docs).collect()} == {5: 2, 2: 2, 9: 2, 1: 1}


def test_items_do_not_depend_on_ranges(spark, monkeypatch):
    """A conversation of many turns gives the same uses whole and in ranges of a few turns."""
    import random

    pick = random.Random(4)
    rows = [(c, t, pick.choice(["user", "assistant", "system"])) for c in (1, 2) for t in range(300) if pick.random() < 0.7]
    rows += [(3, t, "user") for t in range(40)] + [(4, t, "assistant") for t in range(0, 400, 9)] + [(5, -7, "user"), (5, 900, "assistant"), (5, None, "user")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    found = []
    for size in (1, 3, 50, 8192):
        monkeypatch.setattr(views, "TURNS", size)
        found.append(sorted(tuple(r) for r in views._uses(turns).where("from_turn is not null and turn is not null").collect()))
    assert found[0] == found[1] == found[2] == found[3] and (5, -7, 900, "question") in found[0]
