from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cost_metrics as cm
from plumbline.operators import evaluate as ev
from plumbline.operators import nli, providers
from plumbline.operators import retrieval_metrics as rm

ITEM = (
    "item_id long, question string, answer string, ground_truth string, contexts array<string>, "
    "ground_truth_contexts array<string>, latency_ms double, prompt_tokens long, "
    "completion_tokens long"
)


def item(question="", answer="", ground_truth="", contexts=(), relevant=(), latency=None,
         prompt=0, completion=0):
    return (1, question, answer, ground_truth, list(contexts), list(relevant), latency, prompt,
            completion)


def score(spark, metric, k=None, **fields):
    df = spark.createDataFrame([item(**fields)], ITEM)
    return ev.evaluate(df, [metric], k=k).first()[metric]


@pytest.mark.parametrize(
    "metric, retrieved, relevant, k, want",
    [
        ("ndcg", ["ctx1", "ctx2"], ["ctx1", "ctx2"], None, 1.0),
        ("ndcg", ["ctx_a", "ctx1", "ctx2"], ["ctx1", "ctx2"], 3, 0.815465),
        ("ndcg", ["r1", "x", "x", "x", "x"], [f"r{i}" for i in range(1, 11)], 5,
         1 / (2 + 1 / math.log2(3) + 1 / 2 + 1 / math.log2(5))),
        ("ndcg", ["a", "a"], ["a"], 2, 0.0),
        ("recall_at_k", ["ctx1", "ctx_x"], ["ctx1", "ctx1"], 2, 1.0),
        ("recall_at_k", ["a"], ["a"], 0, 0.0),
        ("mrr", ["irrelevant", " hello  world "], ["hello world"], None, 0.5),
        ("mrr", ["a"], ["b"], None, 0.0),
        ("context_precision", ["  hello   world  "], ["hello world"], None, 1.0),
        ("context_precision", ["a", "a", "b"], ["a"], None, 2 / 3),
        ("context_recall", ["a"], ["a", "a", "b"], None, 2 / 3),
        ("precision_at_k", ["a"], ["a"], 4, 0.25),
        ("precision_at_k", ["a"], ["a"], 0, 0.0),
        ("hit_rate", ["x", "A"], ["a"], None, 1.0),
    ],
)
def test_retrieval(spark, metric, retrieved, relevant, k, want):
    got = score(spark, metric, k=k, contexts=retrieved, relevant=relevant)
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("metric", ev.METRIC_GROUPS["retrieval"])
def test_retrieval_on_empty_lists(spark, metric):
    assert score(spark, metric, contexts=[], relevant=["a"]) == 0.0
    assert score(spark, metric, contexts=["a"], relevant=[]) == 0.0


def test_ndcg_out_of_range_is_an_error(spark):
    df = spark.createDataFrame([item(contexts=["a", "a"], relevant=["a"])], ITEM)
    row = ev.evaluate(df, ["ndcg"]).first()
    assert row["ndcg"] == 0.0 and row["metric_errors"] == {"ndcg": rm.OUT_OF_RANGE}
    listed = df.select(
        rm.ndcg(F.col("contexts"), F.col("ground_truth_contexts"), dedupe=True).alias("d"),
        rm.ndcg(F.array(F.lit("x"), F.lit("a")), F.array(F.lit("a")), discount="standard").alias("s"),
    ).first()
    assert listed["d"] == 1.0
    assert listed["s"] == pytest.approx(0.6309, abs=1e-4)


def test_negative_k_is_rejected(spark):
    with pytest.raises(ValueError):
        score(spark, "precision_at_k", k=-1)


@pytest.mark.parametrize(
    "metric, fields, want",
    [
        ("exact_match", {"answer": " Paris\n", "ground_truth": "paris"}, 1.0),
        ("exact_match", {"answer": "x", "ground_truth": None}, 0.0),
        ("f1_score", {"answer": "cat cat cat", "ground_truth": "cat cat"}, 0.8),
        ("f1_score", {"answer": "", "ground_truth": ""}, 1.0),
        ("f1_score", {"answer": None, "ground_truth": None}, 1.0),
        ("f1_score", {"answer": "x", "ground_truth": ""}, 0.0),
        ("f1_score", {"answer": " ", "ground_truth": "  "}, 1.0),
        ("bleu", {"answer": "the the cat", "ground_truth": "the cat sat down"}, 2 / 3 * 0.75),
        ("rouge", {"answer": "the cat", "ground_truth": "The cat sat"}, 2 / 3),
        ("semantic_similarity", {"answer": "a b", "ground_truth": "b c"}, 1 / 3),
        ("bertscore", {"answer": "", "ground_truth": "b"}, 0.0),
        ("faithfulness", {"answer": "a b", "contexts": ["A x", "y"]}, 0.5),
        ("faithfulness", {"answer": "a", "contexts": []}, 0.0),
        ("answer_relevancy", {"question": "What is the capital?", "answer": "The capital"}, 1.0),
        ("answer_relevancy", {"question": "what is", "answer": "x"}, 1.0),
        ("answer_relevancy", {"question": "", "answer": "x"}, 0.0),
        ("hallucination", {"answer": "a b", "contexts": ["a b c"]}, 0.0),
        ("hallucination", {"answer": "a z", "contexts": ["a b c"]}, 0.5),
        ("hallucination", {"answer": "a", "contexts": []}, 1.0),
        ("hallucination", {"answer": "", "contexts": []}, 0.0),
        ("latency", {"latency": 0.0}, 1.0),
        ("latency", {"latency": 1000.0}, 0.5),
        ("latency", {"latency": 3000.0}, 0.0),
        ("latency", {"latency": -5.0}, 0.0),
        ("token_count", {"prompt": 1000, "completion": 1000}, 0.9),
        ("token_count", {"prompt": 30000, "completion": 0}, 0.0),
    ],
)
def test_generation_and_cost(spark, metric, fields, want):
    assert score(spark, metric, **fields) == pytest.approx(want)


def test_missing_latency_is_an_error_and_scores_zero(spark):
    row = ev.evaluate(spark.createDataFrame([item()], ITEM), ["latency"]).first()
    assert row["latency"] == 0.0 and row["metric_errors"] == {"latency": cm.NO_LATENCY}


def test_failed_items_score_zero_without_errors(spark):
    df = spark.createDataFrame([item(answer="a", ground_truth="a")], ITEM)
    row = ev.evaluate(df, ["exact_match", "latency"], failed=F.lit(True)).first()
    assert (row["exact_match"], row["latency"], row["metric_errors"]) == (0.0, 0.0, {})


@pytest.mark.parametrize(
    "provider, model, cost",
    [("openai", "gpt-4o", 12.5), ("anthropic", "claude-3-opus", 90.0), ("openai", "other", 0.0),
     (None, None, 0.0)],
)
def test_cost(spark, provider, model, cost):
    df = spark.createDataFrame(
        [(provider, model, 1_000_000, 1_000_000)],
        "provider string, model string, prompt_tokens long, completion_tokens long",
    )
    assert cm.with_cost(df).first()["cost_usd"] == pytest.approx(cost)


def test_registry_and_routing(spark):
    assert ev.resolve_metrics(["precision", "tokens", "precision"]) == ["context_precision", "token_count"]
    with pytest.raises(KeyError, match="available"):
        ev.resolve_metrics(["nope"])
    routed = ev.route_metrics(["recall", "nope", "latency", "bleu"])
    assert routed == {"retrieval": ["context_recall"], "generation": ["bleu"],
                      "performance": ["latency"], "cost": []}
    ev.register_metric("answer_chars", lambda: F.length("answer").cast("double"))
    try:
        assert score(spark, "answer_chars", answer="four") == 4.0
    finally:
        ev.unregister_metric("answer_chars")
    assert len(ev.metric_names()) == 18


def test_invariants_and_partitioning(spark, sf_dir):
    from plumbline.plans import views

    items = views.items(spark, sf_dir)
    names = ["faithfulness", "hallucination", "f1_score", "ndcg", "answer_relevancy"]
    narrow = ev.evaluate(items.repartition(1), names).select("item_id", *names)
    wide = ev.evaluate(items.repartition(16), names).select("item_id", *names)
    a = sorted(map(tuple, narrow.collect()))
    assert a == sorted(map(tuple, wide.collect()))
    for _, faithful, made_up, *rest in a:
        assert faithful + made_up == pytest.approx(1.0)
        assert all(0.0 <= s <= 1.0 for s in (faithful, made_up, *rest))


def test_long_form_equals_array_form(spark):
    lists = {1: ["a", "b", "c"], 2: ["x"], 3: [], 4: ["d", "e", "a", "b"]}
    wanted = {1: ["b", "c"], 2: ["y"], 3: ["a"], 4: []}
    ranked = spark.createDataFrame(
        [(q, i + 1, d) for q, ds in lists.items() for i, d in enumerate(ds)],
        "query_id long, rank int, doc_id string",
    )
    relevant = spark.createDataFrame(
        [(q, d) for q, ds in wanted.items() for d in ds], "query_id long, doc_id string"
    )
    queries = spark.createDataFrame([(q,) for q in lists], "query_id long")
    names = ev.METRIC_GROUPS["retrieval"]
    long = {r["query_id"]: r for r in rm.long_form_metrics(ranked, relevant, queries, 2).collect()}
    for q in lists:
        for name in names:
            k = 2 if name.endswith("_at_k") or name == "ndcg" else None
            want = score(spark, name, k=k, contexts=lists[q], relevant=wanted[q])
            assert long[q][name] == pytest.approx(want), (q, name)


def test_nli_labels(spark):
    rows = [("p", "h", 0.5, 0.5, 0.1), ("p", "h", 0.1, 0.4, 0.4), ("p", "h", 0.1, 0.2, 0.7), (" ", "h", 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "premise string, hypothesis string, entailment double, contradiction double, neutral double")
    got = [(r["label"], r["score"], r["entailed_score"]) for r in nli.label_scores(df).collect()]
    assert got == [("entailment", 0.5, 0.5), ("contradiction", 0.4, 0.1), ("neutral", 0.7, 0.1), ("neutral", 1.0, 0.0)]


def test_claim_support(spark):
    rows = [(1, "Cats sleep. Dogs fly high!", ["cats sleep all day", "nothing"]), (2, "", ["x"]), (3, "Hi there", [])]
    df = spark.createDataFrame(rows, "item_id long, answer string, contexts array<string>")
    got = {r["item_id"]: r for r in nli.claim_support(df).collect()}
    assert [got[i]["faithfulness_nli"] for i in (1, 2, 3)] == [0.5, 1.0, 0.0]
    assert [r["ctx_idx"] for r in nli.evidence_rows(nli.claim_support(df)).where("item_id = 1").orderBy("claim_idx").collect()] == [0, 0]
    claim_rows = spark.createDataFrame([(1, 0), (1, 1)], "item_id long, claim_idx int")
    scores = spark.createDataFrame([(1, 0, 0, 0.2), (1, 0, 1, 0.5)], "item_id long, claim_idx int, ctx_idx int, entailed_score double")
    assert nli.support_from_scores(claim_rows, scores).first()["faithfulness_nli"] == 0.5


def test_echo_run_is_perfect(spark):
    df = spark.createDataFrame(
        [(1, "Q?", "the truth", ["c one", "c two"])],
        "item_id long, question string, ground_truth string, ground_truth_contexts array<string>",
    )
    hits = providers.echo_retrieve(F.col("question"), F.col("ground_truth_contexts"))
    df = df.withColumn("contexts", F.transform(hits, lambda h: h["content"])).withColumn("latency_ms", F.lit(1.0))
    out = ev.evaluate(providers.echo_generate(df), ["context_precision", "context_recall", "exact_match"]).first()
    assert (out["context_precision"], out["context_recall"], out["exact_match"]) == (1.0, 1.0, 1.0)
    assert out["answer"] == "the truth" and out["total_tokens"] == out["prompt_tokens"] + 2


def test_user_generator_and_embedder(spark):
    df = spark.createDataFrame([("one",), ("two",)], "prompt string")
    made = providers.generate_answers(df, lambda: lambda texts: [t.upper() for t in texts])
    assert sorted(r["answer"] for r in made.collect()) == ["ONE", "TWO"]

    def broken():
        def run(texts):
            raise RuntimeError("model is down")

        return run

    failed = providers.generate_answers(df, broken).collect()
    assert {r["generation_error"] for r in failed} == {"model is down"}

    def picky():
        def run(texts):
            if "two" in texts:
                raise ValueError("not two")
            return [[len(t), 1] for t in texts]

        return run

    one = df.coalesce(1)
    made = {r["prompt"]: r for r in providers.generate_answers(one, lambda: lambda ts: [str(v) for v in picky()(ts)]).collect()}
    assert made["one"]["answer"] == "[3, 1]" and made["two"]["generation_error"] == "not two" and made["two"]["answer"] is None
    short = providers.generate_answers(one, lambda: lambda texts: texts[:1]).collect()
    assert {r["answer"] for r in short} == {"one", "two"}
    assert {r["prompt"]: r["embedding"] for r in providers.embed_column(one, picky, "prompt").collect()} == {"one": [3.0, 1.0], "two": None}
    vecs = providers.embed_column(df, lambda: lambda texts: [[len(t), 1] for t in texts], "prompt")
    assert vecs.first()["embedding"] == [3.0, 1.0]
