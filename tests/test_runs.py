from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import chunk_checks as cc
from plumbline.operators import comparison as cmp
from plumbline.operators import diagnosis as dg
from plumbline.operators import gates as gt
from plumbline.operators import synthesis as sy
from plumbline.sources import corpus as cs
from plumbline.sources import datasets as ds
from plumbline.sources import reports as rp
from plumbline.streaming import scoring

RESULT = (
    "item_id long, question string, answer string, contexts array<string>, context_precision double, "
    "context_recall double, faithfulness double, answer_relevancy double"
)
LONG = "a perfectly long answer"


@pytest.mark.parametrize(
    "row, modes, target",
    [
        ((LONG, ["c"], 1.0, 1.0, 1.0, 1.0), [], "unknown"),
        ((LONG, [], 0.0, 0.0, 1.0, 1.0), ["empty_retrieval"], "retrieval"),
        ((LONG, ["c"], 0.1, 1.0, 1.0, 1.0), ["low_context_relevance"], "retrieval"),
        ((LONG, ["c"], None, 0.2, 1.0, 1.0), ["missing_context"], "retrieval"),
        (("short", ["c"], 1.0, 1.0, 0.0, 0.0), ["off_topic_answer"], "generation"),
        ((LONG, ["c"], 1.0, 1.0, 0.3, 1.0), ["hallucination"], "generation"),
        ((LONG, ["c"], 1.0, 1.0, 1.0, 0.3), ["off_topic_answer"], "generation"),
        ((LONG, ["c" * 50, "c" * 100, "c" * 2000], 1.0, 1.0, 1.0, 1.0), ["chunking_split_info_lost"], "chunking"),
        ((LONG, ["c"], 0.1, 0.1, 0.1, 0.1),
         ["low_context_relevance", "missing_context", "hallucination", "off_topic_answer"], "generation"),
    ],
)
def test_rules_and_blame(spark, row, modes, target):
    df = spark.createDataFrame([(1, "q", *row)], RESULT)
    metrics = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
    got = dg.diagnose(df, metrics).first()
    assert [f["mode"] for f in got["failures"]] == modes
    assert got["blame"]["target"] == target


def test_report(spark):
    rows = [(1, "q", LONG, ["c"], 1.0, 1.0, 1.0, 1.0), (2, "q", LONG, ["c"], 1.0, 1.0, 1.0, 1.0),
            (3, "q", LONG, [], 0.0, 0.0, 1.0, 1.0), (4, "q", LONG, ["c"], 1.0, 1.0, 0.1, 1.0)]
    found = dg.diagnose(spark.createDataFrame(rows, RESULT), ["context_precision", "context_recall", "faithfulness", "answer_relevancy"])
    health = dg.health(found).first()
    assert (health["healthy_items"], health["overall_health"], health["health_label"]) == (2, 0.5, "fair")
    counts = dg.blame_counts(found)
    assert {r["target"]: r["share"] for r in dg.blame_share(counts).collect()} == {"retrieval": 50.0, "generation": 50.0}
    advice = dg.recommendations(counts).orderBy("position").collect()
    assert len(advice) == 5 and advice[0]["recommendation"].startswith("[RETRIEVAL] (1 failures)")
    assert dg.recommendations(counts, 7).orderBy("position").collect()[5]["recommendation"].startswith("[GENERATION]")


def test_chunk_checks(spark):
    rows = [(1, "Where is the treasure hidden today?", ["a b c d e", "a b c d e", "x" * 500], 500, 1),
            (2, "Which treasure?", ["the TREASURE is here " * 5], 100, 50), (3, "q", [], 100, 1)]
    df = spark.createDataFrame(rows, "item_id long, question string, contexts array<string>, chunk_size int, chunk_overlap int")
    issues = cc.chunk_issues(df, "item_id", chunk_size="chunk_size", chunk_overlap="chunk_overlap").collect()
    kinds = sorted((r["item_id"], r["issue_type"]) for r in issues)
    assert kinds == [
        (1, "chunk_size_deviation"), (1, "chunk_size_deviation"), (1, "content_gap"),
        (1, "empty_or_small_chunk"), (1, "empty_or_small_chunk"), (1, "excessive_overlap"),
        (1, "inconsistent_chunk_sizes"), (1, "overlapping_chunks"),
    ]


def test_gates(spark):
    metrics = spark.createDataFrame([("r", "m", 0.8000001), ("r", "n", 0.2)], "run_id string, metric string, value double")
    gates = gt.gate_table(spark, [
        ("eq", "fail", [("m:eq:0.8", True), ("m:gte:0.5", True)]),
        ("low", "warn", [("n:gt:0.5", True), ("n:neq:0.2", False)]),
        ("gone", "skip", [("x:lt:1", False)]),
    ])
    results = gt.gate_results(gt.threshold_results(gates, metrics))
    got = {r["gate"]: (r["passed"], r["failure_reasons"]) for r in results.collect()}
    assert got["eq"] == (True, "") and got["gone"] == (False, "")
    assert got["low"][0] is False and got["low"][1].startswith("n: 0.2000 NOT gt")
    row = gt.overall(results).first()
    assert (row["passed"], row["failed_gates"], row["failed_thresholds"]) == (True, 2, 3)
    text = spark.createDataFrame([("r", "m", "0.9"), ("r", "n", "high")], "run_id string, metric string, value string")
    checked = gt.threshold_results(gates, text).where("gate <> 'gone'").collect()
    assert sum(r["passed"] for r in checked) == 1
    for bad in ("m:gt", "m:foo:1", ":gt:1", "m:gt:x"):
        with pytest.raises(ValueError):
            gt.parse_threshold(bad)


def test_comparison(spark):
    rows = [("a", "x", 0.5), ("b", "x", 0.6), ("a", "y", 0.5), ("b", "y", 0.5005), ("a", "z", 0.9), ("b", "w", 0.1)]
    means = spark.createDataFrame(rows, "run_id string, metric string, mean_score double")
    got = {r["metric"]: r["verdict"] for r in cmp.compare_runs(means, "a", "b").collect()}
    assert got == {"x": "improved", "y": "unchanged", "z": "regressed", "w": "improved"}
    assert cmp.compare_runs(means, "a", "b", ["x"]).count() == 1
    overall = cmp.compare_overall(means, "a", "b").first()
    assert (overall["common_metrics"], overall["winner"]) == (2, "b")
    same = cmp.compare_runs(means, "a", "a").collect()
    assert all(r["delta"] == 0 and r["verdict"] == "unchanged" for r in same)
    assert cmp.compare_overall(means, "a", "a").first()["winner"] == "tie"
    assert cmp.compare_overall(means, "a", "none").first()["winner"] is None


def test_datasets_from_files(spark, tmp_path):
    items = [{"question": " Q1 ", "ground_truth": "A", "metadata": {"id": 1}}, {"question": "Q2", "context": " "}]
    (tmp_path / "list.json").write_text(json.dumps(items))
    (tmp_path / "object.json").write_text(json.dumps({"items": items}))
    for name in ("list.json", "object.json"):
        rows = ds.read_json(spark, str(tmp_path / name))
        good, bad = ds.validate_items(rows, strict=True)
        assert sorted(r["question"] for r in good.collect()) == ["Q1", "Q2"]
        assert {r["context"] for r in good.collect()} == {None}
        assert json.loads(rows.where("question = ' Q1 '").first()["metadata"]) == {"id": 1}
    (tmp_path / "lines.jsonl").write_text('{"question": "Q1"}\n\n{broken\n[1]\n{"question": " "}\n')
    good, bad = ds.read_jsonl(spark, str(tmp_path / "lines.jsonl"))
    assert good.count() == 2
    assert sorted((r["line"], r["error"]) for r in bad.collect()) == [(3, "malformed JSON"), (4, "not an object")]
    with pytest.raises(ds.DatasetError):
        ds.require_clean(bad)
    _, rejected = ds.validate_items(good)
    assert rejected.first()["errors"] == ["question is blank"]
    (tmp_path / "t.csv").write_text('question,ground_truth,metadata\n Q1 , A ,"{""k"": 1}"\n"Q,2\nx",,5\nQ3,b,\n')
    rows = {r["question"]: r for r in ds.read_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert json.loads(rows["Q1"]["metadata"]) == {"k": 1} and rows["Q1"]["ground_truth"] == "A"
    assert json.loads(rows["Q,2\nx"]["metadata"]) == {"raw": "5"} and rows["Q,2\nx"]["ground_truth"] is None
    assert rows["Q3"]["metadata"] is None and rows["Q3"]["contexts"] == []


def test_field_mapping(spark):
    rows = [("", "the q", [("first", 1)], "p"), ("q1", None, [], None)]
    df = spark.createDataFrame(rows, "query string, prompt string, answers array<struct<text:string,start:int>>, passage string")
    got = ds.map_fields(df).collect()
    assert [(r["question"], r["ground_truth"], r["context"]) for r in got] == [("the q", "first", "p"), ("q1", None, None)]
    assert json.loads(got[0]["metadata"])["passage"] == "p"


def test_sampling_ignores_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "item_id")
    a = [r["item_id"] for r in ds.sample_items(df.repartition(1), 20).collect()]
    assert a == [r["item_id"] for r in ds.sample_items(df.repartition(16), 20).collect()]
    assert a != sorted(a)
    assert ds.has_ground_truth(df.withColumn("ground_truth", F.lit("x"))).first()[0] is True


def test_corpus_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "skip.pdf").write_text("no")
    (tmp_path / "sub" / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"b": 2}\n')
    docs = {r["doc_id"]: r for r in cs.read_corpus(spark, str(tmp_path), root=str(tmp_path)).collect()}
    assert sorted(docs) == ["a.TXT", "sub/log.jsonl:L1", "sub/log.jsonl:L4"]
    assert docs["a.TXT"]["content"] == "café  ok" and docs["a.TXT"]["metadata"]["extension"] == ".TXT"
    assert docs["sub/log.jsonl:L4"]["metadata"]["line_number"] == "4"
    (tmp_path / "v1+x").mkdir()
    (tmp_path / "v1+x" / "b.txt").write_text("b")
    assert [r["doc_id"] for r in cs.read_corpus(spark, str(tmp_path / "v1+x"), root="v1+x").collect()] == ["b.txt"]
    (tmp_path / "v1+x" / "b.txt").unlink()
    assert cs.read_corpus(spark, str(tmp_path), max_documents=1).count() == 1
    with pytest.raises(cs.CorpusError):
        cs.read_corpus_strict(spark, str(tmp_path))
    assert cs.read_corpus_strict(spark, str(tmp_path / "sub")).count() == 1
    (tmp_path / "docs.json").write_text('[{"id": "1", "content": "x", "metadata": {"k": "v"}}, {"id": "2"}]')
    assert [r["content"] for r in cs.read_documents(spark, str(tmp_path / "docs.json")).collect()] == ["x", ""]


def test_run_store(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(1, "q", "a", 1.0, None, 10, 5, 20.0, 0.5), (2, "q", "", 0.0, "Timeout", None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "item_id long, question string, answer string, f1_score double, error_type string, prompt_tokens long, completion_tokens long, latency_ms double, cost_usd double")
    rp.save_run(df, store, ["f1_score"], "one", "2024-01-01T00:00:00Z", {"dataset_path": "data/x.json"})
    rp.save_run(df.where("item_id = 1"), store, ["f1_score"], "two", "2024-02-01T00:00:00Z")
    rp.save_run(df, store, ["f1_score"], "one", "2024-01-01T00:00:00Z", {"dataset_path": "data/x.json"})
    runs = rp.read_runs(spark, store)
    assert cmp.latest_run(runs).first()["run_id"] == "two"
    listed = cmp.run_history(runs, sort_by="score").collect()
    assert [(r["run_id"], r["score"], r["status"]) for r in listed] == [("two", 1.0, "ok"), ("one", 0.5, "failed")]
    assert cmp.run_history(runs, search="X.JSON").count() == 1
    assert rp.delete_runs(spark, store, ["one", "gone"]) == 1
    assert [r["run_id"] for r in rp.read_runs(spark, store).collect()] == ["two"]
    with pytest.raises(ValueError):
        rp.delete_runs(spark, store, ["../x"])
    rp.export_summary(df.withColumn("run_id", F.lit("r")), ["f1_score"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "error_breakdown")).first()["n"] == 1


def test_report_files(spark, tmp_path):
    result = {"question": "q", "answer": "a", "contexts": ["c"], "metrics": {"mrr": 0.5}, "metadata": {"latency_ms": 3}}
    good = {"report_id": "r1", "created_at": "2024-03-01T10:00:00+00:00", "config": {"dataset": {"path": "d.json"}},
            "summary": {"total_items": 1, "metrics_summary": {"mrr": 0.5, "bleu": 0.1}}, "results": [result], "errors": []}
    (tmp_path / "r1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "r0.json").write_text(json.dumps({"summary": {"total_items": 2}, "errors": [{"error_type": "E"}]}))
    (tmp_path / "bad.json").write_text("{not json")
    runs = rp.report_runs(rp.read_reports(spark, str(tmp_path)))
    got = [(r["run_id"], r["dataset_path"], r["errors"]) for r in cmp.run_history(runs).collect()]
    assert got == [("r1", "d.json", 0), ("r0", None, 1)]
    assert cmp.run_history(runs).first()["score"] == pytest.approx(0.3)
    assert rp.read_results_json(spark, str(tmp_path / "r1.json")).first()["metrics"] == {"mrr": 0.5}
    (tmp_path / "bare.json").write_text(json.dumps([result, result]))
    assert rp.read_results_json(spark, str(tmp_path / "bare.json")).count() == 2


def test_synthesis(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x" * 70), ("b", "y" * 20), ("c", "{z}")], "doc_id string, content string")
    chunked = sy.chunk_documents(docs, 30, 10)
    n = chunked.count()
    assert n == 4 + 1 + 1
    for count in (1, n, n + 2, 3 * n - 1):
        quotas = [r["n_questions"] for r in sy.chunk_quotas(chunked, count).orderBy("doc_id", "chunk_idx").collect()]
        share = max(1, count // n)
        rest = max(0, count - share * n)
        assert quotas == [share + (i < rest) for i in range(n)]
    prompts = sy.standard_prompts(sy.chunk_quotas(chunked, 1)).where("doc_id = 'c'").first()["prompt"]
    assert prompts.endswith("{{z}}")
    assert sy.adversarial_prompts(chunked).count() == 5 * n
    with pytest.raises(ValueError):
        sy.adversarial_prompts(chunked, types=["nope"])
    rows = [("a", 0, "x", "standard", '[{"question": "Q", "answer": "A"}]'), ("a", 1, "x", "ambiguous", '[{"question": "R", "answer": ""}]'),
            ("a", 2, "x", "multi_hop", '[{"question": "S", "answer": "B"}]'), ("a", 3, "x", "standard", "junk"), ("a", 4, "x", "standard", None)]
    responses = spark.createDataFrame(rows, "doc_id string, chunk_idx int, chunk string, test_type string, response string")
    cases, errors = sy.test_cases(responses, ["ambiguous"])
    assert {r["test_type"]: r["n"] for r in sy.type_counts(cases).collect()} == {"standard": 1, "ambiguous": 1}
    assert errors.count() == 2
    for kind in ("jsonl", "json", "huggingface"):
        rp.export_cases(cases, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 2
    assert spark.read.json(str(tmp_path / "json" / "type_counts")).count() == 2
    assert spark.read.parquet(str(tmp_path / "huggingface" / "data")).count() == 2


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from plumbline.plans import views

    source = str(tmp_path / "in")
    views.latencies(spark, sf_dir).repartition(4).write.parquet(source)
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 4).parquet(source)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    scoring.start_windows(stream, out, ck, "6 hours", watermark="1 hour").awaitTermination(120)
    got = {(r["window_start"], r["stage"]): (r["n"], round(r["mean_score"], 9)) for r in spark.read.parquet(out).collect()}
    want = {(r["window_start"], r["stage"]): (r["n"], round(r["mean_score"], 9)) for r in scoring.windowed_latency(batch, "6 hours").collect()}
    assert got and all(want[key] == value for key, value in got.items())
    last = max(k[0] for k in want)
    assert all(k in got for k in want if k[0] < last)  # only the open window is held back

    items = views.items(spark, sf_dir).repartition(3)
    items.write.parquet(str(tmp_path / "items"))
    answers = spark.readStream.schema(items.schema).parquet(str(tmp_path / "items"))
    names = ["faithfulness", "ndcg", "f1_score"]
    scoring.start_scoring(answers, str(tmp_path / "scored"), str(tmp_path / "ck2"), names).awaitTermination(120)
    from plumbline.operators.evaluate import evaluate

    a = sorted(map(tuple, spark.read.parquet(str(tmp_path / "scored")).select("item_id", *names).collect()))
    assert a == sorted(map(tuple, evaluate(items, names).select("item_id", *names).collect()))


STORED = "item_id long, f1_score double, mrr double, error_type string, prompt_tokens long, completion_tokens long, latency_ms double, cost_usd double"


def _batch(spark, n, seed):
    import random

    pick = random.Random(seed)
    rows = [
        (i, pick.random(), pick.choice([None, 0.1, 1 / 3]), pick.choice([None, None, "Timeout"]), pick.choice([None, i]), 2, pick.random() * 900, pick.random() / 1e3)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, STORED)


def test_batches_add_up_to_the_whole_run(spark, tmp_path):
    store, metrics = str(tmp_path / "store"), ["f1_score", "mrr"]
    parts = [_batch(spark, n, n) for n in (40, 7, 300)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rp.save_run(whole, store, metrics, "whole", "2024-01-01T00:00:00Z")
    rp.save_run(parts[0], store, metrics, "merged", "2024-01-01T00:00:00Z", {"dataset_path": "d"})
    for part in parts[1:]:
        rp.add_results(part.repartition(3), store, metrics, "merged")
    runs = {r["run_id"]: r.asDict() for r in rp.read_runs(spark, store).collect()}
    same = [c for c in runs["whole"] if c not in ("run_id", "dataset_path", "config")]
    assert all(runs["whole"][c] == runs["merged"][c] for c in same) and runs["merged"]["dataset_path"] == "d"
    means = {(r["run_id"], r["metric"]): (r["mean_score"], r["n"]) for r in rp.read_means(spark, store).collect()}
    assert all(means["whole", m] == means["merged", m] for m in metrics)
    assert rp.read_results(spark, store).where("run_id = 'merged'").count() == 347
    assert rp.read_errors(spark, store).where("run_id = 'merged'").count() == whole.where("error_type is not null").count()
    with pytest.raises(ValueError):
        rp.add_results(parts[0], store, metrics, "unknown")


@pytest.mark.parametrize("step", ["_sums", "_commit"])
def test_broken_save_leaves_no_run(spark, tmp_path, monkeypatch, step):
    store = str(tmp_path / "store")
    rp.save_run(_batch(spark, 5, 1), store, ["mrr"], "kept", "2024-01-01T00:00:00Z")

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(rp, step, fail)
        for run in ("kept", "new"):
            with pytest.raises(RuntimeError):
                rp.save_run(_batch(spark, 50, 2), store, ["mrr"], run, "2024-02-01T00:00:00Z")
    assert [(r["run_id"], r["total"]) for r in rp.read_runs(spark, store).collect()] == [("kept", 5)]
    assert rp.read_results(spark, store).count() == 5
    rp.save_run(_batch(spark, 50, 2), store, ["mrr"], "new", "2024-02-01T00:00:00Z")
    rp.save_run(_batch(spark, 50, 2), store, ["mrr"], "new", "2024-02-01T00:00:00Z")
    assert sorted((r["run_id"], r["total"]) for r in rp.read_runs(spark, store).collect()) == [("kept", 5), ("new", 50)]
    assert rp.read_results(spark, store).where("run_id = 'new'").count() == 50
