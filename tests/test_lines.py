"""Line numbers over splits, and corpora of mixed files."""

from __future__ import annotations

import gzip

import pytest

from plumbline.sources import corpus as cs
from plumbline.sources import datasets as ds
from plumbline.sources.lines import numbered_lines


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ["2000", "1", "64"], strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_numbers_over_splits(spark, tmp_path, small_splits):
    for name, n in (("one.txt", 3000), ("two.txt", 7), ("none.txt", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 5 else "\n" for i in range(1, n + 1)))
    lines = numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 1
    got = sorted((r.filename, r.line, r.value) for r in lines.collect())
    assert got == sorted((f, i, f"{f} {i}" if i % 5 else "") for f, n in (("one.txt", 3000), ("two.txt", 7)) for i in range(1, n + 1))


def test_rejected_lines_keep_their_numbers(spark, tmp_path, small_splits):
    body = ['{"question": "Q"}' if i % 100 else "broken" for i in range(1, 1001)]
    (tmp_path / "a.jsonl").write_text("\r\n".join(body))
    good, bad = ds.read_jsonl(spark, str(tmp_path))
    assert good.count() == 990
    assert sorted(r.line for r in bad.collect()) == list(range(100, 1001, 100))


def test_documents_of_other_endings(spark, tmp_path):
    lines, whole = '{"id": "1", "content": "x"}\n{"id": "2", "content": "y"}\n', '[{"id": "3", "content": "z"},\n {"id": "4"}]'
    (tmp_path / "a.ndjson").write_text(lines)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(lines.encode()))
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(whole.encode()))
    for name, ids in (("a.ndjson", ["1", "2"]), ("b.jsonl.gz", ["1", "2"]), ("c.json.gz", ["3", "4"])):
        assert sorted(r.doc_id for r in cs.read_documents(spark, str(tmp_path / name)).collect()) == ids
    assert cs.read_documents(spark, str(tmp_path)).count() == 6
    (tmp_path / "d.txt").write_text(lines)
    with pytest.raises(cs.CorpusError):
        cs.read_documents(spark, str(tmp_path / "d.txt"))


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "content": "x"}\n{"id": "2", "content": "y"}\n{"id": "3"}\n')
    (tmp_path / "b.json").write_text('[{"id": "4", "content": "z"},\n {"id": "5", "metadata": {"k": "v"}}]')
    (tmp_path / "c.txt").write_text("no documents")
    got = {r.doc_id: r.content for r in cs.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"1": "x", "2": "y", "3": "", "4": "z", "5": ""}
    assert cs.read_documents(spark, str(tmp_path / "a.jsonl")).count() == 3
    assert cs.read_documents(spark, str(tmp_path / "b.json")).count() == 2
