"""JSON arrays and quoted CSV by ranges, against Spark's whole-file readers and Python's parsers."""

from __future__ import annotations

import csv
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.sources import datasets as ds
from plumbline.sources import ranges as rg

HARD = ['plain', 'quote " in', 'back\\slash', 'both \\" of them', 'brace } and { and ] [', 'line\nend', '"', "", "\\", "é } 🙂", '"items": [', "a,b", "\t", "}}}}", "\\\\\\"]


@pytest.fixture(params=[700, 5000])
def small_splits(spark, request, monkeypatch):
    """Ranges of some records, or shorter than a record; and chunks shorter than a range."""
    monkeypatch.setattr(rg, "CHUNK", 300)
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, [str(request.param), "1", "64"], strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def made_items(n, seed):
    pick = random.Random(seed)

    def text():
        return " ".join(pick.choice(HARD) for _ in range(pick.randint(1, 12))) * (60 if pick.random() < 0.03 else 1)

    for number in range(n):
        item = {"question": f"{number} {text()}", "ground_truth": text()}
        if pick.random() < 0.5:
            item |= {"metadata": {"id": number, "deep": [{"x": text()}, [1, "]"]]}, "contexts": [text(), None], "other": {"items": [{"question": "no"}]}}
        yield item


def test_json_equals_whole_files(spark, tmp_path, small_splits):
    for name, indent, seed in (("a", None, 1), ("b", 2, 2), ("c", None, 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps(list(made_items(150, seed)), indent=indent, ensure_ascii=seed == 1))
    wrapped = {"name": 'x "items": [', "about": {"items": [{"question": "wrong"}], "n": [[1]]}, "items": list(made_items(150, 4)), "after": [{"question": "wrong"}, "items"]}
    (tmp_path / "d.json").write_text(json.dumps(wrapped, ensure_ascii=False))
    (tmp_path / "small.json").write_text('{"v": 1, "items": [{"question": "few"}]}')
    (tmp_path / "one.json").write_text('{"question": "single", "context": "c"}')
    (tmp_path / "none.json").write_text("[]")
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() > 20
    got = ds.read_json(spark, str(tmp_path))
    expected = Counter()
    for name in ("a", "b", "c", "d"):
        data = json.loads((tmp_path / f"{name}.json").read_text())
        expected.update((i["question"], i["ground_truth"], tuple(i.get("contexts") or ())) for i in (data["items"] if name == "d" else data))
    expected.update([("few", None, ()), ("single", None, ())])
    assert Counter((r.question, r.ground_truth, tuple(r.contexts or ())) for r in got.collect()) == expected
    numbers = [json.loads(r.metadata)["id"] for r in got.where("metadata is not null").collect()]
    assert len(numbers) == sum("metadata" in i for s in (1, 2, 3, 4) for i in made_items(150, s))
    assert got.columns == [f.name for f in ds.ITEM_SCHEMA]


@pytest.mark.parametrize("text", ['[{"question": "a"}, 5]', "[1]", '[{"question": "a"} x {"question": "b"}]', '["}", {"question": "a"}]'])
def test_other_elements_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|parse|invalid"):
        ds.read_json(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ['[{"question": "a"}', '[{"question": "a"', '[{"question": "a}]', '[{"question": "a"}, {"question": "b"}'])
def test_unfinished_lists_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(rg.RangeError):
        ds.read_json(spark, str(tmp_path))


def test_json_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(i["question"], i["ground_truth"]) for i in made_items(300, 9)], "question string, ground_truth string")
    ds.write_json(items.repartition(3), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part*"))) == 3
    for part in (tmp_path / "out").glob("part*"):
        assert isinstance(json.loads(part.read_text()), list)
    back = ds.read_json(spark, str(tmp_path / "out")).select("question", "ground_truth")
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, items.collect()))


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_csv_equals_whole_files(spark, tmp_path, small_splits, ends):
    def write(name, rows, quoting):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as file:
            made = csv.writer(file, quoting=quoting, lineterminator=ends)
            made.writerow(["question", "ground_truth", "context", "metadata"])
            made.writerows(rows)

    def rows(seed):
        pick = random.Random(seed)
        for n, item in enumerate(made_items(150, seed)):
            context = pick.choice(['""', 'x\n"y"\n\n,z', "a" * 900, ',"', None, 'mid"dle'])
            yield [item["question"], item["ground_truth"], context, pick.choice(['{"a": "}"}', "raw", None])]

    write("a.csv", rows(1), csv.QUOTE_MINIMAL)
    write("b.csv", rows(2), csv.QUOTE_ALL)
    (tmp_path / "c.csv").write_text(f"question,ground_truth,context,metadata{ends}{ends}last,line,without,end")
    got = ds.read_csv(spark, str(tmp_path))
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    assert got.count() == 301

    def strip(c):
        return F.regexp_replace(c, r"^[\s]+|[\s]+$", "")

    expected = Counter(tuple(r) for r in whole.select(strip(F.coalesce("question", F.lit(""))), F.nullif(strip(F.col("ground_truth")), F.lit("")), F.nullif(strip(F.col("context")), F.lit(""))).collect())
    assert Counter((r.question, r.ground_truth, r.context) for r in got.collect()) == expected


def test_open_quote_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text('question\n"never closed\n')
    with pytest.raises(rg.RangeError):
        ds.read_csv(spark, str(tmp_path))


def test_line_states():
    """Both guesses of a line against Python's own reader."""
    pick = random.Random(1)
    for _ in range(3000):
        line = "".join(pick.choice('",ax') for _ in range(pick.randint(0, 12)))
        for inside in (False, True):
            quoted, at_start, after = inside, not inside, False
            for c in line:
                if quoted:
                    if c == '"':
                        quoted, after = False, True
                elif after and c == '"':
                    quoted, after = True, False
                elif c == ",":
                    at_start, after = True, False
                    continue
                elif at_start and c == '"':
                    quoted = True
                else:
                    after = False
                at_start = False
            assert rg.csv_effect(line.encode(), inside) == quoted, (line, inside)
