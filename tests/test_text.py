from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.functions.dates import document_date
from plumbline.functions.qa_text import parse_qa


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(fn(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Paris is big. It is old!", ["Paris is big", "It is old"]),
        ("It rains, and it pours, However it stops.", ["It rains", "it pours", "it stops"]),
        ("One; two;three", ["One", "two", "three"]),
        ("First, but second; third", ["First", "second; third"]),
        ("wait .", ["wait "]),
        ("  ", []),
        (None, []),
    ],
)
def test_claims(spark, text, expected):
    assert one(spark, text, tx.claims) == expected


@pytest.mark.parametrize(
    "a, b, n",
    [("the cat sat", "cat sat on", 7), ("hello", "hello", 5), ("ab", "cd", 0), ("", "x", 0),
     ("aaaa", "aa", 2), ("xyab", "abxy", 2), ("a" * 400, "a" * 300 + "b", 300)],
)
def test_char_overlap_cases(a, b, n):
    import pandas as pd

    assert tx._overlaps(pd.Series([a]), pd.Series([b]))[0] == n


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=80), st.text("ab", max_size=80))
def test_char_overlap_equals_brute_force(a, b):
    import pandas as pd

    want = next(
        (n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n]) or b.endswith(a[:n])), 0
    )
    assert tx._overlaps(pd.Series([a]), pd.Series([b]))[0] == want
    if a and b:
        want = next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)
        assert tx._border_by_hashes(a, b) == want


def test_char_overlap_of_long_repeats():
    import time

    import pandas as pd

    start = time.process_time()
    for x, y, n in (("a" * 100_000, "a" * 100_000, 100_000), ("a" * 100_000, "a" * 99_999 + "b", 99_999), ("ab" * 50_000, "ba" * 50_000, 99_999), ("🙂é" * 40_000 + "x", "🙂é" * 40_000, 80_000)):
        assert tx._overlaps(pd.Series([x]), pd.Series([y]))[0] == n
    assert time.process_time() - start < 5


def test_multiset_overlap_equals_counter(spark):
    rows = [("cat cat cat", "cat cat"), ("a b a c", "a a a b"), ("", "x"), ("x y", "z"),
            ("b a b a b", "a b c b")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(
        F.size(
            F.array_intersect(
                tx.occurrence_labels(tx.words(F.col("a"))), tx.occurrence_labels(tx.words(F.col("b")))
            )
        ).alias("n")
    ).collect()
    want = [sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in rows]
    assert [r["n"] for r in got] == want


def test_token_sets(spark):
    assert sorted(one(spark, "What IS the Größe of the Straße_1?", tx.question_words)) == [
        "größe", "of", "straße_1",
    ]
    assert one(spark, "Which keywords does this text have?", tx.keywords) == ["keywords", "text"]
    assert one(spark, " A  b\nA ", tx.split_words) == ["A", "b", "A"]
    assert one(spark, " A b ", tx.words) == ["a", "b"]
    assert one(spark, "  Hello \n World ", tx.normalize_context) == "hello world"


@pytest.mark.parametrize("size, overlap", [(50, 10), (30, 10), (7, 0)])
def test_chunks_equal_python(spark, size, overlap):
    text = "Der  Text, " * 20 + "\n" * 40 + "end"
    want = [text[i : i + size].strip() for i in range(0, len(text), size - overlap)]
    assert one(spark, text, lambda c: tx.chunks(c, size, overlap)) == [w for w in want if w]
    assert one(spark, None, lambda c: tx.chunks(c, size, overlap)) == []


def test_chunks_reject_bad_sizes():
    with pytest.raises(ValueError):
        tx.chunks(None, 10, 10)


@pytest.mark.parametrize(
    "text, label",
    [
        ("A first sentence. Then more", "A first sentence"),
        ("Short. still going on! Yes", "Short. still going on"),
        ("x" * 90, "x" * 57 + "..."),
        ("   ", "Untitled topic"),
        ("A heading here\nbody", "A heading here"),
    ],
)
def test_topic_label(spark, text, label):
    assert one(spark, text, tx.topic_label) == label


@pytest.mark.parametrize(
    "text, score",
    [("The score is 0.85", 0.85), ("85%", 0.85), ("8.5", 0.85), ("250", 1.0), ("-3 of them", 0.3),
     ("Yes, the answer is excellent", 1.0), ("No, not at all", 0.0), ("some random text", 0.5)],
)
def test_judge_score(spark, text, score):
    assert one(spark, text, tx.judge_score) == pytest.approx(score)


def test_json_helpers(spark):
    assert one(spark, 'So: {"a": {"b": [1, {"c": 42}]}} ok', tx.embedded_json) == (
        '{"a": {"b": [1, {"c": 42}]}}'
    )
    assert one(spark, "no {json} here", tx.embedded_json) is None
    doc = '{"a": {"b": [{"c": 42}]}}'
    assert one(spark, doc, lambda c: tx.json_path(c, "a.b.0.c")) == "42"
    assert one(spark, doc, lambda c: tx.json_path(c, "a.x.0")) is None
    assert one(spark, doc, lambda c: tx.json_path(c, None)) == doc


@pytest.mark.parametrize(
    "text, day",
    [
        ("Last updated: 2020-01-15.", "2020-01-15 00:00:00"),
        ("on 2021-03-04T05:06:07 and 2020-01-01", "2021-03-04 05:06:07"),
        ("seen 3/9/2019", "2019-03-09 00:00:00"),
        ("March 5, 2018", "2018-03-05 00:00:00"),
        ("Sep 7 2017", "2017-09-07 00:00:00"),
        ("2020-13-45 then 2/3/2016", "2016-02-03 00:00:00"),
        ("x" * 500 + "2020-01-15", "2020-01-15 00:00:00"),
        ("none", None),
    ],
)
def test_dates_in_text(spark, text, day):
    got = one(spark, text, lambda c: F.date_format(document_date(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == day


@pytest.mark.parametrize(
    "metadata, day",
    [
        ({"date": "2020-01-15", "updated_at": "2021-01-01T00:00:00Z"}, "2021-01-01 00:00:00"),
        ({"updated_at": "soon", "created_at": "1/2/2020"}, "2020-01-02 00:00:00"),
        ({"timestamp": "1579046400", "created_at": "1/2/2020"}, "2020-01-02 00:00:00"),
        ({"date": "20200115"}, "2022-02-02 00:00:00"),
        ({"updated_at": "2020-01-15T10:00:00.123456+02:00"}, "2020-01-15 08:00:00"),
        ({"updated_at": "2020-01-15T10:00:00+0200"}, "2020-01-15 08:00:00"),
        ({}, "2022-02-02 00:00:00"),
    ],
)
def test_dates_in_metadata(spark, metadata, day):
    df = spark.createDataFrame([("2022-02-02", metadata)], "c string, m map<string,string>")
    at = document_date(F.col("c"), F.col("m"))
    assert df.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("x")).first()["x"] == day


@pytest.mark.parametrize(
    "numbers, day",
    [
        ({"timestamp": 1579046400.0}, "2020-01-15 00:00:00"),
        ({"timestamp": 1500000000000.0, "created_at": 1579046400.0}, "2020-01-15 00:00:00"),
        ({"timestamp": float("nan")}, "2022-02-02 00:00:00"),
    ],
)
def test_numeric_dates_in_metadata(spark, numbers, day):
    df = spark.createDataFrame([("2022-02-02", numbers)], "c string, n map<string,double>")
    at = document_date(F.col("c"), None, F.col("n"))
    assert df.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("x")).first()["x"] == day


def test_date_only_in_the_header(spark):
    text = "x" * 500 + "2020-01-15"
    assert one(spark, text, lambda c: document_date(c, header_chars=500)) is None


PAIR = '{"question": "Q?", "answer": "A"}'


@pytest.mark.parametrize(
    "text, want",
    [
        (f"[{PAIR}]", [("Q?", "A")]),
        (f"```json\n[{PAIR}]\n```", [("Q?", "A")]),
        (f"Sure:\n[{PAIR},]\nbye", [("Q?", "A")]),
        ("[{'question': 'Q?', 'answer': 'A'}]", [("Q?", "A")]),
        (PAIR, [("Q?", "A")]),
        (f'[1, "x", {PAIR}, {PAIR}]', [("Q?", "A")]),
        (f'{PAIR} and {{"question": "R?", "answer": "B"}}', [("Q?", "A"), ("R?", "B")]),
        ('"question": "Q?" ... "answer": "A"', [("Q?", "A")]),
        ('[{"question": " Q? ", "answer": ""}]', []),
        ("plain text", []),
        (None, []),
    ],
)
def test_parse_qa(spark, text, want):
    assert [tuple(p) for p in one(spark, text, parse_qa)] == want


def test_parse_qa_adversarial_keeps_empty_answers(spark):
    got = one(spark, '[{"question": " Q? ", "answer": ""}]', lambda c: parse_qa(c, False))
    assert [tuple(p) for p in got] == [(" Q? ", "")]


def test_best_context_takes_the_first_best(spark):
    df = spark.createDataFrame([("red car", ["blue car", "red bus", "red car red"])], "a string, c array<string>")
    assert df.select(tx.best_context(F.col("a"), F.col("c")).alias("x")).first()["x"] == "red car red"
    assert re.match("blue", df.select(tx.best_context(F.lit("car"), F.col("c")).alias("x")).first()["x"])
