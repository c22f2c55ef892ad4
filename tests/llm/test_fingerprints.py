"""Fingerprints against a plain version that goes window by window."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from conftest_llm import DOC_SCHEMA, make_docs, prose
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as fp
from plumbline.llm.queries import op12_fingerprints
from plumbline.llm.shingles import mix

TEXTS = [
    prose(1, 200), "", None, "a", "short text", prose(2, 900), prose(1, 200), prose(1, 100) + " " + prose(3, 100), "é🙂" * 90, "=" * 500, prose(4, 11),
    "\0" * 70, "x" * 63, "x" * 64, prose(5, 3000), "Rule: " + "-" * 200 + prose(6, 40), None, prose(7, 60), prose(7, 60), prose(7, 60),
]


def windows(text):
    data = (text or "").encode()
    data = bytes(63) + data + bytes(63) if data else b""
    return [data[at : at + 64] for at in range(len(data) - 63)] if data else []


def entropy(window):
    parts = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    most = 64 * 6 * 65536
    return (most - parts) * 1000 // most


def ranks_of(texts):
    counts = Counter(entropy(w) for t in texts for w in windows(t))
    order = sorted(range(1001), key=lambda e: (1, -e, 0) if e < 100 else (0, counts[e], e))
    return {e: n for n, e in enumerate(order)}


def chosen(text, ranks):
    found = [ranks[entropy(w)] for w in windows(text)]
    points = Counter()
    for first in range(-63 if found else 0, len(found)):
        rivals = range(max(first, 0), min(first + 64, len(found)))
        points[min(rivals, key=lambda at: (found[at], at))] += 1
    return [w for at, w in enumerate(windows(text)) if points[at] >= 16]


def plain_print(text, ranks):
    features = []
    for window in chosen(text, ranks):
        value = np.uint64(0x9E3779B97F4A7C15)
        for word in np.frombuffer(window, "<u8"):
            value = mix(np.array([value * np.uint64(0x9E3779B97F4A7C15) + word], np.uint64))[0]
        if int(value) not in features:
            features.append(int(value))
    chain = b""
    for at in range(0, len(features), 160):
        bits = ["0"] * 2048
        for value in features[at : at + 160]:
            for n in range(5):
                bits[value >> 11 * n & 2047] = "1"
        chain += int("".join(bits), 2).to_bytes(256, "big")
    return f"{len(features)}:{base64.b64encode(chain).decode()}"


def plain_likeness(one, other):
    if one == other:
        return 1.0
    parsed = []
    for told in (one, other):
        n, _, chain = told.partition(":")
        chain = base64.b64decode(chain)
        parsed.append((int(n), [int.from_bytes(chain[at : at + 256], "little") for at in range(0, len(chain), 256)]))
    (n, short), (_, long) = sorted(parsed, key=lambda x: x[0])
    total = 0.0
    for number, a in enumerate(short):
        best = 0.0
        for b in long:
            chance = a.bit_count() * b.bit_count() / 2048
            best = max(best, ((a & b).bit_count() - chance) / (min(a.bit_count(), b.bit_count()) - chance))
        total += best * min(160, n - 160 * number)
    return total / n if n else 0.0


@pytest.mark.filterwarnings("ignore:overflow")
@pytest.mark.parametrize("piece", [100, 1000, fp.PIECE])
def test_prints_are_those_of_the_plain_version(monkeypatch, piece):
    monkeypatch.setattr(fp, "PIECE", piece)
    ranks = ranks_of(TEXTS)
    counted = fp.Windows([(t or "").encode() for t in TEXTS]).count()
    assert {e: int(n) for e, n in enumerate(counted) if n} == Counter(entropy(w) for t in TEXTS for w in windows(t))
    table = np.array([ranks[e] for e in range(1001)], np.int32)
    assert fp.fingerprint_texts(TEXTS, table) == [plain_print(t, ranks) for t in TEXTS]
    assert fp.fingerprint_texts([], table) == [] and fp.fingerprint_texts([None, ""], table) == ["0:", "0:"]


@pytest.mark.filterwarnings("ignore:overflow")
def test_query(spark, tmp_path):
    rows = [(100 - n, t, "en", "s", 0, n, 1, "x") for n, t in enumerate(TEXTS)]
    rows += [rows[0]] * 40 + [(None, prose(9, 50), None, None, None, 1, 1, "x"), (None, None, None, None, None, 1, 1, "x")]
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_fingerprints(spark, str(tmp_path)).collect()
    hashes = {r.text: r.h for r in spark.createDataFrame([(r[1] or "",) for r in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    ranks = ranks_of([r[1] for r in rows])
    prints, expected = {}, Counter()
    for (doc_id, text), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        for t in (text, edited, after):
            if t not in prints:
                prints[t] = plain_print(t, ranks)
        near = [round(plain_likeness(prints[text], prints[t]), 9) for t in (edited, after)]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[text], prints[edited], *near] += 1
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == expected


def test_small_tables(spark, tmp_path):
    make_docs(spark, ["only one"]).write.parquet(f"{tmp_path}/one/documents.parquet")
    make_docs(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    only = op12_fingerprints(spark, f"{tmp_path}/one").first()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"onlyonly").hexdigest()
    assert op12_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_likeness(spark):
    texts = [prose(1, 2000), prose(1, 2000)[:6000] + prose(2, 1000), prose(3, 2000), ""]
    ranks = fp.rarity(fp.entropy_counts(make_docs(spark, texts)))
    told = [r.f for r in make_docs(spark, texts).orderBy("doc_id").select(fp.fingerprint(F.col("text"), ranks).alias("f")).collect()]
    pairs = spark.createDataFrame([(a, b, told[a], told[b]) for a in range(4) for b in range(4)], "a int, b int, one string, other string")
    like = {(r.a, r.b): r.like for r in pairs.select("a", "b", fp.likeness(F.col("one"), F.col("other")).alias("like")).collect()}
    assert all(like[a, b] == like[b, a] and 0 <= like[a, b] <= 1 for a, b in like) and all(like[a, a] == 1.0 for a in range(4))
    assert like[0, 1] > 0.4 > 0.15 > like[0, 2] and like[0, 3] == 0.0
