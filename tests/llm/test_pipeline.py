"""The corpus pipeline against a plain version of it, and the registered names."""

from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest_llm import prose
from test_pages_and_secrets import plain_spans
from test_text_operators import plain_classes, plain_distance
from tokenizers import Tokenizer

from plumbline.llm import decontamination
from plumbline.llm.shingles import word_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_masked(text: str) -> str:
    out, at = "", 0
    for _, begin, end in plain_spans(text):
        if begin >= at:
            out += text[at:begin] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture
def folder(spark, tmp_path):
    items = [prose(500 + n, 20 + n) for n in range(4)]
    texts = [prose(n, 30 + n) for n in range(40)]
    texts += [texts[3], texts[4] + " end", texts[5].replace(" ", "  "), None, "", "123 456 !", f"{prose(60, 20)} {items[1]} {prose(61, 20)}"]
    texts += [f"{prose(70, 30)} password=abcdef12 {prose(71, 5)} AKIA{'Q' * 18}", prose(72, 12_000)]
    rows = [(n, t, "en" if n % 9 else None, "s", len(t or "")) for n, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_pipeline(spark, folder):
    path, rows, items = folder
    docs = {n: t for n, t, *_ in rows if t and any(c.isalpha() for c in t)}
    classes = plain_classes(list(docs.items()))
    docs = {n: t for n, t in docs.items() if classes[n][0] == n}
    wanted = [word_hashes(t).tolist() for t in items]
    docs = {
        n: t
        for n, t in docs.items()
        if all(plain_distance(w, word_hashes(t).tolist()) > int(decontamination.RATE * len(w)) for w in wanted)
    }
    docs = {n: plain_masked(t) for n, t in docs.items()}
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for n, found in pieces.items():
        ids = np.array([*plain.encode(docs[n], add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in found) == len(ids)
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for spots in windows.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages(spark, folder):
    path, _, _ = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == COLUMNS
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names
