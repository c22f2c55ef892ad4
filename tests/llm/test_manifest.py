"""Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import DOC_SCHEMA, prose
from pyspark.sql import functions as F

from plumbline.llm import merkle_manifest
from plumbline.llm.queries import op13_merkle_manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[at : at + 3])) for at in range(0, len(last), 3)])
    return levels


def proof(levels, at):
    path = []
    for level in levels[:-1]:
        run = at - at % 3
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return path


def plain(rows, tampers):
    """All rows of the query from (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        told = text.replace("\n", "") if text is not None and tampers(doc_id) else text
        groups[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, told)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = tree([x[1] for x in groups[source]])
    top = tree([trees[s][-1][0] for s in order])
    found = Counter()
    for number, source in enumerate(order):
        for at, (doc_id, own, told) in enumerate(groups[source]):
            path, node = proof(trees[source], at) + proof(top, number), told
            for left, right in path:
                node = digest(left + node + right)
            found[doc_id, own, trees[source][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0]] += 1
    return found


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


CASES = [(n, f"s{n % 7}" if n % 7 else None, "en", n, prose(n, 12) + "\n\nend\n" * (n % 3)) for n in range(120)]
CASES += [(1000 + n, "big", None, None, f"line {n}\nnext") for n in range(100)]
CASES += [(None, "big", "de", 3, "no\nid"), (None, "big", None, None, None), (None, None, None, None, None), (5, "s5", "en", 5, ""), (5, "s5", "en", 5, "\n")]
CASES += [(2000, "big", "en", 1, "one\nrow")] * 60 + [(3000, "é", "fr", 9, "x\ny " * 20_000), (3001, "", "", 0, "z"), (3002, "￿", "", 0, "z"), (3003, "𝄞", "", 0, "z")]


@pytest.mark.parametrize("levels", [1, 2, merkle_manifest.LEVELS])
def test_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest.manifest, "__defaults__", (levels,))
    rows = [(*r[:1], r[4], r[2], r[1], r[3], n, 1, "x") for n, r in enumerate(CASES)]
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    made = op13_merkle_manifest(spark, str(tmp_path))
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in made.collect()) == plain(CASES, tampered)


def test_small_tables(spark, tmp_path):
    one = spark.createDataFrame([(1, "a", None, "s", 1, 1, 1, "x")], DOC_SCHEMA)
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    one.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    only = op13_merkle_manifest(spark, f"{tmp_path}/one").first()
    assert only.leaf == only.subroot == only.root == leaf(1, "s", None, 1, "a") and only.proof_sha256 == digest("") and only.verified
    assert op13_merkle_manifest(spark, f"{tmp_path}/none").count() == 0


def test_carried_columns_and_paths(spark):
    """Columns with the names that the operator uses come back as they are, and every path proves its leaf."""
    docs = spark.range(500).select(
        F.sha2(F.col("id").cast("string"), 256).alias("node"), (F.col("id") % 3).alias("g"), F.col("id").alias("idx"), F.lit(7).alias("path"), F.lit("x").alias("salt")
    )
    made = merkle_manifest.manifest(docs, F.col("node"), F.col("g"), [F.col("idx")], levels=2)
    rows = made.select("row.*", merkle_manifest.folded_root(F.col("leaf"), made["path"]).alias("folded"), "root", "leaf").collect()
    assert len(rows) == 500 and all(r.folded == r.root and r.leaf == r.node and r.path == 7 and r.salt == "x" for r in rows)
