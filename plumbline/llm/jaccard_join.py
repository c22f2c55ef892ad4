"""N-gram Jaccard join: MinHash bands for candidates, full n-gram sets for links.

Documents with equal sets are one class from the start. Classes that share a band
form candidate groups; in each group all pairs are compared on their full sets,
block by block, so that links are counted and followed without writing a row per
pair, and no task holds more than a bounded number of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_batches
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import mix, shingle_set

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.995
MAX_HASHES = 128
#: N-grams of all classes in one block; two blocks meet in a task.
BLOCK_GRAMS = 250_000


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair at ``threshold`` meets with probability ``recall``."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches the recall")


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return numbers[:n] | np.uint64(1), numbers[n:]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number for each band of the MinHash signature."""
    a, b = _factors(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 4096):
        part = grams[at : at + 4096]
        np.minimum(low, (part[:, None] * a + b).min(axis=0), out=low)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in low.reshape(bands, rows).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """(doc_id, set_key, n_grams, bands) of every document; set_key is null without any word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, signs = [], [], []
            for text in batch["text"].to_pylist():
                grams = shingle_set(text, n)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sizes.append(len(grams))
                signs.append(band_hashes(grams, bands, rows) if len(grams) else [])
            columns = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "set_key", "n_grams", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind}, set_key binary, n_grams long, bands array<long>"
    )


def compare_blocks(sets: list[np.ndarray], block: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, and a set of its component within these.

    With ``block`` only pairs of sets in different blocks count. Sets of too different
    sizes cannot link and are not compared.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    grams = np.concatenate([sets[i] for i in order])
    _, place = np.unique(grams, return_inverse=True)
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    held = np.zeros(place.max() + 1, np.bool_)
    links, parent = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(order) - 1):
        i = order[a]
        # Later sets are at least as large; beyond size / threshold none can link.
        last = int(np.searchsorted(sizes[order], sizes[i] / threshold + 1e-9, side="right"))
        if last <= a + 1:
            continue
        held[place[starts[a] : ends[a]]] = True
        common = np.add.reduceat(held[place[starts[a + 1] : ends[last - 1]]], starts[a + 1 : last] - starts[a + 1], dtype=np.int64)
        held[place[starts[a] : ends[a]]] = False
        others = order[a + 1 : last]
        linked = common >= threshold * (sizes[i] + sizes[others] - common) - 1e-9
        if block is not None:
            linked &= block[others] != block[i]
        hits = others[linked]
        links[i] += len(hits)
        links[hits] += 1
        for j in hits:
            one, two = sorted((root(i), root(j)))
            parent[two] = one
    return links, np.array([root(x) for x in range(len(sets))])


def _candidates(classes: DataFrame) -> DataFrame:
    """(set_key, group): classes joined through shared bands."""
    rows = classes.select("set_key", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("set_key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = rows.join(heads, "band").where("set_key != head").select(F.col("set_key").alias("u"), F.col("head").alias("v"))
    return connected_components(edges).select(F.col("node").alias("set_key"), F.col("root").alias("group"))


def _blocked(members: DataFrame, block_grams: int) -> DataFrame:
    """(set_key, doc_id, group, block, blocks): classes of a group spread over blocks by their key."""
    sizes = members.groupBy("group").agg(F.sum("n_grams").alias("grams"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("grams") / block_grams)).cast("int")
    spread = members.join(sizes.select("group", blocks.alias("blocks")), "group")
    return spread.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` with the n-grams of each: one row for a class, however many rows of ``docs`` repeat it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"].to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["set_key", "grams"])

    firsts = members.select(F.col("doc_id").alias("first_id"))
    texts = docs.select("doc_id", "text").join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    once = texts.mapInArrow(read, "set_key binary, grams binary").dropDuplicates(["set_key"])
    return once.join(members.drop("doc_id"), "set_key")


def _compared(docs: DataFrame, members: DataFrame, n: int, threshold: float) -> DataFrame:
    """(set_key, links, other): links found in each pair of blocks, and a class linked through them."""
    sets = _sets(docs, members, n)
    mine, one = F.col("block"), F.lit(1)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - one),
        lambda b: F.struct(F.least(b, mine).alias("low"), F.greatest(b, mine).alias("high")),
    )
    dealt = sets.select("set_key", "grams", "group", "block", F.explode(pairs).alias("pair"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
        apart = frame["low"].iat[0] != frame["high"].iat[0]
        links, root = compare_blocks(grams, frame["block"].to_numpy() if apart else None, threshold)
        keys = frame["set_key"].to_numpy()
        return pd.DataFrame({"set_key": keys, "links": links, "other": keys[root]})

    flat = dealt.select("set_key", "grams", "group", "block", "pair.low", "pair.high")
    return flat.groupBy("group", "low", "high").applyInPandas(compare, "set_key binary, links long, other binary")


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    recall: float = RECALL,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    ``class_id`` is the smallest doc_id of all documents that are linked directly or
    through others, ``n_links`` the number of different n-gram sets that link to the
    document's own, and ``n_copies`` the number of other documents with the same set.
    Two sets link when their Jaccard similarity is ``threshold`` or more. A document
    without words (null, empty) is a class of its own; its class_id is its doc_id.
    Repeated rows are copies. Documents without doc_id take part, and have the class
    of their group. Only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    signed = cut_lineage(signatures(docs, bands, rows, n))
    classes = (
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    )
    classes = cut_lineage(classes)
    members = classes.join(_candidates(classes), "set_key").select("set_key", "doc_id", "n_grams", "group")
    blocked = cut_lineage(_blocked(members, block_grams))
    compared = cut_lineage(_compared(docs, blocked, n, threshold))
    links = compared.groupBy("set_key").agg(F.sum("links").alias("n_links"))
    edges = compared.where("set_key != other").select(F.col("set_key").alias("u"), F.col("other").alias("v"))
    roots = connected_components(edges).select(F.col("node").alias("set_key"), "root")

    rooted = (
        classes.select("set_key", "doc_id", "n")
        .join(links, "set_key", "left")
        .join(roots, "set_key", "left")
        .withColumn("root", F.coalesce("root", "set_key"))
    )
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    told = rooted.join(lowest, "root").select("set_key", "class_id", "n_links", (F.col("n") - 1).alias("n_copies"))
    none = F.lit(0).cast("long")
    return signed.select("doc_id", "set_key").join(told, "set_key", "left").select(
        "doc_id",
        F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("n_copies", none).alias("n_copies"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``docs`` with one document of each group of linked documents: the one with the smallest doc_id.

    A doc_id names one document: of repeated rows of it one stays. Documents without
    doc_id are kept, since nothing tells them apart.
    """
    classes = jaccard_join(docs, threshold, n)
    kept = classes.where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)
