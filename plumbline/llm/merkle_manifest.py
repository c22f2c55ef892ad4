"""Merkle manifest of a dataset: one tree per group, one tree over the groups.

Nodes are SHA-256 digests in lower-case hexadecimal, so every node of a level is
64 characters wide. The leaves of a group are cut into aligned blocks, and a block
keeps each of its levels as one string of concatenated digests: the parents of a
level are the digests of its substrings of three widths, and the siblings of a
node are the substrings beside it in its run. The last level of a block is one
node; the nodes of all blocks of a group are the leaves of the next round, and so
on until a group has one node. A block is small whatever the size of its group, so
a group that holds a third of all rows is many rows of work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage

#: Hexadecimal digits of a digest, and nodes of a run.
WIDTH, FAN = 64, 3
#: Levels in a block, which has FAN ** LEVELS leaves.
LEVELS = 6
#: Tables of at most so many rows are broadcast.
SMALL_ROWS = 50_000

_PATH = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row by the values of its fields, in order."""
    return F.sha2(F.concat(*map(field_text, values)).cast("binary"), 256)


def _ordered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, which ascends with ``keys`` over all rows; equal rows are told apart by ``salt``."""
    spread = nodes.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt")
    return cut_lineage(spread.withColumn("pos", F.monotonically_increasing_id()))


def _numbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(g, idx, total, node, row): the number of each row within its group ``g``, and the size of the group."""
    placed = _ordered(nodes, ["g", *keys]).withColumn("part", F.shiftright("pos", 33))
    counted = placed.groupBy("g", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("g")
    earlier = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(
        counted.select(
            F.col("g").alias("_g"),
            F.col("part").alias("_part"),
            (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("n").over(group).alias("total"),
        )
    )
    if starts.count() <= SMALL_ROWS:
        starts = F.broadcast(starts)
    here = F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part"))
    return placed.join(starts, here).select("g", (F.col("pos") + F.col("shift")).alias("idx"), "total", "node", "row")


def _parents(level: Column) -> Column:
    """The next level: a digest for each run of a level, whose last run may be short."""
    runs = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / (WIDTH * FAN)).cast("int"))
    joined = F.array_join(F.transform(runs, lambda i: F.sha2(level.substr(i * WIDTH * FAN + 1, F.lit(WIDTH * FAN)), 256)), "")
    return joined.cast("binary")


def _levels(items: Column, alone: Column, levels: int) -> Column:
    """All levels of a block; a block that is its whole group stops at one node."""
    first = F.array_join(F.transform(items, lambda x: x["node"]), "").cast("binary")

    def grow(done: Column, _: Column) -> Column:
        top = F.element_at(done, -1)
        over = alone & (F.octet_length(top) == WIDTH)
        return F.when(over, done).otherwise(F.concat(done, F.array(_parents(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(first), grow)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Blocks (g, block, total, items, levels, node) of the nodes, then of the blocks' nodes, and so on."""
    size, rounds = FAN**levels, []
    while True:
        blocks = (
            nodes.groupBy("g", F.floor(F.col("idx") / size).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "node", "row"))).alias("items"), F.max("total").alias("total"))
            .withColumn("levels", _levels(F.col("items"), F.col("total") <= size, levels))
            .withColumn("node", F.element_at("levels", -1).cast("string"))
        )
        rounds.append(cut_lineage(blocks))
        open_blocks = rounds[-1].where(F.col("total") > size)
        if open_blocks.isEmpty():
            return rounds
        nodes = open_blocks.select(
            "g", F.col("block").alias("idx"), F.ceil(F.col("total") / size).alias("total"), "node", F.col("block").alias("row")
        )


def _tops(rounds: list[DataFrame], levels: int) -> DataFrame:
    """(g, node, round): the last node of every group and the round that made it."""
    ended = [r.where(F.col("total") <= FAN**levels).select("g", "node", F.lit(n).alias("round")) for n, r in enumerate(rounds)]
    return reduce(DataFrame.unionByName, ended)


def _siblings(levels: Column, place: Column) -> Column:
    """The rest of the run on each level below the last: what stands left and right of the node on the path."""

    def beside(level: Column, height: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FAN), height)).cast("int")
        run = at - at % FAN
        left = level.substr(run * WIDTH + 1, (at - run) * WIDTH)
        right = level.substr((at + 1) * WIDTH + 1, (run + FAN - 1 - at) * WIDTH)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(row, node, path, subroot, root) of the first round's items.

    ``tops`` has (g, round, path, subroot, root) of the last node of every group. Paths
    go down from round to round; only blocks are joined, each with one row of its own.
    """
    size, below = FAN**levels, None
    for number in range(len(rounds) - 1, -1, -1):
        upper = tops.where(F.col("round") == number).select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if below is not None:
            upper = upper.unionByName(below.select("g", F.col("row").alias("block"), "path", "subroot", "root"))
        upper = upper.select(*(F.col(c).alias(f"_{c}") for c in upper.columns))
        blocks = rounds[number]
        joined = blocks.join(upper, blocks["g"].eqNullSafe(F.col("_g")) & (blocks["block"] == F.col("_block")))
        each = F.transform(
            "items",
            lambda x: F.struct(
                x["row"].alias("row"),
                x["node"].alias("node"),
                F.concat(_siblings(F.col("levels"), x["idx"] % size), F.col("_path")).alias("path"),
            ),
        )
        below = joined.select("g", F.explode(each).alias("x"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))
        below = below.select("g", "x.row", "x.node", "x.path", "subroot", "root")
    return below


def manifest(docs: DataFrame, leaf: Column, group: Column, order: list[Column], levels: int = LEVELS) -> DataFrame:
    """Every row of ``docs`` with its leaf, the root of its group, the root of all, and its proof.

    Returns (row, leaf, subroot, root, path): ``row`` has all columns of ``docs`` (none of
    a map type), ``path`` the siblings level by level up to the root, as what stands
    left and right. ``leaf`` is a digest as 64 digits, ``group`` and ``order`` are columns
    of ``docs``. Leaves of a group ascend by ``order``, nulls first, and rows that tie
    by their leaf; repeated rows are leaves of their own. Groups ascend by their value,
    a null group first. An empty table has no rows. ``levels`` sets the size of a block
    and changes no result.
    """
    names = [f"o{n}" for n in range(len(order))]
    nodes = docs.select(
        group.alias("g"),
        *(c.alias(n) for c, n in zip(order, names, strict=True)),
        leaf.alias("node"),
        F.monotonically_increasing_id().alias("salt"),
        F.struct(*docs.columns).alias("row"),
    )
    rounds = _rounds(_numbered(cut_lineage(nodes), [*names, "node"]), levels)
    tops = _tops(rounds, levels)
    roots = tops.select(F.lit(0).alias("g"), F.col("g").alias("o"), "node", F.lit(0).alias("salt"), F.struct("g", "node", "round").alias("row"))
    root_rounds = _rounds(_numbered(roots, ["o"]), levels)
    none = F.lit(None).cast("string")
    last = _tops(root_rounds, levels).select(
        "g", "round", F.array().cast(_PATH).alias("path"), none.alias("subroot"), F.col("node").alias("root")
    )
    upper = _descend(root_rounds, last, levels).select("row.g", "row.round", "path", F.col("row.node").alias("subroot"), "root")
    return _descend(rounds, upper, levels).select("row", F.col("node").alias("leaf"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings from the leaf to the root, left to right on each level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "").cast("binary"), 256)


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))
