"""Chunking problems in the contexts of one item.

All checks stay in the row: contexts are one retrieval result, a handful of
texts. Each check returns rows (keys, issue_type, ctx_i, ctx_j, measure, description).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import (
    char_overlap,
    jaccard,
    keywords,
    let,
    strip,
    text_or_empty,
    texts_or_empty,
    word_set,
)

# --- fixed values: check thresholds ------------------------------------------
OVERLAP_SIMILARITY = 0.8
OVERLAP_FACTOR = 3
SIZE_RATIO = 4.0
SIZE_DEVIATION = 0.5
MIN_CHUNK_CHARS = 50
MIN_CHUNK_SHARE = 10  # a tenth of the expected chunk size
MISSING_SHARE = 0.6
# -----------------------------------------------------------------------------


def _contexts() -> Column:
    return F.transform(texts_or_empty(F.col("contexts")), text_or_empty)


def _later(i: Column, n: Column) -> Column:
    """Positions after i, none for the last one."""
    return F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))


def overlapping(df: DataFrame, *keys: str) -> DataFrame:
    """Pairs of contexts with word Jaccard above the limit."""

    def pairs(sets: Column) -> Column:
        return F.flatten(
            F.transform(
                sets,
                lambda a, i: F.transform(
                    _later(i, F.size(sets)),
                    lambda j: F.struct(
                        i.alias("ctx_i"),
                        j.alias("ctx_j"),
                        jaccard(a, F.get(sets, j)).alias("measure"),
                    ),
                ),
            )
        )

    found = F.filter(
        let(F.transform(_contexts(), word_set), pairs), lambda p: p["measure"] > OVERLAP_SIMILARITY
    )
    return df.select(*keys, F.inline(found)).select(
        *keys,
        F.lit("overlapping_chunks").alias("issue_type"),
        "ctx_i",
        "ctx_j",
        "measure",
        F.concat(
            F.lit("Contexts "), (F.col("ctx_i") + 1).cast("string"), F.lit(" and "),
            (F.col("ctx_j") + 1).cast("string"), F.lit(" share most words ("),
            F.format_string("%.2f", "measure"), F.lit(")."),
        ).alias("description"),
    )


def excess_overlap(df: DataFrame, *keys: str, chunk_overlap: str = "chunk_overlap") -> DataFrame:
    """Pairs whose character overlap is more than three times the expected one."""
    pairs = let(
        _contexts(),
        lambda cs: F.flatten(
            F.transform(
                cs,
                lambda a, i: F.transform(
                    _later(i, F.size(cs)),
                    lambda j: F.struct(
                        i.alias("ctx_i"), j.alias("ctx_j"), a.alias("a"), F.get(cs, j).alias("b")
                    ),
                ),
            )
        ),
    )
    rows = df.where(F.col(chunk_overlap).isNotNull()).select(
        *keys, F.col(chunk_overlap).cast("int").alias("expected"), F.inline(pairs)
    )
    measured = rows.select(
        *keys, "expected", "ctx_i", "ctx_j", char_overlap(F.col("a"), F.col("b")).alias("chars")
    )
    return measured.where(F.col("chars") > F.col("expected") * OVERLAP_FACTOR).select(
        *keys,
        F.lit("excessive_overlap").alias("issue_type"),
        "ctx_i",
        "ctx_j",
        F.col("chars").cast("double").alias("measure"),
        F.concat(
            F.lit("Contexts "), (F.col("ctx_i") + 1).cast("string"), F.lit(" and "),
            (F.col("ctx_j") + 1).cast("string"), F.lit(" overlap by "),
            F.col("chars").cast("string"), F.lit(" characters, "),
            F.col("expected").cast("string"), F.lit(" expected."),
        ).alias("description"),
    )


def _issue(keys, kind: str, i: Column, measure: Column, description: Column) -> list:
    return [
        *keys,
        F.lit(kind).alias("issue_type"),
        i.cast("int").alias("ctx_i"),
        F.lit(None).cast("int").alias("ctx_j"),
        measure.cast("double").alias("measure"),
        description.alias("description"),
    ]


def uneven_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Longest context more than four times the shortest."""
    sized = df.select(*keys, F.transform(_contexts(), F.length).alias("sizes")).select(
        *keys,
        F.size("sizes").alias("n"),
        F.array_min("sizes").alias("lo"),
        F.array_max("sizes").alias("hi"),
    )
    ratio = F.col("hi") / F.col("lo")
    return sized.where((F.col("n") >= 2) & (F.col("lo") > 0) & (ratio > SIZE_RATIO)).select(
        *_issue(
            keys, "inconsistent_chunk_sizes", F.lit(None), ratio,
            F.format_string("Chunk sizes run from %d to %d characters.", "lo", "hi"),
        )
    )


def size_deviation(df: DataFrame, *keys: str, chunk_size: str = "chunk_size") -> DataFrame:
    """Contexts far from the expected chunk size."""
    rows = df.where(F.col(chunk_size).cast("int") > 0).select(
        *keys,
        F.col(chunk_size).cast("int").alias("expected"),
        F.posexplode(F.transform(_contexts(), F.length)).alias("i", "size"),
    )
    deviation = F.abs(F.col("size") - F.col("expected")) / F.col("expected")
    return rows.where(deviation > SIZE_DEVIATION).select(
        *_issue(
            keys, "chunk_size_deviation", F.col("i"), deviation,
            F.format_string("The chunk has %d characters, %d expected.", "size", "expected"),
        )
    )


def small_chunks(df: DataFrame, *keys: str, chunk_size: str | None = None) -> DataFrame:
    """Contexts shorter than 50 characters, or than a tenth of the expected size."""
    least = F.lit(MIN_CHUNK_CHARS)
    if chunk_size:
        expected = F.col(chunk_size).cast("int")
        least = F.coalesce(F.floor(expected / MIN_CHUNK_SHARE), least)
    rows = df.select(
        *keys,
        least.alias("least"),
        F.posexplode(F.transform(_contexts(), lambda c: F.length(strip(c)))).alias("i", "size"),
    )
    return rows.where(F.col("size") < F.col("least")).select(
        *_issue(
            keys, "empty_or_small_chunk", F.col("i"), F.col("size"),
            F.format_string("The chunk has only %d characters.", "size"),
        )
    )


def content_gaps(df: DataFrame, *keys: str) -> DataFrame:
    """Most question keywords occur nowhere in the contexts."""
    base = df.select(
        *keys,
        _contexts().alias("cs"),
        keywords(F.col("question")).alias("wanted"),
    ).where((F.size("cs") > 0) & (F.size("wanted") > 0))
    missing = let(
        F.lower(F.array_join("cs", " ")),
        lambda text: F.filter("wanted", lambda w: ~F.contains(text, w)),
    )
    rows = base.select(*keys, F.size("wanted").alias("n"), missing.alias("missing"))
    lost = F.size("missing")
    return rows.where(lost > F.col("n") * MISSING_SHARE).select(
        *_issue(
            keys, "content_gap", F.lit(None), lost / F.col("n"),
            F.concat(
                F.lit("Question words missing from the contexts: "),
                F.array_join(F.slice(F.array_sort("missing"), 1, 5), ", "), F.lit("."),
            ),
        )
    )


def chunk_issues(
    df: DataFrame, *keys: str, chunk_size: str | None = None, chunk_overlap: str | None = None
) -> DataFrame:
    """Every chunk check that the columns allow, as one table."""
    parts = [overlapping(df, *keys), uneven_sizes(df, *keys),
             small_chunks(df, *keys, chunk_size=chunk_size), content_gaps(df, *keys)]
    if chunk_overlap:
        parts.append(excess_overlap(df, *keys, chunk_overlap=chunk_overlap))
    if chunk_size:
        parts.append(size_deviation(df, *keys, chunk_size=chunk_size))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
