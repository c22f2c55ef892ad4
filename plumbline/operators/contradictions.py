"""Pairs worth comparing, prompts for a judge, and its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import embedded_json, text_or_empty, word_set
from plumbline.session import cut_lineage

# --- fixed values ------------------------------------------------------------
MIN_SHARED_WORDS = 3
MIN_WORD_CHARS = 5
CONFIDENT, VERY_CONFIDENT = 0.7, 0.9
# -----------------------------------------------------------------------------

PAIR_SCHEMA = "doc_a long, doc_b long, shared_words long"
FIRST_BATCH = 4
BATCH_GROWTH = 8


def _significant_words(docs: DataFrame) -> DataFrame:
    words = F.filter(word_set(F.col("content")), lambda w: F.length(w) >= MIN_WORD_CHARS)
    return docs.select("doc_id", F.explode(words).alias("word"))


def _pairs_up_to(words: DataFrame, after: int | None, cut: int, max_pairs: int) -> DataFrame:
    """The first pairs, in document order, whose left document comes after one id and not after ``cut``."""
    wanted = F.col("doc_id") <= cut
    if after is not None:
        wanted = wanted & (F.col("doc_id") > after)
    left = words.where(wanted).toDF("doc_a", "word")
    right = words.toDF("doc_b", "word")
    return (
        right.join(left, "word")
        .where(F.col("doc_a") < F.col("doc_b"))
        .groupBy("doc_a", "doc_b")
        .agg(F.count(F.lit(1)).alias("shared_words"))
        .where(F.col("shared_words") >= MIN_SHARED_WORDS)
        .orderBy("doc_a", "doc_b")
        .limit(max_pairs)
    )


def contradiction_candidates(docs: DataFrame, max_pairs: int) -> DataFrame:
    """The first ``max_pairs`` pairs (doc_a, doc_b, shared_words), in document order,
    that share at least three words of five or more characters.

    All qualifying pairs would be a quadratic table, so the caller says how many it
    wants, and left documents are taken in growing batches of ids until there are so
    many. Only ids are ordered, and words are stored once for all passes. The result
    is exact, because every pair of a later left document sorts after those of the
    batch. Documents without id take no part.
    """
    if max_pairs < 1:
        raise ValueError("max_pairs must be at least 1")
    words = cut_lineage(_significant_words(docs.where(F.col("doc_id").isNotNull())))
    ids = words.select("doc_id").distinct()
    found, after, size = None, None, FIRST_BATCH
    while True:
        rest = ids if after is None else ids.where(F.col("doc_id") > after)
        cut = rest.orderBy("doc_id").limit(size).agg(F.max("doc_id")).first()[0]
        if cut is None:
            return docs.sparkSession.createDataFrame([], PAIR_SCHEMA) if found is None else found
        more = _pairs_up_to(words, after, cut, max_pairs)
        found = cut_lineage(more if found is None else found.unionByName(more).orderBy("doc_a", "doc_b").limit(max_pairs))
        if found.count() >= max_pairs:
            return found
        after, size = cut, size * BATCH_GROWTH


def comparison_prompt(
    id_a: Column, text_a: Column, id_b: Column, text_b: Column, max_chars: int | None = None
) -> Column:
    """The prompt for one pair, with whole texts; ``max_chars`` cuts each to its opening."""

    def cut(c: Column) -> Column:
        whole = text_or_empty(c)
        return whole if max_chars is None else F.substring(whole, 1, max_chars)

    return F.concat(
        F.lit("Do these two documents contradict each other?\n\nDocument "),
        id_a.cast("string"), F.lit(":\n"), cut(text_a),
        F.lit("\n\nDocument "), id_b.cast("string"), F.lit(":\n"), cut(text_b),
        F.lit(
            '\n\nReply with JSON only: {"contradicts": true or false, '
            '"confidence": 0.0 to 1.0, "topic": "...", "explanation": "..."}'
        ),
    )


def contradiction_prompts(pairs: DataFrame, docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Candidate pairs with their prompt."""
    left = docs.select(F.col("doc_id").alias("doc_a"), F.col("content").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("doc_b"), F.col("content").alias("text_b"))
    prompt = comparison_prompt(
        F.col("doc_a"), F.col("text_a"), F.col("doc_b"), F.col("text_b"), max_chars
    )
    return pairs.join(left, "doc_a").join(right, "doc_b").select(
        "doc_a", "doc_b", prompt.alias("prompt")
    )


def contradictions(responses: DataFrame) -> DataFrame:
    """Confirmed contradictions from ``responses(doc_a, doc_b, response)``.

    Confirmed means contradicts is true with confidence above 0.7; a response
    without a readable JSON object is none.
    """
    verdict = F.from_json(
        "block",
        "contradicts BOOLEAN, confidence DOUBLE, topic STRING, explanation STRING",
    )
    read = responses.select(
        "doc_a", "doc_b", embedded_json(F.col("response")).alias("block")
    ).select("doc_a", "doc_b", verdict.alias("v"))
    return read.where(F.col("v.contradicts") & (F.col("v.confidence") > CONFIDENT)).select(
        "doc_a",
        "doc_b",
        F.col("v.confidence").alias("confidence"),
        F.coalesce("v.topic", F.lit("shared topic")).alias("topic"),
        F.coalesce("v.explanation", F.lit("The documents disagree.")).alias("explanation"),
        F.when(F.col("v.confidence") > VERY_CONFIDENT, "high").otherwise("medium").alias("severity"),
    )


def contradiction_issues(found: DataFrame) -> DataFrame:
    return found.select(
        F.lit("contradictions").alias("check"),
        F.lit("contradiction").alias("issue_type"),
        "severity",
        F.concat(F.lit("Documents disagree about "), F.col("topic")).alias("title"),
        F.col("explanation").alias("description"),
        F.array(F.col("doc_a").cast("string"), F.col("doc_b").cast("string")).alias("document_ids"),
        F.lit(1).cast("bigint").alias("n_issues"),
    )
