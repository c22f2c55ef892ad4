"""Chunks, quotas, prompts and parsed cases for synthetic test sets.

Model calls stay outside: prompts leave as a table, responses come back as a table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.qa_text import parse_qa
from plumbline.functions.text import chunks, text_or_empty
from plumbline.operators.selection import place_of
from plumbline.session import cut_lineage

# --- fixed values: test types and defaults -----------------------------------
STANDARD = "standard"
ADVERSARIAL_TYPES = ["unanswerable", "ambiguous", "misleading", "multi_hop", "counterfactual"]
CHUNK_SIZE, CHUNK_OVERLAP = 2000, 200
# -----------------------------------------------------------------------------

_TASKS = {
    "unanswerable": "questions that sound related but cannot be answered from the text",
    "ambiguous": "questions that can be read in more than one way",
    "misleading": "questions that rest on a wrong premise",
    "multi_hop": "questions that need two or more facts of the text together",
    "counterfactual": "questions about what would follow if a fact of the text were different",
}
_FORMAT = 'Reply with a JSON array of objects with the fields "question" and "answer".'


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """(doc_id, chunk_idx, chunk) from ``docs(doc_id, content)``."""
    return docs.select(
        "doc_id", F.posexplode(chunks(F.col("content"), size, overlap)).alias("chunk_idx", "chunk")
    )


def chunk_quotas(chunked: DataFrame, count: int) -> DataFrame:
    """Y2: add ``n_questions``: an equal share per chunk, at least 1, the remainder one
    each to the first chunks in document order.

    The last chunk with a larger share is found by counting keys; the texts stay where
    they are.
    """
    order = ["doc_id", "chunk_idx"]
    keys = cut_lineage(chunked.select(*order))
    n = keys.count()
    share = max(1, count // n) if n else 1
    rest = count - share * n
    if rest <= 0:
        return chunked.withColumn("n_questions", F.lit(share).cast("bigint"))
    last = place_of(keys, order, rest - 1)
    favoured = last.below(order) | last.same(order)
    return chunked.withColumn("n_questions", F.lit(share).cast("bigint") + favoured.cast("bigint"))


def _escaped(c: Column) -> Column:
    """Braces doubled, so that the prompt can be used as a format string."""
    text = text_or_empty(c)
    return F.replace(
        F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")
    )


def standard_prompt(chunk: Column, count: Column) -> Column:
    """The prompt for plain question/answer pairs."""
    return F.concat(
        F.lit("Write "), count.cast("string"),
        F.lit(" question(s) that the text below answers, each with its answer.\n"),
        F.lit(_FORMAT + "\n\nText:\n"), _escaped(chunk),
    )


def adversarial_prompt(test_type: Column, chunk: Column, count: Column) -> Column:
    """The prompt for one of the adversarial types."""
    task = None
    for name, text in _TASKS.items():
        condition = test_type == name
        task = F.when(condition, text) if task is None else task.when(condition, text)
    return F.concat(
        F.lit("Write "), count.cast("string"), F.lit(" "), task,
        F.lit(", each with the answer a careful system should give.\n"),
        F.lit(_FORMAT + "\n\nText:\n"), _escaped(chunk),
    )


def standard_prompts(quotas: DataFrame) -> DataFrame:
    return quotas.withColumn("test_type", F.lit(STANDARD)).withColumn(
        "prompt", standard_prompt(F.col("chunk"), F.col("n_questions"))
    )


def adversarial_prompts(
    chunked: DataFrame, per_chunk: int = 1, types: Iterable[str] = tuple(ADVERSARIAL_TYPES)
) -> DataFrame:
    """Every chunk under every type; the types are an array in the plan."""
    names = list(types)
    unknown = [t for t in names if t not in _TASKS]
    if unknown:
        raise ValueError(f"unknown adversarial types {unknown}")
    typed = chunked.withColumn("test_type", F.explode(F.array(*[F.lit(t) for t in names])))
    return typed.withColumn(
        "prompt", adversarial_prompt(F.col("test_type"), F.col("chunk"), F.lit(per_chunk))
    )


def test_cases(
    responses: DataFrame, types: Iterable[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) from ``responses(doc_id, chunk_idx, chunk, test_type, response)``.

    ``cases`` has question, ground_truth, context, test_type, source_document and
    chunk_index. Responses that cannot be read, or are null because the call
    failed, are in ``errors``. ``types`` keeps standard cases plus those named.
    """
    standard = F.col("test_type") == STANDARD
    parsed = responses.withColumn("_pairs", parse_qa(F.col("response"), standard))
    errors = parsed.where(F.size("_pairs") == 0).select(
        "doc_id",
        "chunk_idx",
        "test_type",
        F.lit("no question/answer pair found").alias("error"),
        F.substring("response", 1, 200).alias("preview"),
    )
    kept = parsed
    if types is not None:
        kept = parsed.where(standard | F.col("test_type").isin(*types))
    cases = kept.select(
        F.col("doc_id").alias("source_document"),
        F.col("chunk_idx").alias("chunk_index"),
        F.col("chunk").alias("context"),
        "test_type",
        # Outer, so that no filter on the size parses each response again.
        F.posexplode_outer("_pairs").alias("case_no", "_p"),
    ).where(F.col("case_no").isNotNull()).select(
        F.col("_p.question").alias("question"),
        F.col("_p.answer").alias("ground_truth"),
        "context",
        "test_type",
        "source_document",
        "chunk_index",
        "case_no",
    )
    return cases, errors


def type_counts(cases: DataFrame) -> DataFrame:
    """Cases per type."""
    return cases.groupBy("test_type").agg(F.count(F.lit(1)).alias("n"))
