"""A1, A2, R10, R12 and the user function surface (custom generator, embedder)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import let, strip, text_or_empty, texts_or_empty, token_count

ECHO_PREFIX = "[mock-answer] "
ECHO_CHARS = 200
FILLER_CONTEXTS = 3


def build_prompt(question: Column, contexts: Column) -> Column:
    """A1: numbered contexts, then the question."""

    def assemble(listed: Column) -> Column:
        numbered = F.transform(
            listed,
            lambda c, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] "), text_or_empty(c)
            ),
        )
        head = F.when(F.size(listed) == 0, F.lit("")).otherwise(
            F.concat(F.lit("Context:\n"), F.array_join(numbered, "\n\n"), F.lit("\n\n"))
        )
        return F.concat(
            head, F.lit("Question: "), text_or_empty(question), F.lit("\n\nAnswer:")
        )

    return let(texts_or_empty(contexts), assemble)


def echo_answer(ground_truth: Column, prompt: Column) -> Column:
    """A2: the known answer, else the opening of the prompt behind a marker."""
    echo = F.concat(F.lit(ECHO_PREFIX), F.substring(strip(prompt), 1, ECHO_CHARS))
    return F.coalesce(F.nullif(ground_truth, F.lit("")), echo)


def echo_generate(df: DataFrame) -> DataFrame:
    """A2: add answer, prompt_tokens, completion_tokens and total_tokens."""
    prompted = df.withColumn("prompt", build_prompt(F.col("question"), F.col("contexts")))
    answered = prompted.withColumn("answer", echo_answer(F.col("ground_truth"), F.col("prompt")))
    counted = answered.withColumns(
        {
            "prompt_tokens": token_count(F.col("prompt")),
            "completion_tokens": token_count(F.col("answer")),
        }
    )
    return counted.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be an integer of at least 1")


def echo_retrieve(query: Column, ground_truth_contexts: Column, k: int = 5) -> Column:
    """An array of (rank, doc_id, content, score) from the known contexts, or filler."""
    _check_k(k)
    known = F.transform(
        F.slice(texts_or_empty(ground_truth_contexts), 1, k),
        lambda c, i: F.struct(
            (i + 1).alias("rank"),
            F.concat(F.lit("gt-"), i.cast("string")).alias("doc_id"),
            c.alias("content"),
            F.lit(1.0).alias("score"),
        ),
    )
    filler = F.transform(
        F.sequence(F.lit(0), F.lit(min(k, FILLER_CONTEXTS) - 1)),
        lambda i: F.struct(
            (i + 1).alias("rank"),
            F.concat(F.lit("mock-"), i.cast("string")).alias("doc_id"),
            F.concat(
                F.lit("Mock context "), (i + 1).cast("string"), F.lit(" for query: "), query
            ).alias("content"),
            (1.0 - i * 0.25).alias("score"),
        ),
    )
    return F.when(F.size(known) > 0, known).otherwise(filler)


def resolve_contexts(retrieved: Column, context: Column, logged: Column | None = None) -> Column:
    """Retrieved contexts when retrieval worked (not null), else ``[context]``, else none.

    ``logged`` contexts, when given, come before the fall-back.
    """
    fallback = F.when(text_or_empty(context) != "", F.array(context)).otherwise(
        F.array().cast("array<string>")
    )
    return F.coalesce(retrieved, fallback) if logged is None else F.coalesce(
        retrieved, logged, fallback
    )


def _one_by_one(call: Callable[[list], list], inputs: list) -> tuple[list, list[str | None]]:
    """Results and errors of a batch call, of single calls where the batch fails."""
    try:
        found = list(call(inputs))
        if len(found) == len(inputs):
            return found, [None] * len(inputs)
        problem = f"{len(found)} results for {len(inputs)} inputs"
    except Exception as raised:  # the caller's code may raise anything
        problem = str(raised)
    if len(inputs) == 1:
        return [None], [problem]
    single = [_one_by_one(call, [x]) for x in inputs]
    return [r[0] for r, _ in single], [e[0] for _, e in single]


def generate_answers(
    df: DataFrame,
    make_generator: Callable[[], Callable[[list[str]], list[str]]],
    prompt_col: str = "prompt",
) -> DataFrame:
    """Answer every prompt with a user function, one call per Arrow batch.

    ``make_generator`` runs once per partition and returns ``texts -> answers``.
    Where a batch raises, or returns another number of answers, its prompts are tried
    one by one: only a prompt that fails by itself gets a null answer, with the
    message in ``generation_error``.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("answer", T.StringType()),
            T.StructField("generation_error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_generator()
        for batch in batches:
            answers, errors = _one_by_one(generate, batch[prompt_col].tolist())
            yield batch.assign(answer=answers, generation_error=errors)

    return df.mapInPandas(run, schema)


def embed_column(
    df: DataFrame,
    make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
    text_col: str,
    out_col: str = "embedding",
) -> DataFrame:
    """Embed a text column with a user function, initialised once per partition.

    A text for which the function raises has a null vector; the others keep theirs.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for batch in batches:
            found, _ = _one_by_one(embedder, batch.fillna("").tolist())
            yield pd.Series([None if v is None else list(map(float, v)) for v in found])

    return df.withColumn(out_col, embed(F.col(text_col)))
