"""Prompts for a judging model, and scores from its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import judge_score, text_or_empty

PASSING_THRESHOLD = 0.7  # carried for the reader of the scores; nothing is cut at it

# name -> (task, name of the first text, range of the score)
JUDGE_CRITERIA = {
    "faithfulness": (
        "Judge how far the context backs the answer.",
        "Context",
        "0.0 means nothing is backed, 1.0 means everything is backed",
    ),
    "relevancy": (
        "Judge how well the answer responds to the question.",
        "Question",
        "0.0 means it misses the question, 1.0 means it settles it",
    ),
    "comprehensiveness": (
        "Judge how completely the answer treats the topic.",
        "Topic",
        "0.0 means hardly at all, 1.0 means every important side is covered",
    ),
}


def judge_prompt(criteria: Column | str, premise: Column, hypothesis: Column) -> Column:
    """The prompt for one of the criteria; null when either text is missing."""
    name = F.lit(criteria) if isinstance(criteria, str) else criteria
    prompt = None
    for key, (task, label, scale) in JUDGE_CRITERIA.items():
        body = F.concat(
            F.lit(f"{task}\nScale: {scale}.\n\n{label}: "),
            premise,
            F.lit("\n\nAnswer: "),
            hypothesis,
            F.lit("\n\nScore:"),
        )
        prompt = F.when(name == key, body) if prompt is None else prompt.when(name == key, body)
    missing = (text_or_empty(premise) == "") | (text_or_empty(hypothesis) == "")
    return F.when(~missing, prompt)


def judge_scores(
    df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis",
    response: str = "response",
) -> DataFrame:
    """Add ``judge_score``: 0 for a missing text or a failed call (null response)."""
    missing = (
        (text_or_empty(F.col(premise)) == "")
        | (text_or_empty(F.col(hypothesis)) == "")
        | F.col(response).isNull()
    )
    return df.withColumn(
        "judge_score", F.when(missing, F.lit(0.0)).otherwise(judge_score(F.col(response)))
    )
