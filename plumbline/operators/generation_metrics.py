"""Answer quality from word statistics or supplied vectors.

Inputs are prepared token arrays (see ``evaluate``), so each text is tokenised
once however many metrics use it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import jaccard, let, strip, text_or_empty, texts_or_empty, token_count
from plumbline.functions.vectors import clamp01, cosine


def _missing(c: Column) -> Column:
    return text_or_empty(c) == ""


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) == 0, F.lit(0.0)).otherwise(F.size(part) / F.size(whole))


def exact_match(answer: Column, truth: Column) -> Column:
    same = F.lower(strip(text_or_empty(answer))) == F.lower(strip(text_or_empty(truth)))
    return F.when(_missing(truth), F.lit(0.0)).otherwise(same.cast("double"))


def f1_score(
    answer: Column, truth: Column, n_answer: Column, n_truth: Column, shared: Column
) -> Column:
    """Multiset word F1 from word counts and the multiset overlap."""
    total = n_answer + n_truth
    return (
        F.when(_missing(answer) & _missing(truth), F.lit(1.0))
        .when(_missing(truth), F.lit(0.0))
        .when(total == 0, F.lit(1.0))
        .otherwise(2.0 * shared / total)
    )


def bleu(
    answer: Column, truth: Column, n_answer: Column, n_truth: Column, shared: Column
) -> Column:
    """Clipped unigram precision times a brevity factor."""
    blank = _missing(answer) | _missing(truth) | (n_answer == 0) | (n_truth == 0)
    return F.when(blank, F.lit(0.0)).otherwise(
        shared / n_answer * F.least(F.lit(1.0), n_answer / n_truth)
    )


def rouge(answer_set: Column, truth_set: Column) -> Column:
    """Share of distinct reference words found in the answer."""
    return _share(F.array_intersect(truth_set, answer_set), truth_set)


def word_similarity(answer_set: Column, truth_set: Column) -> Column:
    """The model-free form of semantic_similarity and of bertscore."""
    return jaccard(answer_set, truth_set)


def vector_similarity(answer_vec: Column, truth_vec: Column) -> Column:
    """semantic_similarity from embeddings: cosine moved from [-1, 1] to [0, 1]."""
    return clamp01((cosine(answer_vec, truth_vec) + 1.0) / 2.0)


def vector_bertscore(answer_vec: Column, truth_vec: Column) -> Column:
    """bertscore from sentence embeddings: the raw cosine."""
    return cosine(answer_vec, truth_vec)


def given_bertscore(f1: Column) -> Column:
    """bertscore from an F1 computed elsewhere, clamped to [0, 1]."""
    return clamp01(f1)


def faithfulness(answer_set: Column, context_set: Column) -> Column:
    """Share of distinct answer words that occur in the contexts."""
    return _share(F.array_intersect(answer_set, context_set), answer_set)


def answer_relevancy(
    question: Column, answer: Column, question_words: Column, answer_words: Column
) -> Column:
    """Share of meaningful question words that occur in the answer."""
    return (
        F.when(_missing(question) | _missing(answer), F.lit(0.0))
        .when(F.size(question_words) == 0, F.lit(1.0))
        .otherwise(_share(F.array_intersect(question_words, answer_words), question_words))
    )


def nli_relevancy(question: Column, answer: Column, entailment: Column) -> Column:
    """answer_relevancy from the entailment score of the question by the answer."""
    return F.when(_missing(question) | _missing(answer), F.lit(0.0)).otherwise(clamp01(entailment))


def hallucination(
    answer: Column, contexts: Column, answer_set: Column, context_set: Column
) -> Column:
    """Share of distinct answer words missing from the contexts; higher is worse."""
    return (
        F.when(_missing(answer), F.lit(0.0))
        .when(F.size(texts_or_empty(contexts)) == 0, F.lit(1.0))
        .otherwise(_share(F.array_except(answer_set, context_set), answer_set))
    )


def word_count(answer: Column) -> Column:
    """Length score: a hundred words or more give 1."""
    return let(token_count(answer), lambda n: F.least(n / 100.0, F.lit(1.0)))
