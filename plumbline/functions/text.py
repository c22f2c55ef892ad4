"""Text primitives as Spark column expressions.

Everything here is row-local and stays in the JVM, apart from ``char_overlap``,
which needs a linear-time prefix function and runs as an Arrow pandas UDF.
Null text counts as empty text throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: they must equal the evaluated tool's for equal results ----
QUESTION_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can",
    "what", "how", "why", "when", "where", "who", "which",
]
KEYWORD_STOP_WORDS = [
    "what", "how", "why", "when", "where", "which", "who",
    "does", "have", "been", "from", "with", "that", "this",
    "will", "about", "into", "your", "some", "than",
]
SENTENCE_BREAK = r"(?<=[.!?])(?U)\s+"
CLAUSE_BREAK = r"(?iU),\s*(?:and|but|also|moreover|furthermore|however)\s+"
SEMICOLON_BREAK = r"(?U);\s*"
CLAIM_EDGE_PUNCTUATION = r"^[.,;:!?]+|[.,;:!?]+\z"
TOPIC_SEPARATORS = [". ", "! ", "? ", "\n"]
JUDGE_YES = "yes|true|fully|completely|excellent"
JUDGE_NO = "no|false|not at all|poor"
# -----------------------------------------------------------------------------

WHITESPACE = r"(?U)\s+"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A column captured by a lambda is recomputed for every element; binding it
    as a lambda variable is what keeps nested array expressions linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def texts_or_empty(c: Column) -> Column:
    return F.coalesce(c, empty_strings())


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_context(c: Column) -> Column:
    """Lower case, runs of whitespace to one blank, no outer whitespace."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), WHITESPACE, " "))


def split_words(c: Column) -> Column:
    """Case-preserving whitespace tokens, in order, with repeats."""
    return F.array_remove(F.split(text_or_empty(c), WHITESPACE), "")


def words(c: Column) -> Column:
    """Lower-case whitespace tokens with repeats (a multiset)."""
    return split_words(F.lower(text_or_empty(c)))


def word_set(c: Column) -> Column:
    """Distinct lower-case whitespace tokens."""
    return F.array_distinct(words(c))


def token_count(c: Column) -> Column:
    """Number of whitespace tokens."""
    return F.size(split_words(c)).cast("bigint")


def _without(tokens: Column, stop_words: list[str]) -> Column:
    return F.array_except(tokens, F.array(*[F.lit(w) for w in stop_words]))


def question_words(c: Column) -> Column:
    """T4: distinct lower-case word tokens minus the question stop words."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return _without(found, QUESTION_STOP_WORDS)


def keywords(c: Column) -> Column:
    """T5: distinct word tokens of four or more characters, lower case, minus stop words."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))
    return _without(F.transform(found, F.lower), KEYWORD_STOP_WORDS)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-word arrays, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


def occurrence_labels(tokens: Column) -> Column:
    """Tokens tagged with their running occurrence number, so that a set
    intersection of two labelled arrays is a multiset intersection.

    Sorting brings equal words together; run boundaries are found by looking at
    neighbours only. Cost is n log n per row and nothing is shuffled.
    """

    def label(s: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda p: F.flatten(
                F.transform(
                    p,
                    lambda start, run: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(p, run + 1), F.size(s)) - start),
                        lambda n: F.concat(F.get(s, start), F.lit("\u0001"), n.cast("string")),
                    ),
                )
            ),
        )

    return let(
        F.array_sort(tokens),
        lambda s: F.when(F.size(s) == 0, empty_strings()).otherwise(label(s)),
    )


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by whitespace; blanks dropped."""
    parts = F.split(strip(text_or_empty(c)), SENTENCE_BREAK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _clauses(sentence: Column) -> Column:
    return let(
        F.split(sentence, CLAUSE_BREAK),
        lambda parts: F.when(F.size(parts) > 1, parts).otherwise(
            F.split(sentence, SEMICOLON_BREAK)
        ),
    )


def _clean_claim(part: Column) -> Column:
    bare = F.regexp_replace(strip(part), CLAIM_EDGE_PUNCTUATION, "")
    return F.regexp_replace(bare, WHITESPACE, " ")


def claims(c: Column) -> Column:
    """Atomic claims of an answer, in order."""
    parts = F.flatten(F.transform(sentences(c), _clauses))
    return F.filter(F.transform(parts, _clean_claim), lambda s: s != "")


def best_context(claim: Column, contexts: Column) -> Column:
    """The first context with the most words in common with the claim."""

    def pick(claim_words: Column) -> Column:
        scored = F.transform(
            texts_or_empty(contexts),
            lambda ctx, i: F.struct(
                F.size(F.array_intersect(claim_words, word_set(ctx))).alias("shared"),
                (-i).alias("order"),
                ctx.alias("ctx"),
            ),
        )
        return F.coalesce(F.array_max(scored)["ctx"], F.lit(""))

    return let(word_set(claim), pick)


PROBE_CHARS, PROBE_TRIES = 16, 32
_HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def _longest_border(a: str, b: str) -> int:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``.

    Finds where the opening of ``b`` stands in ``a``; texts that repeat it too
    often are compared by hashes of all lengths, so no input is quadratic.
    """
    if len(b) >= PROBE_CHARS:
        probe, at = b[:PROBE_CHARS], -1
        for _ in range(PROBE_TRIES):
            at = a.find(probe, at + 1)
            if at < 0:
                break
            if a[at:] == b[: len(a) - at]:
                return len(a) - at
        else:
            return _border_by_hashes(a, b)
    short = min(PROBE_CHARS - 1, len(b))
    return next((n for n in range(short, 0, -1) if a.endswith(b[:n])), 0)


def _border_by_hashes(a: str, b: str) -> int:
    """The same for all lengths at once: rolling hashes of suffixes and prefixes are compared
    as arrays, and the longest length whose hashes agree is verified on the texts."""
    n = min(len(a), len(b))
    ends = np.frombuffer(a[len(a) - n :].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.frombuffer(b[:n].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    powers = np.full(n, _HASH_BASE)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    spread = np.uint64(0xBF58476D1CE4E5B9)
    prefix = np.cumsum((starts * spread ^ starts) * powers, dtype=np.uint64)
    whole = np.cumsum((ends * spread ^ ends) * powers, dtype=np.uint64)
    # A suffix that begins at place n - L has the weights of that place on.
    suffix = whole[-1] - np.concatenate([[np.uint64(0)], whole[:-1]])[::-1]
    agree = np.flatnonzero(suffix == prefix * powers[::-1])
    return next((int(at) + 1 for at in agree[::-1] if a.endswith(b[: at + 1])), 0)


def _overlaps(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a.fillna(""), b.fillna("")):
        if not x or not y:
            out.append(0)
            continue
        n = min(len(x), len(y))
        out.append(max(_longest_border(x[-n:], y[:n]), _longest_border(y[-n:], x[:n])))
    return pd.Series(out, dtype="int32")


def char_overlap(a: Column, b: Column) -> Column:
    """Longest text that ends one side and begins the other, either way round.

    Marked non-deterministic so that a filter on the result is not turned into a
    second call of the function.
    """
    return F.pandas_udf(_overlaps, T.IntegerType()).asNondeterministic()(a, b)


def chunks(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Fixed windows of ``size`` characters, stripped, blanks dropped."""
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("chunking needs size >= 1 and 0 <= overlap < size")

    def windows(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
        cut = F.transform(starts, lambda s: strip(F.substr(text, s + 1, F.lit(size))))
        return F.when(F.length(text) == 0, empty_strings()).otherwise(
            F.filter(cut, lambda x: x != "")
        )

    return let(text_or_empty(c), windows)


def topic_label(c: Column) -> Column:
    """A short label from the opening of a text."""
    head = strip(F.substring(text_or_empty(c), 1, 100))

    def label(t: Column) -> Column:
        cut = None
        for sep in TOPIC_SEPARATORS:
            at = F.instr(t, sep)
            value = F.substr(t, F.lit(1), at - 1)
            cut = F.when(at > 11, value) if cut is None else cut.when(at > 11, value)
        return cut.otherwise(t)

    def shorten(t: Column) -> Column:
        return (
            F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("...")))
            .when(t == "", F.lit("Untitled topic"))
            .otherwise(t)
        )

    return let(let(head, label), shorten)


def judge_score(response: Column) -> Column:
    """A score in [0, 1] from free judge text."""
    def scale(n: Column) -> Column:
        return (
            F.when(n <= 1.0, n)
            .when(n <= 10.0, n / 10.0)
            .otherwise(F.least(n / 100.0, F.lit(1.0)))
        )

    def by_keyword(lowered: Column) -> Column:
        return (
            F.when(lowered.rlike(JUDGE_YES), F.lit(1.0))
            .when(lowered.rlike(JUDGE_NO), F.lit(0.0))
            .otherwise(F.lit(0.5))
        )

    def read(text: Column) -> Column:
        return let(
            F.regexp_extract(text, r"(\d+\.?\d*)", 1),
            lambda n: F.when(n == "", let(F.lower(text), by_keyword)).otherwise(
                let(n.cast("double"), scale)
            ),
        )

    return let(text_or_empty(response), read)


def embedded_json(response: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` when it is valid JSON, else null."""
    block = F.regexp_extract(text_or_empty(response), r"(?s)(\{.*\})", 1)
    return let(block, lambda b: F.when(F.try_parse_json(b).isNotNull(), b))


def json_path(payload: Column, path: str | None) -> Column:
    """A dotted path such as ``a.b.0.c`` into a JSON text, as text; missing gives null."""
    if not path:
        return payload
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(payload, "$" + steps)
