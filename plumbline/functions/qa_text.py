"""question/answer pairs from the free text of a model, as one column expression.

Readings are tried from strict to loose: a whole JSON object, a JSON array,
single JSON objects, quoted pairs, and last the question and answer fields
zipped. The first reading that yields pairs wins, except that a whole object
and a later reading add up. Questions are distinct within a response.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip, text_or_empty

# --- fixed values: patterns of the lenient reader ----------------------------
SINGLE_QUOTED_KEY = r"\{\s*'[^']*'\s*:"
TRAILING_COMMA = r",\s*([}\]])"
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
ARRAY_BLOCK = r"(?s)(\[.*\])"
OBJECT_BLOCK = r"\{[^{}]+\}"
PAIR = r'(?i)\{\s*"question"\s*:\s*"([^"]+)"\s*,\s*"answer"\s*:\s*"([^"]+)"\s*\}'
QUESTION_FIELD = r'(?i)"question"\s*:\s*"([^"]+)"'
ANSWER_FIELD = r'(?i)"answer"\s*:\s*"([^"]+)"'
# -----------------------------------------------------------------------------

_PAIRS = "array<struct<question:string,answer:string>>"


def _unfenced(response: Column) -> Column:
    """Drop a code fence: the first and the last line of a fenced text."""

    def inner(lines: Column) -> Column:
        return F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")

    return let(
        strip(text_or_empty(response)),
        lambda text: F.when(
            F.startswith(text, F.lit("```")), let(F.split(text, "\n"), inner)
        ).otherwise(text),
    )


def _double_quoted(response: Column) -> Column:
    return let(
        response,
        lambda text: F.when(
            text.rlike(SINGLE_QUOTED_KEY), F.replace(text, F.lit("'"), F.lit('"'))
        ).otherwise(text),
    )


def _repaired(json_text: Column) -> Column:
    no_commas = F.regexp_replace(json_text, TRAILING_COMMA, "$1")
    return F.regexp_replace(no_commas, CONTROL_CHARS, "")


def _pair(question: Column, answer: Column, trimmed: Column) -> Column:
    def clean(field: Column) -> Column:
        return let(
            F.coalesce(field, F.lit("")), lambda t: F.when(trimmed, strip(t)).otherwise(t)
        )

    return F.struct(clean(question).alias("question"), clean(answer).alias("answer"))


def _usable(pairs: Column, trimmed: Column) -> Column:
    """Standard cases need both fields; adversarial cases may lack the answer."""
    return F.filter(
        pairs, lambda p: (p["question"] != "") & ((p["answer"] != "") | ~trimmed)
    )


def _none() -> Column:
    return F.array().cast(_PAIRS)


def _from_object(value: Column, trimmed: Column) -> Column:
    """A pair from a parsed JSON value; values other than objects have no fields."""
    return _pair(
        F.try_variant_get(value, "$.question", "string"),
        F.try_variant_get(value, "$.answer", "string"),
        trimmed,
    )


def _whole_object(text: Column, trimmed: Column) -> Column:
    """The text as one JSON value: no pair, or one."""
    values = F.filter(F.array(F.try_parse_json(text)), lambda v: v.isNotNull())
    return F.transform(values, lambda v: _from_object(v, trimmed))


def _array_items(text: Column) -> Column:
    """The items of the JSON array in a text, null when there is none."""
    block = let(
        F.regexp_extract(text, ARRAY_BLOCK, 1), lambda b: F.when(b == "", text).otherwise(b)
    )
    return F.try_variant_get(F.try_parse_json(_repaired(block)), "$", "array<variant>")


def _single_objects(text: Column, trimmed: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(OBJECT_BLOCK), F.lit(0))
    values = F.transform(blocks, lambda b: F.try_parse_json(_repaired(b)))
    return F.transform(
        F.filter(values, lambda v: v.isNotNull()), lambda v: _from_object(v, trimmed)
    )


def _zipped(text: Column, question: str, answer: str, groups: tuple[int, int], trimmed: Column):
    """Questions and answers paired by position, as far as both go."""
    qs = F.regexp_extract_all(text, F.lit(question), F.lit(groups[0]))
    answers = F.regexp_extract_all(text, F.lit(answer), F.lit(groups[1]))
    both = F.filter(
        F.zip_with(qs, answers, lambda q, a: F.struct(q.alias("q"), a.alias("a"))),
        lambda p: p["q"].isNotNull() & p["a"].isNotNull(),
    )
    return F.transform(both, lambda p: _pair(p["q"], p["a"], trimmed))


def _distinct_questions(pairs: Column) -> Column:
    return let(
        F.transform(pairs, lambda p: p["question"]),
        lambda qs: F.filter(pairs, lambda p, i: F.array_position(qs, p["question"]) == i + 1),
    )


def _or_else(first: Column, second: Column) -> Column:
    """The first array unless it is empty."""
    return let(first, lambda found: F.when(F.size(found) > 0, found).otherwise(second))


def parse_qa(response: Column, trimmed: Column | bool = True) -> Column:
    """ARRAY<STRUCT<question, answer>> of a response; empty when nothing can be read.

    Where ``trimmed`` is false, the response is read as adversarial cases.
    """
    tidy = F.lit(trimmed) if isinstance(trimmed, bool) else trimmed

    def read(text: Column) -> Column:
        def listed(items: Column) -> Column:
            pairs = F.transform(items, lambda v: _from_object(v, tidy))
            return F.coalesce(_usable(pairs, tidy), _none())

        def strict(first: Column) -> Column:
            loose = F.concat(first, _usable(_single_objects(text, tidy), tidy))
            pairs = _usable(_zipped(text, PAIR, PAIR, (1, 2), tidy), tidy)
            fields = _usable(_zipped(text, QUESTION_FIELD, ANSWER_FIELD, (1, 1), tidy), tidy)
            by_text = _or_else(loose, _or_else(pairs, fields))
            # A readable list ends the search when it or the whole object gave a pair.
            return let(
                F.struct(_array_items(text).alias("v")),
                lambda items: F.when(
                    items["v"].isNotNull(),
                    _or_else(F.concat(first, listed(items["v"])), by_text),
                ).otherwise(by_text),
            )

        return let(
            let(_usable(_whole_object(text, tidy), tidy), strict), _distinct_questions
        )

    return let(_double_quoted(_unfenced(response)), read)
