"""Dates from document metadata and text. Needs session time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip, text_or_empty

# --- fixed values: keys, patterns and formats, in the order they are tried ---
DATE_KEYS = [
    "updated_at", "modified_date", "last_modified", "date", "timestamp",
    "created_at", "publish_date", "modified", "updated", "date_modified",
    "date_updated",
]
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?U)\w*\s+\d{1,2},?\s+\d{4}",
]
NUMERIC_FORMATS = ["yyyy-M-d'T'H:m:s[.SSSSSS][XXX]", "yyyy-M-d", "M/d/yyyy"]
MONTH_NAME_FORMATS = ["MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy"]
# -----------------------------------------------------------------------------


#: Seconds of the years 1 to 9999.
EPOCH_RANGE = (-62_135_596_800, 253_402_300_799)


def parse_date(c: Column) -> Column:
    """A timestamp from a date string in one of the known formats, else null."""

    def attempt(s: Column) -> Column:
        with_colon = F.regexp_replace(s, r"(T.*[+-]\d{2})(\d{2})\z", "$1:$2")
        tries = [F.try_to_timestamp(with_colon, F.lit(f)) for f in NUMERIC_FORMATS]
        month = F.initcap(F.lower(F.regexp_replace(s, r"\s+", " ")))
        tries += [F.try_to_timestamp(month, F.lit(f)) for f in MONTH_NAME_FORMATS]
        return F.coalesce(*tries)

    return let(strip(c), attempt)


def date_from_metadata(metadata: Column | None, numbers: Column | None = None) -> Column:
    """First usable date among the known keys, of texts in ``metadata`` (MAP<STRING,STRING>)
    and of numbers in ``numbers`` (MAP<STRING,DOUBLE>).

    A number is seconds since the epoch and is passed over outside the years 1 to
    9999. A text of digits is no date.
    """
    candidates = []
    for key in DATE_KEYS:
        if metadata is not None:
            candidates.append(parse_date(F.element_at(metadata, F.lit(key))))
        if numbers is not None:
            seconds = F.element_at(numbers, F.lit(key))
            micros = (F.when(seconds.between(*EPOCH_RANGE), seconds) * 1_000_000).cast("bigint")
            candidates.append(F.timestamp_micros(micros))
    return F.coalesce(*candidates)


def date_from_text(content: Column, header_chars: int | None = None) -> Column:
    """First parseable date of a text, patterns tried in order.

    ``header_chars`` restricts the search to the opening of the text, where document
    headers stand; the default is the whole text.
    """

    def search(head: Column) -> Column:
        found = []
        for pattern in DATE_PATTERNS:
            hits = F.regexp_extract_all(head, F.lit(pattern), F.lit(0))
            parsed = F.filter(F.transform(hits, parse_date), lambda t: t.isNotNull())
            found.append(F.get(parsed, F.lit(0)))
        return F.coalesce(*found)

    whole = text_or_empty(content)
    return let(whole if header_chars is None else F.substring(whole, 1, header_chars), search)


def document_date(
    content: Column,
    metadata: Column | None = None,
    numbers: Column | None = None,
    header_chars: int | None = None,
) -> Column:
    """The date of a document: metadata first, then its text."""
    by_text = date_from_text(content, header_chars)
    if metadata is None and numbers is None:
        return by_text
    return F.coalesce(date_from_metadata(metadata, numbers), by_text)
