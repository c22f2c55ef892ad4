"""Evaluation datasets from JSON, JSON lines, CSV and arbitrary tables.

Readers return a DataFrame with the item columns ``question``, ``ground_truth``,
``context``, ``contexts``, ``ground_truth_contexts`` and ``metadata`` (JSON text).
``validate_items`` splits good rows from bad ones; ``strict`` loads fail as a
whole when any row is bad.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import strip, text_or_empty
from plumbline.operators.selection import first_rows
from plumbline.sources.lines import numbered_lines
from plumbline.sources.ranges import csv_records, json_elements

# --- fixed values: field names tried in order, page question, shuffle seed ---
QUESTION_FIELDS = ["question", "query", "input", "prompt"]
GROUND_TRUTH_FIELDS = ["answer", "answers", "ground_truth", "target", "output", "response"]
CONTEXT_FIELDS = ["context", "passage", "document", "paragraph", "text"]
RESERVED_FIELDS = ["question", "ground_truth", "context"]
SHUFFLE_SEED = 42
# -----------------------------------------------------------------------------

PAGE_QUESTION = "What does this page say?"

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("ground_truth_contexts", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
    ]
)


class DatasetError(ValueError):
    """A strict load met bad rows; ``rejected`` holds them."""

    def __init__(self, message: str, rejected: DataFrame):
        super().__init__(message)
        self.rejected = rejected


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that hold an array of items, or an object with the list ``items``.

    Files are read by ranges, so they may be of any size. An object that is one item, or
    whose ``items`` are short, is read whole. Anything but an object in an array, and
    broken JSON, fails the load.
    """
    elements, others = json_elements(spark, path)
    item = F.from_json("value", ITEM_SCHEMA, {"mode": "FAILFAST"})
    items = elements.select(item.alias("item")).select("item.*")
    if not others:
        return items
    whole = T.StructType([*ITEM_SCHEMA.fields, T.StructField("items", T.ArrayType(ITEM_SCHEMA))])
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(others)
    single = F.array(F.struct(*[F.col(f.name) for f in ITEM_SCHEMA.fields]))
    return items.unionByName(rows.select(F.inline(F.coalesce("items", single))))


def write_json(df: DataFrame, path: str) -> None:
    """Each partition as one file that holds a JSON array of its rows, written as they come."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            rows = batch["value"].to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [lead + ",\n".join(rows)]})
                lead = ",\n"
        yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[" else "]"]})

    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    rows.mapInArrow(listed, "value string").write.option("lineSep", "\n").text(path)


def _line_values() -> Column:
    parsed = F.from_json("value", ITEM_SCHEMA)
    return F.when(F.startswith(F.ltrim("value"), F.lit("{")), parsed)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON object per line; blank lines are skipped.

    Returns (items, rejected). ``rejected`` has file, line (number, from 1), error
    and value, for lines that are no JSON and for JSON that is no object. Files are
    read by splits, so they may be of any size.
    """
    return _split_lines(numbered_lines(spark, path).where(F.trim("value") != ""))


def _split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = F.try_parse_json("value").isNotNull()
    error = F.when(~valid, "malformed JSON").when(
        ~F.startswith(F.ltrim("value"), F.lit("{")), "not an object"
    )
    checked = lines.withColumn("error", error)
    good = checked.where(F.col("error").isNull()).select(_line_values().alias("item")).select("item.*")
    bad = checked.where(F.col("error").isNotNull()).select("file", "line", "error", "value")
    return good, bad


def require_clean(rejected: DataFrame) -> None:
    """Fail a strict load: names up to ten of the bad rows."""
    sample = rejected.limit(10).collect()
    if sample:
        shown = "; ".join(str(r.asDict()) for r in sample)
        raise DatasetError(f"dataset has bad rows: {shown}", rejected)


def csv_metadata(c: Column) -> Column:
    """Metadata text of a CSV: kept when it is a JSON object, else wrapped as ``raw``."""
    is_object = F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    wrapped = F.to_json(F.struct(c.alias("raw")))
    return F.when(text_or_empty(c) != "", F.when(is_object, c).otherwise(wrapped))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: a header with question and optionally ground_truth, context and metadata.

    Files are read by ranges, so they may be of any size; fields go by their place, named
    by the header of the first file.
    """
    options = {"header": True, "multiLine": True, "escape": '"'}
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    parsed = F.from_csv("value", schema, {"escape": '"'})
    raw = csv_records(spark, path).select(parsed.alias("r")).select("r.*")
    have = set(raw.columns)

    def field(name: str) -> Column:
        value = F.col(name) if name in have else F.lit(None).cast("string")
        return value if name == "metadata" else F.nullif(strip(value), F.lit(""))

    empty = F.array().cast("array<string>")
    question = strip(text_or_empty(F.col("question"))) if "question" in have else F.lit(None)
    return raw.select(
        question.cast("string").alias("question"),
        field("ground_truth").alias("ground_truth"),
        field("context").alias("context"),
        empty.alias("contexts"),
        empty.alias("ground_truth_contexts"),
        csv_metadata(field("metadata")).alias("metadata"),
    )


def _as_text(df: DataFrame, name: str, first_of_list: bool) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.ArrayType) and first_of_list:
        first = F.get(c, F.lit(0))
        if isinstance(kind.elementType, T.StructType):
            known = {f.name for f in kind.elementType.fields}
            return first.getField("text").cast("string") if "text" in known else F.lit(None).cast("string")
        return first.cast("string")
    return c.cast("string")


def _filled(df: DataFrame, name: str) -> Column:
    """Whether a field counts as present: not null and not empty."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    return text_or_empty(F.col(name)) != ""


def _first_filled(df: DataFrame, names: list[str], first_of_list: bool = False) -> Column:
    chosen = None
    for name in names:
        if name not in df.columns:
            continue
        value = _as_text(df, name, first_of_list)
        present = _filled(df, name)
        chosen = F.when(present, value) if chosen is None else chosen.when(present, value)
    return F.lit(None).cast("string") if chosen is None else chosen


def map_fields(df: DataFrame) -> DataFrame:
    """Foreign field names to the item schema, per row the first filled field.

    Every source field but question, ground_truth and context is kept in the
    metadata JSON.
    """
    rest = [c for c in df.columns if c not in RESERVED_FIELDS]
    metadata = F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")
    return df.select(
        _first_filled(df, QUESTION_FIELDS).alias("question"),
        _first_filled(df, GROUND_TRUTH_FIELDS, first_of_list=True).alias("ground_truth"),
        _first_filled(df, CONTEXT_FIELDS).alias("context"),
        metadata.alias("metadata"),
    )


def page_items(pages: DataFrame, question: str = PAGE_QUESTION) -> DataFrame:
    """One item per non-blank page of ``pages(source, page, text)``."""
    return pages.where(F.col("text").rlike(r"(?U)\S")).select(
        F.lit(question).alias("question"),
        F.lit(None).cast("string").alias("ground_truth"),
        strip(F.col("text")).alias("context"),
        F.to_json(F.struct("source", "page", F.lit("pdf").alias("format"))).alias("metadata"),
    )


def validate_items(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejected). Questions are stripped; blank ground_truth and context
    become null. ``rejected`` keeps the rows with an ``errors`` array."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("question").isNull(), "question is missing"),
            F.when(strip(F.col("question")) == "", "question is blank"),
        )
    )

    def not_blank(name: str) -> Column:
        return F.when(strip(F.col(name)) != "", F.col(name))

    blank = strip(text_or_empty(F.col("question"))) == ""
    cleaned = {"question": strip(F.col("question"))}
    cleaned.update({n: not_blank(n) for n in ("ground_truth", "context") if n in df.columns})
    good = df.where(~blank).withColumns(cleaned)
    rejected = df.where(blank).withColumn("errors", problems)
    if strict:
        require_clean(rejected)
    return good, rejected


def has_ground_truth(df: DataFrame) -> DataFrame:
    """One row: whether the dataset is non-empty and every item has a reference answer."""
    return df.agg(
        ((F.count(F.lit(1)) > 0) & (F.count_if(F.col("ground_truth").isNull()) == 0)).alias(
            "has_ground_truth"
        )
    )


def sample_items(df: DataFrame, limit: int, key: str = "item_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """A repeatable shuffle, then the first ``limit`` items.

    The order is a hash of seed and key, the same on any partitioning. The key of the
    last item is found by counting, so no task holds the sample, however large it is.
    """
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    taken = first_rows(df.withColumn("_ticket", ticket), ["_ticket", key], limit)
    return taken.orderBy("_ticket", key).drop("_ticket")
