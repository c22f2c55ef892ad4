"""Text corpora from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.lines import numbered_lines

# --- fixed values: file types of a corpus ------------------------------------
WHOLE_FILE_TYPES = ["txt", "md", "rst", "html", "json"]
LINE_FILE_TYPE = "jsonl"
LINE_FILES = "*.[jJ][sS][oO][nN][lL]"
COMPRESSED = "{,.[gG][zZ],.bz2,.deflate,.lz4,.snappy,.zst}"
DOCUMENT_LINES = f"*.{{[jJ][sS][oO][nN][lL],[nN][dD][jJ][sS][oO][nN]}}{COMPRESSED}"
DOCUMENT_FILES = f"*.[jJ][sS][oO][nN]{COMPRESSED}"
# -----------------------------------------------------------------------------

REPLACEMENT = "\ufffd"  # what Spark puts in the place of undecodable bytes


class CorpusError(ValueError):
    """A strict read met a file that is not readable text."""


def _files(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """Whole files under a path as (doc_id, content, size). Files are split over tasks by
    their sizes; each file is one row, as each is one document."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    wanted = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*kinds)
    return files.where(wanted).select(
        F.col("_metadata.file_path").alias("doc_id"),
        F.col("value").alias("content"),
        name.alias("filename"),
        F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"),
        F.col("_metadata.file_size").alias("size"),
    )


def _readable(column: str) -> Column:
    """The text without undecodable bytes."""
    cleaned = F.replace(F.make_valid_utf8(column), F.lit(REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(column), F.col(column)).otherwise(cleaned)


def _below(name: str, root: str) -> Column:
    """A path from behind the first ``root`` on; a path without it stays."""
    folder = root.strip("/") + "/"
    at = F.instr(F.col(name), folder)
    return F.when(at > 0, F.substr(F.col(name), at + len(folder))).otherwise(F.col(name))


def read_corpus(
    spark: SparkSession, path: str, max_documents: int | None = None, root: str | None = None
) -> DataFrame:
    """(doc_id, content, metadata) from a file or a directory tree.

    Blank files are skipped, undecodable bytes are dropped. Each JSON line of a
    ``jsonl`` file is a document with the id ``path:L<number>``; other lines are
    skipped. ``root`` is cut off the front of the ids. ``max_documents`` keeps the
    first documents by id, when the caller wants a cap; there is none by default.
    """
    text = _readable("content")
    files = _files(spark, path, WHOLE_FILE_TYPES)
    whole = files.withColumn("content", text).where(F.col("content").rlike(r"(?U)\S")).select(
        "doc_id",
        "content",
        F.create_map(
            F.lit("filename"), F.col("filename"),
            F.lit("extension"), F.col("extension"),
            F.lit("size_bytes"), F.col("size").cast("string"),
        ).alias("metadata"),
    )
    text = _readable("value")
    logs = numbered_lines(spark, path, recursiveFileLookup=True, pathGlobFilter=LINE_FILES)
    number = F.col("line").cast("string")
    lines = (
        logs.withColumn("content", text)
        .withColumn("content", F.trim("content"))
        .where((F.col("content") != "") & F.try_parse_json("content").isNotNull())
        .select(
            F.concat("file", F.lit(":L"), number).alias("doc_id"),
            "content",
            F.create_map(
                F.lit("filename"), F.col("filename"),
                F.lit("extension"), F.lit("." + LINE_FILE_TYPE),
                F.lit("line_number"), number,
            ).alias("metadata"),
        )
    )
    docs = whole.unionByName(lines)
    if root:
        docs = docs.withColumn("doc_id", _below("doc_id", root))
    return docs if max_documents is None else docs.orderBy("doc_id").limit(max_documents)


def read_corpus_strict(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Whole files for synthesis; a file that is not valid text fails the read."""
    files = _files(spark, path, [*WHOLE_FILE_TYPES, LINE_FILE_TYPE])
    broken = files.where(~F.is_valid_utf8("content")).select("doc_id").limit(10)
    names = [r["doc_id"] for r in broken.collect()]
    if names:
        raise CorpusError(f"not readable as UTF-8: {', '.join(names)}")
    doc_id = F.col("doc_id")
    if root:
        doc_id = _below("doc_id", root)
    return files.where(F.col("content").rlike(r"(?U)\S")).select(doc_id.alias("doc_id"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Retriever documents ``{content, metadata, id}``: one per line in ``.jsonl`` and
    ``.ndjson`` files, arrays or objects in ``.json`` files, from a file or a folder with
    both, also compressed. Other files of a folder are passed over; a path that gives
    only such files is an error."""

    def rows(kind: str, whole: bool) -> DataFrame:
        reader = spark.read.option("pathGlobFilter", kind).option("multiLine", whole)
        return reader.schema("id STRING, content STRING, metadata MAP<STRING, STRING>").json(path)

    found = spark.read.format("binaryFile").load(path).select("path")
    names = [r["path"].rsplit("/", 1)[-1] for r in found.take(1)]
    taken = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{DOCUMENT_LINES},{DOCUMENT_FILES}}}").load(path)
    if names and taken.select("path").isEmpty():
        raise CorpusError(f"neither JSON lines nor JSON files, e.g. {names[0]}")
    return rows(DOCUMENT_LINES, False).unionByName(rows(DOCUMENT_FILES, True)).select(
        F.col("id").alias("doc_id"), F.coalesce("content", F.lit("")).alias("content"), "metadata"
    )
