"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as request, response (or revisit) and metadata records. The
latter two name the response in WARC-Concurrent-To, and reading joins the records
through these identifiers to one nested row per capture.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import let

VERSION = "WARC/1.1"
#: Between two records; Spark's text reader cuts archives here.
BETWEEN = f"\r\n\r\n{VERSION}\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_SCHEMA = "file string, record string"


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base 32, upper case without padding, of 40 hexadecimal digits."""
    chars = []
    for at in range(0, 40, 5):
        number = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("long")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(31) + 1
            chars.append(F.lit(BASE32).substr(place.cast("int"), F.lit(1)))
    return F.concat(*chars)


def payload_digest(payload: Column) -> Column:
    # Bound once: written out, the hash would stand in the plan for each of the 32 letters.
    return let(F.sha1(payload.cast("binary")), base32_of_hex)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, first (page_id and url of the response a revisit refers to).

    Of equal payloads of at least ``min_bytes`` the largest page_id is the response;
    shorter ones are all responses. Only the digest of each payload is grouped. In the
    join a common payload is a hot key on the page side alone, which Spark may split.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"digest": payload_digest(F.col("payload")), "n_bytes": F.octet_length("payload").cast("long")}
    )
    winners = (
        keyed.where((F.col("n_bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("_first"))
    )
    refers = ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return keyed.join(winners, "digest", "left").select(
        "page_id", "url", "payload", "digest", "n_bytes", F.when(refers, F.col("_first")).alias("first")
    )


def _uuid(*parts: Column) -> Column:
    text = F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(text, a, n) for a, n in at)), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    size = F.octet_length(block).cast("string")
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", kind),
        *headers,
        _header("Content-Type", F.lit(content_type)),
        _header("Content-Length", size),
        F.lit("\r\n"),
        block,
    )


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", pages_per_file: int = 20_000
) -> None:
    """Write pages (page_id, url, html) as gzip WARC files below ``path`` (shared storage).

    Null html is an empty payload; a null url or page_id leaves its header or field
    out. Line ends in a url are percent-encoded. Equal payloads become revisits as
    ``mark_revisits`` says. A repeated row is a capture of its own.
    """
    marked = mark_revisits(pages, min_bytes)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    host = F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_extract(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    own, first = _uuid(F.lit("capture"), F.col("page_id"), F.col("url"), F.col("digest")), F.col("first")
    request_id = _uuid(F.lit("request"), own)
    metadata_id = _uuid(F.lit("metadata"), own)
    about = [_header("WARC-Target-URI", F.col("uri")), _header("WARC-Date", F.lit(date))]
    beside = _header("WARC-Concurrent-To", F.col("own"))

    status = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    revisit = first.isNotNull()
    capture = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [
            _header("WARC-Record-ID", F.col("own")),
            *about,
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _header("WARC-Refers-To", F.when(revisit, F.col("first_id"))),
            _header(
                "WARC-Profile",
                F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ],
        "application/http; msgtype=response",
        F.when(revisit, status).otherwise(F.concat(status, F.col("payload"))),
    )
    request = _record(
        F.lit("request"),
        [_header("WARC-Record-ID", F.col("request_id")), beside, *about],
        "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n")),
    )
    metadata = _record(
        F.lit("metadata"),
        [_header("WARC-Record-ID", F.col("metadata_id")), beside, *about],
        "application/warc-fields",
        F.concat(
            _header("page-id", F.col("page_id").cast("string")),
            _header("refers-to-page-id", first["page_id"].cast("string")),
        ),
    )
    named = marked.withColumns(
        {
            "uri": uri,
            "own": own,
            "first_id": _uuid(F.lit("capture"), first["page_id"], first["url"], F.col("digest")),
        }
    ).withColumns({"request_id": request_id, "metadata_id": metadata_id})
    (
        named.select(F.concat_ws("\r\n\r\n", request, capture, metadata).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", pages_per_file)
        .text(path)
    )


def _whole_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Records of archives cut by Content-Length, one archive in memory at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                records, at = [], 0
                while (head := data.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict(
                        line.lower().split(b":", 1) for line in data[at:head].split(b"\r\n") if b":" in line
                    )
                    end = head + 4 + int(fields.get(b"content-length", b"0"))
                    records.append(data[at:end].decode("utf-8", "replace"))
                    at = end + 4
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(records)), pa.array(records)], ["file", "record"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(cut, RECORD_SCHEMA)


def _field(name: str, within: str = "head") -> Column:
    found = F.regexp_extract(within, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _opened(record: Column) -> Column:
    """A record without its version line, which the reader leaves on the first one of a file."""
    opening = f"{VERSION}\r\n"
    bare = F.substring(record.cast("binary"), len(opening) + 1, 1 << 30).cast("string")
    return F.when(F.startswith(record, F.lit(opening)), bare).otherwise(record)


def _parsed(records: DataFrame) -> DataFrame:
    """Headers and block of (file, record). All lengths are bytes, as the headers have them."""
    split = records.withColumn("head", F.substring_index("record", "\r\n\r\n", 1))
    begin = F.octet_length("head") + 4
    size = F.octet_length("record") - begin
    declared = _field("Content-Length").cast("int")
    # The last record of a file still has its own closing line ends.
    last = (size == declared + 4) & F.endswith("record", F.lit("\r\n\r\n"))
    block = F.col("record").cast("binary").substr(begin + 1, F.when(last, size - 4).otherwise(size)).cast("string")
    return split.select(
        "file",
        _field("WARC-Type").alias("type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Concurrent-To").alias("concurrent_to"),
        _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("target_uri"),
        _field("WARC-Date").alias("date"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        block.alias("block"),
        F.coalesce(last | (size == declared), F.lit(False)).alias("whole"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: headers and block (text).

    The text reader streams records one by one. An archive with a block that itself
    holds a record's opening is noticed by its Content-Length and read again whole.
    """
    lines = spark.read.option("lineSep", BETWEEN).text(path)
    cut = lines.select(
        F.col("_metadata.file_path").alias("file"),
        _opened(F.col("value")).alias("record"),
    )
    records = _parsed(cut)
    broken = [r["file"] for r in records.where(~F.col("whole")).select("file").distinct().collect()]
    if broken:
        again = _whole_files(spark, broken).withColumn("record", _opened(F.col("record")))
        records = records.where(~F.col("file").isin(broken)).unionByName(_parsed(again))
    return records.drop("whole")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with the request and metadata concurrent to it.

    A response without them has nulls there. Of several requests (or metadata records)
    for one response the one with the smallest identifier is kept; repeated responses
    stay repeated. Requests without a response make no row.
    """
    begin = F.octet_length("http_head") + 5
    payload = F.col("block").cast("binary").substr(begin, F.octet_length("block")).cast("string")
    # Size and digest are taken before the joins, which the payload need not pass if nobody asks for it.
    responses = (
        records.where(F.col("type").isin("response", "revisit"))
        .withColumn("http_head", F.substring_index("block", "\r\n\r\n", 1))
        .withColumn("payload", payload)
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("read_digest", payload_digest(F.col("payload")))
    )

    def beside(kind: str, name: str) -> DataFrame:
        rows = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(
            F.min(F.struct(F.col("record_id").alias("id"), "date", "block")).alias(name)
        )

    joined = responses.join(beside("request", "request"), "record_id", "left").join(
        beside("metadata", "metadata"), "record_id", "left"
    )
    return joined.select(
        F.col("record_id").alias("capture_id"),
        "target_uri",
        "date",
        F.col("type").alias("record_type"),
        F.struct("http_head", "payload", "payload_bytes", "read_digest", "payload_digest", "refers_to").alias("response"),
        "request",
        "metadata",
    )


def page_digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of assembled captures.

    Size and digest of a response come from the payload that was read; a revisit has
    no payload, and states both in its headers.
    """
    fields, head = F.col("metadata.block"), F.col("response.http_head")
    shaped = captures.withColumns({"fields": fields, "http": head})
    revisit = F.col("record_type") == "revisit"
    return shaped.select(
        _field("page-id", "fields").cast("long").alias("page_id"),
        F.when(revisit, _field("Content-Length", "http").cast("long"))
        .otherwise(F.col("response.payload_bytes"))
        .alias("payload_bytes"),
        F.when(revisit, F.col("response.payload_digest"))
        .otherwise(F.col("response.read_digest"))
        .alias("payload_digest"),
        "record_type",
        _field("refers-to-page-id", "fields").cast("long").alias("refers_to"),
    )
