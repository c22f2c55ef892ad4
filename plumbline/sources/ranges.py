"""Records of JSON arrays and quoted CSV files, read by byte ranges.

Where a record begins cannot be told from the middle of such a file: a brace or a
line end may stand inside a string. So every range is read under both guesses,
"it begins inside a string" and "outside", and reports in a few numbers what it does
to either: whether it ends inside a string, how many brackets it closes and leaves
open. One small pass per file over these reports tells the state at the beginning of
each range, and a second read cuts the records. Only a record that crosses the end of
a range is put together from its parts; no other text is shuffled.

Ranges are Spark's own splits of the text source, with ``}`` or a line end as the
separator, so files may be of any size and lie in any store that Spark reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range that are worked on at once.
CHUNK = 4 << 20
_BRACKET = np.zeros(256, np.int64)
_BRACKET[[ord("{"), ord("[")]] = 1
_BRACKET[[ord("}"), ord("]")]] = -1
_SPACE = b" \t\r\n"


class RangeError(ValueError):
    """A file ends inside a record."""


@dataclass(frozen=True)
class Effect:
    """What some bytes do: end inside a string or not, close ``closes`` brackets of before and leave ``opens`` open.

    ``items`` tells of the first two of these whether they open the list named
    ``items``. For CSV, ``closes`` is the number of records that end.
    """

    inside: bool
    closes: int = 0
    opens: int = 0
    items: tuple[bool, ...] = ()

    def then(self, after: Effect) -> Effect:
        if after.closes > self.opens:
            return Effect(after.inside, self.closes + after.closes - self.opens, after.opens, after.items)
        left = self.opens - after.closes
        return Effect(after.inside, self.closes, left + after.opens, (*self.items[:left], *after.items)[:2])


def _quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash takes away."""
    found = np.flatnonzero(data == ord('"'))
    slashes = data == ord("\\")
    doubtful = (found > 0) & slashes[found - 1]
    if doubtful.any():
        last_other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        run = found - 1 - last_other[found - 1]
        found = found[~doubtful | (run % 2 == 0)]
    return found


def _brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the brackets outside strings, and whether the data ends inside one."""
    quotes = _quotes(data)
    places = np.flatnonzero(_BRACKET[data])
    outside = (np.searchsorted(quotes, places) + inside) % 2 == 0
    return places[outside], bool((len(quotes) + inside) % 2)


def _names_items(data: np.ndarray, place: int) -> bool:
    """Whether the bracket at ``place`` opens the value of a field named ``items``."""
    before = data[max(0, place - 4096) : place].tobytes().rstrip(_SPACE)
    return data[place] == ord("[") and before.endswith(b":") and before[:-1].rstrip(_SPACE).endswith(b'"items"')


def json_effect(data: np.ndarray, inside: bool) -> Effect:
    places, ends_inside = _brackets(data, inside)
    depth = np.concatenate([[0], np.cumsum(_BRACKET[data[places]])])
    low = int(depth.min())
    items: list[bool] = []
    for level in (low, low + 1):
        last = np.flatnonzero(depth == level)
        if depth[-1] > level and len(last):
            items.append(_names_items(data, int(places[last[-1]])))
    return Effect(ends_inside, -low, int(depth[-1]) - low, tuple(items))


#: A line that begins outside quotes and ends inside, and one that begins inside and ends outside.
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_OPENS = re.compile(rb"(?:" + _FIELD + rb',)*+"(?:[^"]++|"")*+\Z')
_CLOSES = re.compile(rb'(?:[^"]++|"")*+"(?!")[^,]*+')


def csv_effect(line: bytes, inside: bool) -> bool:
    """Whether a line ends inside quotes."""
    if b'"' not in line:
        return inside
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        line = line[closed.end() :]
        if not line.startswith(b","):
            return False
        line = line[1:]
    return _OPENS.match(line) is not None


def _ranges(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(fid, block, piece): pieces of text between separators, in the order of each range."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.xxhash64("_metadata.file_path").alias("fid"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )


def _files(spark: SparkSession, path: str | list[str]) -> dict[int, tuple[str, int]]:
    """Path and size of each file by its number: one row per file, as the driver lists them anyway. No content is read."""
    listed = spark.read.format("binaryFile").load(path)
    rows = listed.select("path", "length", F.xxhash64("_metadata.file_path").alias("fid")).collect()
    return {r["fid"]: (r["path"], r["length"]) for r in rows}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes], bool]]:
    """(file, block, pieces, whether the range ends with them), no more than some CHUNK bytes at once."""
    at, held, size = None, [], 0
    for batch in batches:
        for fid, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is not None and (fid, block) != at:
                yield *at, held, True
                held, size = [], 0
            elif size >= CHUNK:
                yield *at, held, False
                held, size = [], 0
            at = (fid, block)
            held.append(piece)
            size += len(piece) + 1
    if at is not None:
        yield *at, held, True


def _joined(pieces: list[bytes]) -> np.ndarray:
    """JSON with the braces that separated the pieces, and one behind the last."""
    return np.frombuffer(b"}".join(pieces) + b"}", np.uint8)


def _json_effect(pieces: list[bytes], inside: bool) -> Effect:
    return json_effect(_joined(pieces), inside)


def _csv_effect(lines: list[bytes], inside: bool) -> Effect:
    ended = 0
    for line in lines:
        inside = csv_effect(line, inside)
        ended += not inside
    return Effect(inside, ended)


def _reports(pieces: DataFrame, effect: Callable[[list[bytes], bool], Effect]) -> DataFrame:
    """Two rows per range, one for each guess."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[Effect] | None = None
        first, size = b"", 0
        for fid, block, held, last in _chunks(batches):
            if done is None:
                done, size = [Effect(False), Effect(True)], 0
                first = b"".join(held).lstrip(b"\xef\xbb\xbf" + _SPACE)[:1]
            done = [d.then(effect(held, d.inside)) for d in done]
            size += sum(map(len, held)) + len(held)
            if last:
                rows = [(fid, block, g, d.inside, d.closes, d.opens, list(d.items), first, size) for g, d in enumerate(done)]
                yield _batch(rows, _REPORT_TYPES)
                done = None

    schema = "fid long, block long, guess int, inside boolean, closes long, opens long, items array<boolean>, first binary, bytes long"
    return pieces.mapInArrow(report, schema)


_REPORT_TYPES = {
    "fid": pa.int64(), "block": pa.int64(), "guess": pa.int32(), "inside": pa.bool_(), "closes": pa.int64(), "opens": pa.int64(),
    "items": pa.list_(pa.bool_()), "first": pa.binary(), "bytes": pa.int64(),
}
_RECORD_TYPES = {"fid": pa.int64(), "start": pa.int64(), "block": pa.int64(), "value": pa.binary()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


@dataclass(frozen=True)
class Start:
    """The state at the beginning of a range; ``since`` is the range in which the open record began."""

    inside: bool = False
    depth: int = 0
    in_items: bool = False
    level: int = 1
    since: int = 0
    header: bool = False


def json_starts(reports: dict[tuple[int, int], Effect], blocks: list[int], first: bytes) -> tuple[dict[int, Start], Start]:
    """The state at the beginning of each range of a file, and at its end."""
    state = Start(level=1 if first == b"[" else 2)
    starts = {}
    for block in blocks:
        starts[block] = state
        effect = reports[block, state.inside]
        low = state.depth - effect.closes
        in_items = state.in_items and low >= 2
        if low in (0, 1) and len(effect.items) > 1 - low:
            in_items = effect.items[1 - low]
        since = state.since if low > state.level else block
        state = replace(state, inside=effect.inside, depth=low + effect.opens, in_items=in_items, since=since)
    return starts, state


def csv_starts(reports: dict[tuple[int, int], Effect], blocks: list[int]) -> tuple[dict[int, Start], Start]:
    state, starts = Start(header=True), {}
    for block in blocks:
        starts[block] = state
        effect = reports[block, state.inside]
        since = state.since if state.inside and not effect.closes else block
        state = Start(inside=effect.inside, since=since, header=state.header and not effect.closes)
    return starts, state


def _cut_json(data: np.ndarray, start: Start) -> tuple[list[bytes], Start, bytes]:
    """(records that end here, state behind, text of the record that is open); the first record may be the end of one."""
    places, inside = _brackets(data, start.inside)
    steps = _BRACKET[data[places]]
    depth = start.depth + np.cumsum(steps)
    before = depth - steps
    if start.level == 1:
        taken = np.ones(len(places), bool)
        in_items = True
    else:
        # The list of items is entered and left where the depth passes from 1 to 2 and back.
        gates = np.flatnonzero((np.minimum(depth, before) == 1) & (np.maximum(depth, before) == 2))
        state, at = start.in_items, 0
        taken = np.zeros(len(places), bool)
        for gate in gates:
            taken[at:gate] = state
            at = gate
            state = bool(steps[gate] > 0 and _names_items(data, int(places[gate])))
        taken[at:] = state
        in_items = state
    level = start.level
    ends = places[taken & (steps < 0) & (depth == level)] + 1
    begins = places[taken & (steps > 0) & (before == level)]
    text, out, at = data.tobytes(), [], 0
    opened = start.depth > level and (level == 1 or start.in_items)
    if opened:
        begins = np.concatenate([[0], begins])
    for number, (a, b) in enumerate(zip(begins, ends)):
        out += _stray(text[at:a], level) if number or not opened else []
        out.append(text[a:b])
        at = b
    open_at = int(begins[len(ends)]) if len(begins) > len(ends) else len(text)
    out += _stray(text[at:open_at], level) if not opened or len(ends) else []
    behind = replace(start, inside=inside, depth=int(depth[-1]) if len(depth) else start.depth, in_items=in_items and level == 2)
    return out, behind, text[open_at:]


def _stray(between: bytes, level: int) -> list[bytes]:
    """What stands between the records of a list besides commas; it is handed on, so that the parser refuses it."""
    found = between.strip(b" \t\r\n,[\xef\xbb\xbf") if level == 1 else b""
    return [] if not found or found[:1] in b"]}" else [found]


def _cut_csv(lines: list[bytes], start: Start) -> tuple[list[bytes], Start, bytes]:
    """(records that end here, state behind, text of the record that is open); the first line of a file is left out."""
    out, held, inside, header = [], b"", start.inside, start.header
    for line in lines:
        inside = csv_effect(line, inside)
        held += line
        if inside:
            held += b"\n"
        else:
            out.append(b"" if header else held.removesuffix(b"\r"))
            held, header = b"", False
    return out, replace(start, inside=inside, header=header), held


def _records(pieces: DataFrame, starts: dict[tuple[int, int], Start], cut: Callable) -> DataFrame:
    """(fid, start, block, value): whole records without fid, and parts with file and range where their record begins."""
    shared = pieces.sparkSession.sparkContext.broadcast(starts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, known = None, b"", shared.value
        whole = True
        for fid, block, some, last in _chunks(batches):
            if (fid, block) not in known:
                continue
            if state is None:
                state, held = known[fid, block], b""
                since, whole = state.since, not _is_open(state)
            rows = []
            found, state, rest = cut(some, state)
            for record in found:
                rows.append((None if whole else fid, since, block, held + record))
                held, whole = b"", True
            held += rest
            if last:
                if held:
                    rows.append((fid, block if whole else since, block, held))
                state = None
            yield _batch(rows, _RECORD_TYPES)

    return pieces.mapInArrow(read, "fid long, start long, block long, value binary")


def _is_open(state: Start) -> bool:
    return state.inside or (state.depth > state.level and (state.level == 1 or state.in_items))


def _stitched(records: DataFrame) -> DataFrame:
    """(value): whole records as they are, the others put together from their parts, at most two for each range."""
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda done, part: F.concat(done, part["value"]))
    made = records.where("fid is not null").groupBy("fid", "start").agg(joined.alias("value"))
    return records.where("fid is null").select("value").unionByName(made.select("value")).select(F.col("value").cast("string"))


def _gathered(reports: DataFrame) -> dict[int, tuple[dict[tuple[int, int], Effect], list[int], bytes, int]]:
    """Reports of each file. They are as many as the ranges, which the driver plans one by one anyway."""
    files: dict[int, tuple] = {}
    for r in reports.collect():
        effects, blocks, first, sizes = files.setdefault(r["fid"], ({}, set(), {}, {}))
        effects[r["block"], r["guess"]] = Effect(r["inside"], r["closes"], r["opens"], tuple(r["items"]))
        blocks.add(r["block"])
        first[r["block"]], sizes[r["block"]] = bytes(r["first"]), r["bytes"]
    return {fid: (e, sorted(b), next((f[x] for x in sorted(b) if f[x]), b""), sum(s.values())) for fid, (e, b, f, s) in files.items()}


def json_elements(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(value) of the elements of JSON files that hold a list, or an object with a list ``items``; and the other files.

    The other files are objects whose ``items`` does not cross the end of a range, or that
    have none: they are to be read whole. A list that does not end is a RangeError. What
    is no object among the elements of a list comes as it stands.
    """
    pieces, files = _ranges(spark, path, "}"), _files(spark, path)
    starts, others = {}, []
    for fid, (effects, blocks, first, size) in _gathered(_reports(pieces, _json_effect)).items():
        name, length = files[fid]
        begun, end = json_starts(effects, blocks, first)
        if first != b"[" and not any(s.in_items for s in begun.values()):
            others.append(re.sub(r"([\[\]{}*?\\])", r"\\\1", name))
            continue
        # Each piece is read with a brace behind it; the last one of a list has none.
        more = size - length if size - length in (0, 1) else int(first == b"[")
        if end.inside or end.depth != -more:
            raise RangeError(f"{name} ends inside a record")
        starts |= {(fid, block): state for block, state in begun.items()}
    return _stitched(_records(pieces, starts, _cut_json_pieces)), others


def _cut_json_pieces(pieces: list[bytes], start: Start) -> tuple[list[bytes], Start, bytes]:
    return _cut_json(_joined(pieces), start)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): the records of CSV files but the first of each, which is its header; line ends in quotes are kept.

    Blank lines are left out. Lines end with a line feed, or carriage return and line
    feed. A file that ends inside quotes is a RangeError.
    """
    pieces, starts = _ranges(spark, path, "\n"), {}
    for fid, (effects, blocks, _, _) in _gathered(_reports(pieces, _csv_effect)).items():
        begun, end = csv_starts(effects, blocks)
        if end.inside:
            raise RangeError(f"{_files(spark, path)[fid][0]} ends inside quotes")
        starts |= {(fid, block): state for block, state in begun.items()}
    return _stitched(_records(pieces, starts, _cut_csv)).where("value != ''")
