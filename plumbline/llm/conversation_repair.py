"""Repair of the turn structure of conversations by the cheapest edits.

A row of a conversation is a symbol: the initial of its role with its fault. Edits
turn the initials of the rows that stay into ``(s?(ua)+)?``. What a symbol does to the
four states of that pattern is a min-plus matrix of costs and edits. Re-Pair names the
pairs of neighbouring symbols that are frequent over all conversations by rules, and
the matrix of a rule is the product of the matrices of its two halves, made once and
used for every conversation. Edits are kept as ropes: an entry of a product knows the
state in the middle, and text is made for the chosen path only. The edits of an entry end with the
edit of a row, so no audit is the beginning of another one with the same ends, and
which of two equally cheap entries comes first is known from the order of their first
halves; no texts are compared.

Long conversations are cut into segments of 65,536 rows, by their numbers in an order
over all rows; segments meet as matrices, and their edits are joined to the rows as
these pass in order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_batches

#: Initials, and the states of the pattern: nothing yet, after s, after u, after a.
INITIALS = "sua"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED_KEPT = 2, 3, 2, 1
#: Faults, in the order of the symbols of one initial.
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
FIRST_SYMBOL, FIRST_RULE = ord("A"), 0xE000
#: Rows of a segment as a power of two, and limits of the grammar, which change no result.
SEGMENT_BITS = 16
MOST_RULES, RULES_A_ROUND, ROUNDS = 2048, 64, 24
#: White space of the definition.
BLANKS = " \t\n\x0b\x0c\r"
_HEAD = 64
_FAR = 1 << 60


class Matrix:
    """For each pair of states: cost, order of the edits among those from the same state, and how they are made."""

    __slots__ = ("cost", "made", "rank")

    def __init__(self, cost: list[int], rank: list[int], made: list) -> None:
        self.cost, self.rank, self.made = cost, rank, made


def _inserted(state: int) -> dict[int, int]:
    """States that inserted rows alone lead to, with their number."""
    found, last = {state: 0}, state
    for number in (1, 2):
        last = STEP[last, "a" if last == 2 else "u"]
        found.setdefault(last, number)
    return found


def symbol_matrix(initial: str, fault: int) -> Matrix:
    """Inserted rows, then the edit of the row itself."""
    cost, rank, made = [_FAR] * 16, [0] * 16, [""] * 16
    for start in STATES:
        for state, inserts in _inserted(start).items():
            edits = [(DELETE, "D", state)]
            if fault in (OK, TRUNCATED):
                kept = TRUNCATED_KEPT * (fault == TRUNCATED)
                for to in INITIALS:
                    if (state, to) in STEP and (to == initial or to in ROLES):
                        edits.append((kept + REROLE * (to != initial), "K" if to == initial else "R", STEP[state, to]))
            for price, letter, end in edits:
                at = 4 * start + end
                cost[at], made[at] = min((cost[at], made[at]) if cost[at] < _FAR else (_FAR, ""), (INSERT * inserts + price, "I" * inserts + letter))
        row = range(4 * start, 4 * start + 4)
        for place, at in enumerate(sorted(row, key=lambda x: made[x])):
            rank[at] = place
    return Matrix(cost, rank, made)


def times(a: Matrix, b: Matrix) -> Matrix:
    """``a`` and then ``b``: the cheapest way through a state in the middle, of equally cheap ones the first."""
    cost, rank, made = [_FAR] * 16, [0] * 16, [0] * 16
    for start in (0, 4, 8, 12):
        order = []
        for end in STATES:
            best = min((a.cost[start + mid] + b.cost[4 * mid + end], a.rank[start + mid], mid) for mid in STATES)
            mid = best[2]
            cost[start + end], made[start + end] = min(best[0], _FAR), mid
            order.append((best[1], b.rank[4 * mid + end], end))
        for place, (_, _, end) in enumerate(sorted(order)):
            rank[start + end] = place
    return Matrix(cost, rank, made)


class Grammar:
    """Rules (symbol, left, right) in the order of their application, and the matrices of all symbols."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.rules = rules
        self.halves = {symbol: (left, right) for symbol, left, right in rules}
        self.matrices = {chr(FIRST_SYMBOL + n): symbol_matrix(initial, fault) for n, (initial, fault) in enumerate(product([*INITIALS, ""], range(4)))}
        for symbol, left, right in rules:
            self.matrices[symbol] = times(self.matrices[left], self.matrices[right])
        self._edits: dict[tuple[str, int], str] = {}
        self._folded: dict[str, list[Matrix]] = {}

    def compress(self, sequences: list[str]) -> list[str]:
        """All sequences with the rules applied."""
        text = "\n".join(sequences)
        for symbol, left, right in self.rules:
            text = text.replace(left + right, symbol)
        return text.split("\n") if sequences else []

    def fold(self, compressed: str) -> list[Matrix]:
        """Matrices of all beginnings of a compressed sequence; equal sequences are folded once."""
        done = self._folded.get(compressed)
        if done is None:
            done = [self.matrices[compressed[0]]]
            for symbol in compressed[1:]:
                done.append(times(done[-1], self.matrices[symbol]))
            if len(compressed) < 64:
                if len(self._folded) >= 20_000:
                    self._folded.clear()
                self._folded[compressed] = done
        return done

    def edits(self, symbol: str, entry: int) -> str:
        """Letters of an entry of a symbol's matrix."""
        if symbol not in self.halves:
            return self.matrices[symbol].made[entry]
        found = self._edits.get((symbol, entry))
        if found is None:
            (left, right), mid = self.halves[symbol], self.matrices[symbol].made[entry]
            found = self.edits(left, entry // 4 * 4 + mid) + self.edits(right, 4 * mid + entry % 4)
            self._edits[symbol, entry] = found
        return found

    def audit(self, compressed: str, start: int, end: int) -> str:
        """Letters of the way from one state to another."""
        beginnings, parts = self.fold(compressed), []
        for at in range(len(compressed) - 1, 0, -1):
            mid = beginnings[at].made[4 * start + end]
            parts.append(self.edits(compressed[at], 4 * mid + end))
            end = mid
        parts.append(self.edits(compressed[0], 4 * start + end))
        return "".join(reversed(parts))


def _pair_counts(sequences: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(left, right, n): neighbouring symbols once ``rules`` are applied, over all conversations."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            text = "\n".join(grammar.compress(batch["symbols"].to_pylist()))
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
            ends = codes == ord("\n")
            weights = batch["n"].to_numpy()[np.cumsum(ends)]
            inside = ~(ends[1:] | ends[:-1])
            pairs, place = np.unique((codes[:-1] << np.uint64(32) | codes[1:])[inside], return_inverse=True)
            n = np.bincount(place, weights[:-1][inside], len(pairs)).astype(np.int64)
            columns = [(pairs >> np.uint64(32)).astype(np.int32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["l", "r", "n"])

    counted = sequences.mapInArrow(count, "l int, r int, n long")
    return counted.groupBy("l", "r").agg(F.sum("n").alias("n"))


def learn_grammar(sequences: DataFrame) -> Grammar:
    """Re-Pair over all sequences (symbols, n); a round takes several pairs that cannot overlap.

    Pairs of one round have no symbol that is the left half of one and the right half of
    another, so the count of each is the number of its replacements (a pair of equal
    symbols aside). Only the most frequent pairs of a round reach the driver.
    """
    rules: list[tuple[str, str, str]] = []
    for _ in range(ROUNDS):
        best = _pair_counts(sequences, rules).where("n > 1").orderBy(F.desc("n"), "l", "r").limit(RULES_A_ROUND).collect()
        lefts, rights, room = set(), set(), MOST_RULES - len(rules)
        for row in best:
            if row["l"] not in rights and row["r"] not in lefts and room > 0:
                rules.append((chr(FIRST_RULE + len(rules)), chr(row["l"]), chr(row["r"])))
                lefts.add(row["l"])
                rights.add(row["r"])
                room -= 1
        if not best or room <= 0:
            break
    return Grammar(rules)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that the checksum of ``conv_id:turn`` asks for.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats
    it and 4 makes it the user's. Null roles and texts become one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    told = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


#: Rows of a conversation ascend by these: turn (null first); rows of one turn by the beginnings of role and
#: text, and by a digest of both where these are equal. Rows that are equal in all are copies of one row.
ORDER = ["conv_id", "turn", "role_head", "head", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the columns of ORDER; nulls of role and text are one space."""
    space = F.lit(" ")
    told = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return told.select(
        "conv_id", "turn", F.left("role", F.lit(_HEAD)).alias("role_head"), F.left("text", F.lit(_HEAD)).alias("head"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), "role", "text",
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """(ORDER, pos, symbol) of keyed rows; ``pos`` ascends in order over all rows. No texts are moved."""
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    slim = rows.select(
        *ORDER,
        (F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.nullif(initial, F.lit(""))), F.lit(0)), F.lit(4)) * 4 - 4).alias("base"),
        (solid == "").alias("blank"),
        (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("salt"),
    )
    spread = slim.repartitionByRange(*ORDER, "salt").sortWithinPartitions(*ORDER, "salt").drop("salt")
    placed = cut_lineage(spread.withColumn("pos", F.monotonically_increasing_id()))
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("first")).select("first")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OK)
    marked = placed.join(firsts, placed["pos"] == firsts["first"], "left")
    return marked.select(*ORDER, "pos", F.char(F.col("base") + fault + FIRST_SYMBOL).alias("symbol"))


def _sequences(symbols: DataFrame) -> DataFrame:
    """(conv_id, segment, first, symbols): at most 2 ** SEGMENT_BITS rows each; ``first`` has the place of the first row."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "symbol")))
    return symbols.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("segment")).agg(
        F.min(F.struct("pos", *ORDER[1:])).alias("first"),
        F.array_join(F.transform(listed, lambda x: x["symbol"]), "").alias("symbols"),
    )


_FACTS = "blank long, duplicate long, truncated long, illegal long"


def _facts(symbols: str) -> tuple[int, int, int, int]:
    """Rows that are blank, duplicate, truncated, and neighbours whose initials may not meet."""
    codes = np.frombuffer(symbols.encode("latin-1"), np.uint8) - FIRST_SYMBOL
    n = np.bincount(codes % 4, minlength=4)
    return int(n[BLANK]), int(n[DUPLICATE]), int(n[TRUNCATED]), int((~_meets(codes[:-1] // 4, codes[1:] // 4)).sum())


def _meets(left, right):
    """su, ua or au, for initials as places in INITIALS."""
    return ((right == 1) & ((left == 0) | (left == 2))) | ((left == 1) & (right == 2))


def _segment_matrices(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            given = batch["symbols"].to_pylist()
            for told, compressed in zip(given, grammar.compress(given), strict=True):
                last = grammar.fold(compressed)[-1]
                rows.append((last.cost, last.rank, *_facts(told), (ord(told[0]) - FIRST_SYMBOL) // 4, (ord(told[-1]) - FIRST_SYMBOL) // 4))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.int64()] * 4, pa.int32(), pa.int32()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["segment"], *made], ["conv_id", "segment", "cost", "rank", *_fact_names(), "enters", "leaves"])

    schema = f"conv_id long, segment long, cost array<long>, rank array<int>, {_FACTS}, enters int, leaves int"
    return sequences.select("conv_id", "segment", "symbols").mapInArrow(evaluate, schema)


def _fact_names() -> list[str]:
    return [c.split()[0] for c in _FACTS.split(", ")]


def best_path(segments: list[dict]) -> tuple[int, list[int], int]:
    """(cost, states between the segments, rows to insert at the end) of the cheapest, first audit."""
    cost, rank, back = [0, _FAR, _FAR, _FAR], [0, 0, 0, 0], []
    for segment in segments:
        step = times(Matrix(cost + [_FAR] * 12, rank + [0] * 12, []), Matrix(segment["cost"], segment["rank"], []))
        cost, rank = step.cost[:4], step.rank[:4]
        back.append(step.made[:4])
    closing = {0: 0, 3: 0, 2: 1, 1: 2}
    total, _, state = min((cost[s] + INSERT * closing[s], rank[s], s) for s in STATES)
    states = [state]
    for middle in reversed(back):
        states.append(middle[states[-1]])
    return total, states[::-1], closing[state]


def _paths(matrices: DataFrame) -> DataFrame:
    """One row per conversation: its counts, its cost, and the states at the ends of its segments.

    A conversation has one matrix for 65,536 rows, so that one as long as its audit may
    be (a string of 2 GB) has some 32,000 of them.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segments in batch["segments"].to_pylist():
                cost, states, closing = best_path(segments)
                facts = [sum(s[name] for s in segments) for name in _fact_names()]
                facts[-1] += sum(not _meets(a["leaves"], b["enters"]) for a, b in zip(segments, segments[1:]))
                last = len(segments) - 1
                ways = [
                    {"segment": s["segment"], "start": a, "end": b, "closing": closing * (n == last)}
                    for n, (s, a, b) in enumerate(zip(segments, states[:-1], states[1:], strict=True))
                ]
                rows.append((*facts, cost, ways))
            way = pa.list_(pa.struct([("segment", pa.int64()), *((c, pa.int32()) for c in ("start", "end", "closing"))]))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, [pa.int64()] * 5 + [way], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *made], ["conv_id", *_fact_names(), "cost", "ways"])

    listed = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "cost", "rank", *_fact_names(), "enters", "leaves"))).alias("segments"))
    return listed.mapInArrow(choose, f"conv_id long, {_FACTS}, cost long, ways array<struct<segment:long,start:int,end:int,closing:int>>")


def _pieces(sequences: DataFrame, paths: DataFrame, grammar: Grammar) -> DataFrame:
    """(conv_id, segment, first, start, audit): the letters of each segment."""
    way = paths.select(F.col("conv_id").alias("_conv"), F.inline("ways").alias("_segment", "start", "end", "closing"))
    here = sequences["conv_id"].eqNullSafe(way["_conv"]) & (sequences["segment"] == way["_segment"])
    chosen = sequences.join(way, here).select("conv_id", "segment", "first", "start", "end", "closing", "symbols")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch[c].to_pylist() for c in ("symbols", "start", "end", "closing")]
            audits = [grammar.audit(s, a, b) + "I" * c for s, a, b, c in zip(grammar.compress(given[0]), *given[1:], strict=True)]
            columns = [batch[c] for c in ("conv_id", "segment", "first", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(audits, pa.string())], ["conv_id", "segment", "first", "start", "audit"])

    first = sequences.schema["first"].dataType.simpleString()
    return chosen.mapInArrow(write, f"conv_id long, segment long, first {first}, start int, audit string")


class Repair:
    """What was found of all conversations; the tables are made when they are asked for."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows`` (conv_id, turn, role, text) are those to repair; other columns are left out."""
        small_batches(rows.sparkSession, 2000)
        self._rows = _keyed(rows)
        symbols = _symbols(self._rows)
        self._sequences = cut_lineage(_sequences(symbols))
        distinct = cut_lineage(self._sequences.groupBy("symbols").agg(F.count("*").alias("n")))
        self.grammar = learn_grammar(distinct)
        self._paths = cut_lineage(_paths(_segment_matrices(self._sequences, self.grammar)))
        self._pieces = cut_lineage(_pieces(self._sequences, self._paths, self.grammar))

    def conversations(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows."""
        turns = self._rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("n"))
        span = (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
        gaps = turns.groupBy(F.col("conv_id").alias("_conv")).agg(span)
        audits = self._pieces.groupBy(F.col("conv_id").alias("_id")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "").alias("audit")
        )
        found = self._paths.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").join(audits, F.col("conv_id").eqNullSafe(F.col("_id")))
        return found.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *_fact_names(), "cost", "audit")

    def turns(self) -> DataFrame:
        """(conv_id, edit, role, text): the repaired rows of all conversations.

        All rows of a conversation are in one partition, in order. The letters of a
        segment are sorted in front of its first row, so a task holds the letters of
        some segments and one batch of rows, however long the conversation is.
        """
        none = F.lit(None).cast("string")
        placed = ["turn", "role_head", "head", "digest"]
        rows = self._rows.select(*ORDER, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("segment"), "role", "text", F.lit(0).alias("start"))
        letters = self._pieces.select(
            "conv_id", *(F.col(f"first.{c}").alias(c) for c in placed), F.lit(0).alias("kind"), "segment", none.alias("role"), F.col("audit").alias("text"), "start"
        )
        both = rows.unionByName(letters).repartition("conv_id").sortWithinPartitions(*ORDER, "kind", "segment")
        return both.select("conv_id", "kind", "role", "text", "start").mapInArrow(_edited, "conv_id long, edit string, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies letters to the rows that follow them."""
    letters: deque[str] = deque()
    at, state, last = 0, 0, object()
    out: list[tuple] = []

    def insert(conv: int | None) -> None:
        """Rows that are inserted in front of the next letter."""
        nonlocal at, state
        while letters:
            if at == len(letters[0]):
                letters.popleft()
                at = 0
            elif letters[0][at] == "I":
                to = "a" if state == 2 else "u"
                state = STEP[state, to]
                out.append((conv, "I", ROLES[to], ""))
                at += 1
            else:
                return

    def batch_of() -> pa.RecordBatch:
        made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64(), *[pa.string()] * 3], strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["conv_id", "edit", "role", "text"])

    for batch in batches:
        for conv, kind, role, text, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != last:
                insert(last)
                letters.clear()
                at, last = 0, conv
                state = 0
            if kind == 0:
                if not letters:
                    state, at = start, 0
                letters.append(text)
                continue
            insert(conv)
            letter = letters[0][at]
            at += 1
            if letter == "K":
                state = STEP[state, role[0]]
                out.append((conv, "K", role, text))
            elif letter == "R":
                to = "a" if state == 2 else "u"
                state = STEP[state, to]
                out.append((conv, "R", ROLES[to], text))
        yield batch_of()
    insert(last)
    yield batch_of()


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of ``role:text`` of the rows of ``Repair.turns``, one per line.

    A digest is made from the beginning to the end of a conversation, so one task reads
    it; it keeps the running digest and a batch of rows.
    """
    import hashlib

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for batch in batches:
            ids, told = [], []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if running is None or conv != last:
                    if running is not None:
                        ids.append(last)
                        told.append(running.hexdigest())
                    last, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(told, pa.string())], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repaired(originals: DataFrame, repair: Repair) -> DataFrame:
    """One row per conv_id of ``originals`` (a null one too): counts, cost, audit and digest of the repair.

    A conversation without rows has zeros, an empty audit and the digest of nothing.
    """
    every = originals.select(F.col("conv_id").cast("long")).distinct()
    found, digests = repair.conversations(), turn_digests(repair.turns())
    joined = (
        every.join(found.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .join(digests.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    )
    zero = F.lit(0).cast("long")

    def told(name: str, none: Column) -> Column:
        return F.coalesce(F.col(name), none).alias(name)

    numbers = [told(c, zero) for c in ("gaps", *_fact_names(), "cost")]
    return joined.select("conv_id", *numbers, told("audit", F.lit("")), told("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
