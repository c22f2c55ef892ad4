"""Secret scans through a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean query over trigrams that
each match must hold. The index lists, for each trigram that some rule asks for,
the documents that hold it; intersecting these postings leaves the candidates of
a rule, and only those are matched against the expression. A rule without
mandatory trigrams is matched against every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alternatives of a trigram query; one of these sets must be present as a whole.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
MAX_ALTERNATIVES = 64
MASK = "[SECRET]"


class Rule(NamedTuple):
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int

# The base patterns. A run of one class that is matched from its left end
# and then dropped for its length is the same as a run of that length or more.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds of secrets with a fixed look.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
#: What a key header opens: all up to its END line or, without one, lines of base 64. Line ends may be
#: written as \n. Possessive, so that long texts take neither deep recursion nor going back.
_LINE_END, _BASE64 = r"(?:\s|\\[nr])", "[A-Za-z0-9+/=]"
KEY_BODY = (
    r"(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_LINE_END}*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+{_LINE_END}++)*+{_BASE64}{{16,}}+(?:{_LINE_END}++{_BASE64}{{16,}}+)*+"
    rf"(?:{_LINE_END}++{_BASE64}++(?![^\r\n\\]))?+)?+)"
)
#: For masking, a key is secret with its header. ``RULES`` list the header only.
MASK_RULES = tuple(r._replace(pattern=r.pattern + KEY_BODY) if r.kind == "pem" else r for r in RULES)


def _least(query: set[frozenset[str]]) -> Query:
    """Without alternatives that another alternative covers."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(one: Query, other: Query) -> Query:
    met = _least({a | b for a in one for b in other})
    return met if len(met) <= MAX_ALTERNATIVES else one


def _of_strings(strings: set[str]) -> Query:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _of_item(op, arg) -> tuple[set[str] | None, Query]:
    """The strings an item can match, if they are few, and else what each match must hold."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANYTHING
    if op is C.AT:
        return {""}, ANYTHING
    if op is C.IN and len(arg) <= 8 and all(kind is C.LITERAL for kind, _ in arg):
        return {chr(char).lower() for _, char in arg}, ANYTHING
    if op is C.SUBPATTERN:
        return _of_sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_of_sequence(part) for part in arg[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*(strings for strings, _ in parts)), ANYTHING
        return None, _least({a for strings, query in parts for a in (query if strings is None else _of_strings(strings))})
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, item = arg
        strings, query = _of_sequence(item)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ANYTHING
        return None, ANYTHING if low == 0 else query if strings is None else _of_strings(strings)
    return None, ANYTHING


def _of_sequence(items) -> tuple[set[str] | None, Query]:
    running, query, exact = {""}, ANYTHING, True
    for op, arg in items:
        strings, part = _of_item(op, arg)
        if strings is not None and len(running) * len(strings) <= MAX_ALTERNATIVES:
            running = {a + b for a in running for b in strings}
            continue
        exact = False
        query = _both(query, _of_strings(running))
        query = _both(query, part if strings is None else _of_strings(strings))
        running = {""}
    if exact:
        return running, ANYTHING
    return None, _both(query, _of_strings(running))


def trigram_query(pattern: str) -> Query:
    """Lower-case trigrams that each match of ``pattern`` holds; ANYTHING if none is mandatory."""
    strings, query = _of_sequence(re._parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _text(docs: DataFrame) -> DataFrame:
    """Rows with the key that the index uses. Equal keys can only add candidates."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    return text.withColumn("_key", F.xxhash64("doc_id", "text"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram number, document key) of the given trigrams, case folded."""
    low = keyed.select("_key", F.lower("text").alias("low"))
    present = [F.when(F.contains("low", F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams)]
    return low.select("_key", F.explode(F.array_compact(F.array(*present))).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(document key, bit mask of the rules whose query the postings meet)."""
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram"))
    held = index.groupBy("_key").agg(F.bit_or(flag).alias("_held"))
    bit = {t: 1 << n for n, t in enumerate(trigrams)}
    mask = F.lit(0)
    for n, rule in enumerate(rules):
        met = F.lit(False)
        for alternative in sorted(trigram_query(rule.pattern), key=sorted):
            need = sum(bit[t] for t in alternative)
            met = met | (F.col("_held").bitwiseAND(F.lit(need)) == need)
        mask = mask.bitwiseOR(F.when(met, F.lit(1 << n)).otherwise(F.lit(0)))
    return held.select("_key", mask.alias("_rules")).where("_rules != 0")


def _spans(rule: Rule, number: int, possible: Column) -> Column:
    """array<struct<start, n, kind, end>> of one rule, leftmost and non-overlapping, in code points."""
    pattern, empty = F.lit(rule.pattern), F.array().cast("array<string>")
    whole = F.when(possible, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(empty)
    told = F.when(possible, F.regexp_extract_all("text", pattern, F.lit(rule.group))).otherwise(empty)
    between = F.when(possible, F.split("text", rule.pattern, -1)).otherwise(empty)
    found = F.arrays_zip(between.alias("before"), whole.alias("match"), told.alias("told"))
    kind = "struct<start:int,n:int,kind:string,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(done: Column, each: Column) -> Column:
        begin = done["at"] + F.length(each["before"])
        end = begin + F.length(F.coalesce(each["match"], F.lit("")))
        span = F.struct(begin.alias("start"), F.lit(number).alias("n"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(
            F.length(each["told"]) >= rule.least, F.concat(done["out"], F.array(span))
        ).otherwise(done["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.aggregate(found, start, step, lambda done: done["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, ``row`` (all columns as they came) and ``spans``: array<struct<start, n, kind, end>>.

    Spans are in order of start, then of rule.
    ``n`` is the rule's number. Null texts are empty and have no spans; every input
    row gives one row, repeated rows included. Spans of different rules may overlap.
    """
    keyed = _text(docs)
    queries = [trigram_query(rule.pattern) for rule in rules]
    trigrams = sorted({t for query in queries for alternative in query for t in alternative})
    if len(trigrams) > 63:
        raise ValueError("the rules ask for more than 63 trigrams; scan them in parts")
    found = keyed
    if trigrams:
        found = keyed.join(candidates(postings(keyed, trigrams), trigrams, rules), "_key", "left")
    else:
        found = keyed.withColumn("_rules", F.lit(0))
    found = found.withColumn("_rules", F.coalesce("_rules", F.lit(0)))
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        if query == ANYTHING:
            possible = F.rlike("text", F.lit(rule.pattern))
        else:
            possible = F.col("_rules").bitwiseAND(F.lit(1 << n)) != 0
        found = found.withColumn(f"_{n}", _spans(rule, n, possible))
    spans = F.array_sort(F.concat(*(F.col(f"_{n}") for n in range(len(rules)))))
    return found.select("doc_id", "text", "row", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, or chain of overlapping spans, replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = span["start"] - done["at"]
        plain = F.when(gap > 0, text.substr(done["at"] + 1, gap)).otherwise(F.lit(""))
        mark = F.when((gap >= 0), F.lit(MASK)).otherwise(F.lit(""))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], plain, mark).alias("out"))

    return F.aggregate(
        spans, start, step, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = MASK_RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` masked, and n_chars, if there, counted anew for changed texts."""
    found = scan(docs, rules)
    text = F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = found.select("row", F.size("spans").alias("n"), text.alias("new"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("new").alias(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("n") > 0, F.length("new").cast(kind)).otherwise(F.col("row.n_chars")).alias(name)
        return F.col("row").getField(name).alias(name)

    return changed.select(*map(column, docs.columns))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as one string."""
    kinds = F.transform("spans", lambda s: s["kind"])
    others = {rule.kind: F.array_remove(kinds, rule.kind) for rule in BASE_RULES}
    counts = [(F.size(kinds) - F.size(rest)).cast("long").alias(f"n_{kind}") for kind, rest in others.items()]
    base = F.filter("spans", lambda s: s["n"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


__all__ = ["BASE_RULES", "MASK_RULES", "RULES", "Rule", "candidates", "digests", "listed", "masked", "postings", "redact", "scan", "trigram_query"]
