"""Repair of conversations against a plain search over all cheapest edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import conversation_repair as cr
from plumbline.llm.queries import op11_conversation_repair

SCHEMA = "turn long, text string, conv_id long, role string, segment long, kind string, pos int"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, audit, repaired rows) with all cheapest ways that may come first; rows are (role, text, fault)."""

    def better(ways, state, cost, audit, out):
        if state not in ways or cost < ways[state][0]:
            ways[state] = (cost, {audit: out})
        elif cost == ways[state][0]:
            ways[state][1][audit] = out

    def with_inserts(ways):
        for _ in range(2):
            for state, (cost, audits) in list(ways.items()):
                for to, role in (("u", "user"), ("a", "assistant")):
                    if (state, to) in STEP:
                        for audit, out in list(audits.items()):
                            better(ways, STEP[state, to], cost + 2, audit + "I", (*out, (role, "")))
        return ways

    ways = with_inserts({"": (0, {"": ()})})
    for role, text, fault in rows:
        following = {}
        for state, (cost, audits) in ways.items():
            for audit, out in audits.items():
                better(following, state, cost + 3, audit + "D", out)
                if fault in ("blank", "duplicate"):
                    continue
                more = cost + (fault == "truncated")
                if (state, role[:1]) in STEP:
                    better(following, STEP[state, role[:1]], more, audit + "K", (*out, (role, text)))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (state, to) in STEP:
                        better(following, STEP[state, to], more + 2, audit + "R", (*out, (name, text)))
        ways = with_inserts(following)
        for state, (least, audits) in ways.items():
            # An audit that differs from a smaller one before that one ends stays larger whatever follows.
            ways[state] = (least, {a: o for a, o in audits.items() if a.startswith(min(audits))})
    cost = min(ways[s][0] for s in ("", "a") if s in ways)
    audits = {a: o for s in ("", "a") if s in ways and ways[s][0] == cost for a, o in ways[s][1].items()}
    return cost, min(audits), audits[min(audits)]


def place(row):
    """Rows of one turn go by the beginnings of role and text, then by a digest."""
    there, turn, role, text = row
    return there, turn, role[:64], text[:64], hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        kept[conv].append((turn is not None, turn or 0, role, text))
    found = Counter()
    for conv in {r[0] for r in rows}:
        own, seen, faults = sorted(kept[conv], key=place), set(), []
        for _, _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "ok" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for there, t, _, _ in own if there}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, out = cheapest([(r[2], r[3], f) for r, f in zip(own, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        n = Counter(faults)
        found[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest] += 1
    return found


def made_up():
    pick = random.Random(5)
    rows = []
    for conv in range(150):
        for turn in range(pick.randint(1, 9)):
            role = pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "User"])
            text = pick.choice(["Hello.", "yes", "no", "What?", " ", "", None, "Fine!\n ", "a.\x0b", "\x85", "é "]) if turn % 3 else f"row {turn}."
            rows.append((conv, turn if pick.random() < 0.9 else None, role, text))
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 9, None, None)]
    rows += [(900, 0, "user", "same row.")] * 25 + [(901, None, "tool", "x")] * 3
    rows += [(902, n % 400, pick.choice(["user", "assistant"]), f"turn {n % 390}" + pick.choice([".", ""])) for n in range(900)]
    rows += [(903, 5, "user", "very long. " * 30_000), (903, 6, "assistant", "b" * 70 + "2."), (903, 6, "assistant", "b" * 70 + "1")]
    dropped = [n for n in range(2000, 2400) if zlib.crc32(f"{n}:1".encode()) % 20 == 0]
    return rows + [(n, 1, "user", "gone.") for n in dropped[:3]]


@pytest.mark.parametrize("bits", [0, 2, cr.SEGMENT_BITS])
def test_against_search(spark, tmp_path, monkeypatch, bits):
    """Also with segments of one row and of four."""
    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
    rows = made_up()
    given = [(turn, text, conv, role, 1, "k", 2) for conv, turn, role, text in rows]
    spark.createDataFrame(given, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    made = op11_conversation_repair(spark, str(tmp_path))
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, expected = Counter(tuple(r) for r in made.collect()), plain(rows)
    assert not got - expected and not expected - got


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversation_repair(spark, str(tmp_path)).count() == 0


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B"), (2, 0, "user", "only.")]
    repair = cr.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = defaultdict(list)
    for row in repair.turns().collect():
        turns[row.conv_id].append((row.edit, row.role, row.text))
    assert turns[2] == [("K", "user", "only."), ("I", "assistant", "")]
    assert turns[1] == [("K", "system", "S."), ("R", "user", "A."), ("K", "assistant", "B")]


def test_rules_change_nothing():
    """Matrices of compressed sequences are those of the sequences themselves, with the same letters."""
    pick = random.Random(3)
    plain_grammar = cr.Grammar([])
    rules = [(chr(0xE000), "A", "E"), (chr(0xE001), chr(0xE000), "I"), (chr(0xE002), "E", "I"), (chr(0xE003), chr(0xE002), chr(0xE002)), (chr(0xE004), "N", "N")]
    grammar = cr.Grammar(rules)
    for _ in range(200):
        told = "".join(pick.choice("AEIEIEIJFMNCN") for _ in range(pick.randint(1, 14)))
        short = grammar.compress([told])[0]
        one, two = plain_grammar.fold(told)[-1], grammar.fold(short)[-1]
        assert one.cost == two.cost
        for entry in range(16):
            if one.cost[entry] < 1 << 50:
                assert plain_grammar.audit(told, entry // 4, entry % 4) == grammar.audit(short, entry // 4, entry % 4)


def test_grammar_is_learned_over_all_rows(spark):
    found = cr.learn_grammar(spark.createDataFrame([("AEIEIEI", 50), ("EIEI", 30), ("AEIEI", 1), ("P", 9)], "symbols string, n long"))
    assert (chr(0xE000), "E", "I") in found.rules and all(len(s) <= 2 for s in found.compress(["EIEI", "EIEIEIEI"]))
