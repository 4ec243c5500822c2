"""Conversation repair against a plain dynamic programme over the whole lattice."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from corpuspulse.llm import conversations as C

SF = "/root/testdata/sf0.01"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
CODES = {"": C.OK, "truncated": C.CUT_OFF, "blank": C.BLANK, "duplicate": C.REPEATED}


def best_path(messages):
    """Least ``(cost, audit, lines)``: for every message and written role, the best of all ways there."""
    def put(layer, state, way):
        if state not in layer or way[:2] < layer[state][:2]:
            layer[state] = way

    def with_inserts(layer):
        for _ in range(4):
            grown = dict(layer)
            for state, (cost, audit, lines) in layer.items():
                put(grown, NEXT[state], (cost + 2, audit + "I", [*lines, f"{ROLE[NEXT[state]]}:"]))
            layer = grown
        return layer

    layer = with_inserts({"": (0, "", [])})
    for role, text, fault in messages:
        after: dict = {}
        for state, (cost, audit, lines) in layer.items():
            put(after, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            if role[:1] == "s" and state == "":
                put(after, "s", (more, audit + "K", [*lines, f"{role}:{text}"]))
            if role[:1] == NEXT[state]:
                put(after, NEXT[state], (more, audit + "K", [*lines, f"{role}:{text}"]))
            put(after, NEXT[state], (more + 2, audit + "R", [*lines, f"{ROLE[NEXT[state]]}:{text}"]))
        layer = with_inserts(after)
    return min((layer[e] for e in ("", "a") if e in layer), key=lambda w: w[:2])


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, messages in by.items():
        after = []
        for turn, role, text in sorted(messages, key=lambda m: (m[0] is not None, m[0] or 0)):
            at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
            after += [(turn, "user" if at == 4 else role, text)] * (0 if at == 0 else 2 if at == 3 else 1)
        seen, marked = set(), []
        for _turn, role, text in after:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _r, _x in after if t is not None]
        initials = [r[:1] for r, _x, _f in marked]
        faults = [f for _r, _x, f in marked]
        cost, audit, lines = best_path(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string")
    plain = C.as_rows(df)
    return {r.conv: tuple(r)[1:] for r in C.repair_conversations(C.damaged(plain), plain).collect()}


def test_search_takes_the_least_audit_of_the_cheapest(monkeypatch):
    rng = random.Random(5)
    cases = [[(rng.choice(["user", "assistant", "system", "", "x"]), "t", rng.choice(["", "", "truncated", "blank", "duplicate"]))
              for _ in range(rng.randint(0, 12))] for _ in range(1500)]
    want = [best_path(m)[:2] for m in cases]
    marks = [[(r[:1], CODES[f]) for r, _t, f in m] for m in cases]
    assert [C.cheapest(m, C.NOTHING, C.ENDS) for m in marks] == want
    monkeypatch.setattr(C, "CHUNK", 3)   # the same in pieces, composed
    assert [C.whole(m) for m in marks] == want


def awkward():
    rng = random.Random(2)
    say = ["Hello there.", "Is it so?", "no end", "", " \t", None, "Hello there.", "x" * 50_000 + "!"]
    roles = ["user", "assistant", "system", "tool", "", None, "ufo"]
    rows = [(c, t, rng.choice(roles), rng.choice(say)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", f"null {t}.") for t in range(5)] + [(50, None, "user", "no turn."), (50, 3, "assistant", "three."), (50, 9, "user", "nine.")]
    # A conversation whose only message is dropped, one of very many messages, one with equal rows.
    dropped = next(c for c in range(60, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")] + [(300, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 700}.") for t in range(1500)]
    return rows + [(301, 0, "user", "same."), (301, 0, "user", "same."), (301, 1, "assistant", "yes.")]


def test_awkward_conversations_by_brute_force(spark):
    rows = awkward()
    assert repaired(spark, rows) == expected(rows)
    assert repaired(spark, []) == {}


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """Ranges of a few messages: a conversation is composed from many tables, and faults reach across ranges."""
    monkeypatch.setattr(C, "RANGE_BYTES", 300)
    rng = random.Random(8)
    rows = [(1, t // 2 * 2, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two.", "open", "Long one here."]) + str(t % 40) + ".") for t in range(0, 240)]
    rows = [(c, t * (c + 1), r, x) for c in (1, 2) for _c, t, r, x in rows if rng.random() < 0.7]
    one_per_turn = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    rows = list(one_per_turn.values()) + [(5, 0, "user", "a."), (6, 0, "user", "b.")]
    plain = C.as_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert C._sorted_ranges(plain).rdd.getNumPartitions() > 20
    assert repaired(spark, rows) == expected(rows)


def test_repaired_messages_are_legal_and_hash_to_the_report(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = C.damaged(C.as_rows(df))
    got = defaultdict(list)
    for m in C.replayed(plain, *C.plan_repairs(plain)).collect():
        got[m.conv].append((m.place, m.role, m.text))
    want = expected(rows)
    for conv, messages in got.items():
        messages.sort()
        assert [p for p, _r, _t in messages] == list(range(len(messages)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _p, r, _t in messages))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _p, r, t in messages).encode()).hexdigest() == want[conv][-1]
    assert all(not want[c][6].strip("D") for c in set(want) - set(got))


@pytest.mark.parametrize("sf", [SF])
def test_the_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = entry.queries()["op11_conversation_repair"](spark, sf)
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == expected(rows)
