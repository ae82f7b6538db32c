"""op12 against a plain search over edits, row by row in Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from seqlake.llm.turnrepair import SuffixAutomaton, damage_report, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
COLUMNS = "conv_id long, turn long, role string, text string, c string, copy2 long"


def _damage(rows):
    sp = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        for _ in range(2 if k == 3 else 1):
            yield conv, turn, role, text


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not WORD.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if WORD.findall(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Dijkstra over (row, grammar state), smallest (cost, audit) first."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if r in steps[state]:
                role = {"u": "user", "a": "assistant"}[r]
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, made + ((role, ""),)))
                if i < len(rows) and faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] else 0
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r, made + ((role, rows[i][2]),)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, made))
            first = rows[i][1][:1]
            if first and first in steps[state] and faults[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + (5 if faults[i] else 0), audit + "K", i + 1, first, made + (rows[i][1:],)))
    raise AssertionError


def _brute(rows):
    out = {}
    hurt = list(_damage(rows))
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in hurt if r[0] == conv]
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(b"\x01".join((r[1].encode().hex().upper().encode(), r[2].encode()))).digest())
        mine.sort(key=key)
        faults = _faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, made = _cheapest(mine, faults)
        pairs = [mine[i][1][:1] + mine[i + 1][1][:1] for i in range(len(mine) - 1)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                     faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest())
    return out


def _conversations(seed, n=150):
    r = random.Random(seed)
    for conv in range(n):
        roles = [r.choice(["user", "assistant", "system", "tool", "", None, "User"]) for _ in range(3)]
        for turn in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            role = r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "done. \n", " ", "", None, "é ü.", f"line {r.randrange(9)}."])
            at = None if r.random() < 0.05 else turn + r.randrange(2) * 3
            yield (None if conv == 7 else conv, at, role, text)
            if r.random() < 0.05:
                yield (None if conv == 7 else conv, at, role, text)


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_plain_search(spark, seed):
    rows = list(_conversations(seed))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS).repartition(4)
    got = damage_report(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == _brute(rows)


def test_long_conversation_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["a.", "b", f"t{t}.", "c!"])) for t in range(4000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(50)]
    got = damage_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9))
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == _brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert damage_report(empty).count() == 0
    gone = next(t for t in range(99) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    one = damage_report(spark.createDataFrame([("1", gone, "user", "hi.")], empty.schema)).first()
    assert tuple(one) == ("1", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "Still there?"), (1, 3, "user", "")],
                               "conv_id long, turn long, role string, text string")
    report, turns = repair(df)
    assert report.first()["audit"] == "KRD"
    assert [tuple(t) for t in turns.orderBy("place").collect()] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Still there?")]


def test_endings_are_built_once():
    sigs = sorted({"".join(random.Random(i).choices("uaUAsox", k=i % 7)) for i in range(400)}, key=lambda s: s[::-1])
    a = SuffixAutomaton()
    for s in sigs:
        a.move_to(s)
    assert a.built == len({s[i:] for s in sigs for i in range(len(s))})
