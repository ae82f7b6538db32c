"""op2 against a plain version: order, edited texts, votes bit by bit, and the search by brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from seqlake.llm.simhash import fingerprint_report


def _print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    votes = [0] * 64
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def _edit(t, o):
    h = len(t) // 2
    return t[:len(t) - h] + o[:h]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "q", 5) for i, t in rows], "doc_id long, text string, fingerprint string, n int").repartition(4)


def _rows(seed):
    r = random.Random(seed)
    words = ["The", "of", "Ünder", "日本", "x" * 80, "a-b", "3.5", "stop"] + [f"w{i}" for i in range(30)]
    rows = [(i * 13 % 301, r.choice([" ", "\n", "\t"]).join(r.choice(words) for _ in range(r.choice([0, 1, 2, 9, 60])))) for i in range(200)]
    return rows + [(400, None), (500, ""), (600, "one two three"), (601, "one  two THREE")]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_plain_version(spark, seed):
    rows = _rows(seed)
    got = {r.doc_id: r for r in fingerprint_report(_frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    prints = {i: _print(t or "") for i, t in rows}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)]
        e = _edit(t, nxt[1] or "")
        g = got[i]
        assert (g.n_chars, g.edited_sha256, g.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), "%016x" % prints[i])
        assert g.edited_fingerprint == "%016x" % _print(e)
        same = lambda a, b: 1 - bin(a ^ b).count("1") / 64
        assert g.near_edited == same(prints[i], _print(e)) and g.near_next == same(prints[i], prints[nxt[0]])
        near = len({p for p in prints.values() if p != prints[i] and bin(p ^ prints[i]).count("1") <= 3})
        assert g.n_near == (near if i % 100 == 0 else None)


def test_equal_rows_ids_and_nulls(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "x y z w"), (None, "n o p q"), (None, "n o p q"), (2, "k l m n"), (2, None)]
    got = fingerprint_report(_frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    own = [r for r in got if r.fingerprint == "%016x" % _print("a b c d")]
    self_edit = hashlib.sha256(_edit("a b c d", "a b c d").encode()).hexdigest()
    assert len(own) == 3 and sum(r.edited_sha256 == self_edit for r in own) == 2 and sum(r.near_next == 1.0 for r in own) >= 2


def test_edges(spark):
    assert fingerprint_report(_frame(spark, [])).count() == 0
    one = fingerprint_report(_frame(spark, [(7, "a b c d e")])).first()
    assert one.edited_sha256 == hashlib.sha256(_edit("a b c d e", "a b c d e").encode()).hexdigest() and one.near_next == 1.0


def test_plan_has_no_python_stage(spark):
    plan = fingerprint_report(_frame(spark, _rows(3)))._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in ("Python", "MapInArrow", "MapInPandas"))
