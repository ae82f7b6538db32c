"""op11 against a plain walk over all windows of all documents."""

import hashlib
import random
import re

import pytest

from seqlake.llm import repeats
from seqlake.llm.repeats import confirm, dedup_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(rows):
    """``[(doc_id, n_words, n_removed, sha)]``; the order of documents is (id, nulls first; digest of the words)."""
    docs = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        docs.append((doc, w, hashlib.sha256(" ".join(w).encode()).digest()))
    order = sorted({(d is not None, d or 0, s) for d, _, s in docs})
    seen, kept = set(), {}
    words = {(d is not None, d or 0, s): w for d, w, s in docs}
    for key in order:
        w = words[key]
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            x = tuple(w[i:i + 20])
            if x in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(x)
        kept[key] = [a for a, g in zip(w, gone) if not g]
    out = []
    for d, w, s in docs:
        k = kept[(d is not None, d or 0, s)]
        out.append((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ü,", "日本", "A", "a", "​x"]
    words = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [words(r.choice([20, 21, 25, 60, 200])) for _ in range(8)]
    made = []
    for i in range(n):
        w = []
        for _ in range(r.randrange(4)):
            w += words(r.choice([0, 3, 19, 40]))
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randrange(max(1, len(p) - 22))
                w += p[a:] if r.random() < 0.5 else p
        if r.random() < 0.05:
            w += ["same"] * r.choice([19, 20, 70])
        made.append((i * 7 % n, r.choice([" ", "  ", "\n", "\t "]).join(w) if w else r.choice([None, "", " \n"])))
    made += [(None, made[3][1]), (None, made[4][1]), made[5], made[5], (made[6][0], made[9][1]), (n + 5, made[11][1])]
    return made


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_words int, digest string")


def _got(df):
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_plain_walk(spark, seed):
    rows = _rows(seed)
    got = _got(dedup_report(_frame(spark, rows).repartition(5)))
    assert got == _brute(rows)
    assert sum(r[2] for r in got) > 500


def test_hot_seeds_are_salted(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 7)
    monkeypatch.setattr(repeats, "SHARD", 3)
    rows = _rows(3) + [(500 + i, " ".join(["x"] * (20 + i % 30))) for i in range(40)]
    assert _got(dedup_report(_frame(spark, rows).repartition(6))) == _brute(rows)


def test_edges(spark):
    assert dedup_report(_frame(spark, [])).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert _got(dedup_report(_frame(spark, [(1, None), (2, " ")]))) == [(1, 0, 0, nothing), (2, 0, 0, nothing)]
    tie = [(1, " ".join(f"a{i}" for i in range(19)))] * 2
    assert all(r[2] == 0 for r in _got(dedup_report(_frame(spark, tie))))


def test_very_long_text(spark):
    r = random.Random(4)
    w = [f"v{r.randrange(5000)}" for _ in range(60_000)]
    rows = [(2, " ".join(w)), (1, " ".join(w[30_000:31_000])), (3, " ".join(w[59_000:] + w[:1000]))]
    assert _got(dedup_report(_frame(spark, rows))) == _brute(rows)


def test_shard_locates_each_occurrence():
    w = [f"{i}".encode() for i in range(30)]
    shard, numbers = confirm([(5, 0, 11, w), (9, 3, 6, w[5:30])])
    assert shard.size == 6
    assert shard.repeats(numbers[0], 5, 0) == [] and shard.repeats(numbers[1], 9, 3) == [(3, 28)]


def test_equal_windows_of_a_hot_seed_are_merged_in_their_task(spark):
    line = ["is", "onhe."] * 400
    rows = [(7, 900, no, at, 2, " ".join(line[at:at + 21]).encode()) for no in range(30) for at in range(0, 60, 2)]
    hot = spark.createDataFrame(rows, "h long, n long, no long, at int, m int, words binary").repartition(3)
    assert repeats._hot_windows(hot).count() <= 2 * 3  # two distinct windows, three tasks
    found = sorted((r.h, r.n, r.no, r["at"], bytes(r.words).split()[0]) for r in repeats._hot_phrases(hot).collect())
    assert found == [(7, 900, 0, 0, b"is"), (7, 900, 0, 1, b"onhe.")]
    once = hot.where("no = 3 and at = 4")  # windows that come once are no phrases
    assert repeats._hot_windows(once).count() == 2 and repeats._hot_phrases(once).count() == 0


def test_hot_windows_are_right_when_a_task_sends_them_on_early(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HELD", 1)
    monkeypatch.setattr(repeats, "HOT", 3)
    line = " ".join(["is", "onhe."] * 40)
    rows = [(i, f"{line} {i}") for i in range(12)]
    got = dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == _brute(rows)
