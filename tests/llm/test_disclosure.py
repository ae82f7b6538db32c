"""op4's terms against the formula over all pairs in Python, single-text entities, and awkward input."""

import math
import random
from collections import Counter, defaultdict

from seqlake.llm.disclosure import PRIOR, THRESHOLD, WORD, base_spans, distinct_texts, report, sanitise, term_spans


def _brute(texts):
    """Disclosing words per distinct text, by the docstring's formula."""
    found = {}
    for x in texts:
        spans = base_spans(x)
        inside = [(a, b) for _, a, b in spans]
        words = {m.group().casefold() for m in WORD.finditer(x) if not any(a < m.end() and m.start() < b for a, b in inside)}
        found[x] = ({f"{k}:{x[a:b]}" for k, a, b in spans}, words)
    n = len(found)
    df = Counter(w for _, words in found.values() for w in words)
    edf = Counter(e for entities, _ in found.values() for e in entities)
    both = Counter((e, w) for entities, words in found.values() for e in entities for w in words)
    out = defaultdict(set)
    for x, (entities, words) in found.items():
        for e in entities:
            for w in words:
                b = both[e, w]
                ic = -math.log2(edf[e] / n)
                if ic > 0 and math.log2(b * n / (edf[e] * (df[w] + PRIOR / b))) >= THRESHOLD * ic - 1e-12:
                    out[x].add(w)
    return out


def _texts(n, seed):
    r = random.Random(seed)
    vocab = [f"word{'abcdefghij'[i % 10]}{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = [vocab[min(int(r.expovariate(0.02)), 299)] for _ in range(r.choice([3, 20, 40]))]
        if r.random() < 0.2:
            e = r.choice([f"user{i % 40}@mail.example.com", "shared@mail.com", "10.1.2.3", f"+49 30 {100000 + i}"])
            w.insert(r.randrange(len(w)), e)
            w += [f"friend{i % 40}"] * (e[0] == "u") + ["sharing"] * (e[0] == "s")
        if r.random() < 0.5:
            w.append(f"rare{i}")
        out.append(" ".join(w))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string").repartition(4)


def test_terms_equal_the_formula(spark):
    texts = _texts(1500, 3)
    rows = list(enumerate(texts)) + [(9000 + i, texts[i]) for i in range(50)]
    want = _brute(set(texts))
    assert sum(map(len, want.values())) > 20
    marks = term_spans(distinct_texts(_frame(spark, rows)))
    by = {r["txt"]: r["terms"] for r in marks.collect()}
    keyed = {r["txt"]: r["text"] for r in _frame(spark, rows).selectExpr("unhex(sha2(cast(text as binary), 256)) as txt", "text").distinct().collect()}
    got = {keyed[k]: {keyed[k][s["s"]:s["e"]].casefold() for s in v} for k, v in by.items() if v}
    assert got == {x: w for x, w in want.items() if w}


def test_entity_of_one_text(spark):
    common = ["the word of many texts and more", "other words of the many texts", "more of the same and other"]
    rows = [(i, f"{common[i % 3]} number {i % 97}") for i in range(1300)] + [(i + 1300, f"{common[i % 3]} seen {i % 89} again {i % 31}") for i in range(1300)]
    rows += [(5000, "the many words Quexil and more Quexil jane@mail.org of other texts"), (5001, "the words of Ombrefal more")]
    out = {r.doc_id: r.spans for r in report(_frame(spark, rows)).collect()}
    text = rows[-2][1]
    a, b = text.index("Quexil"), text.rindex("Quexil")
    assert f"term:{a}:{a + 6},term:{b}:{b + 6}" in out[5000] and out[5000].count("term") == 2
    assert out[5001] == "" and not any("term" in s for i, s in out.items() if i != 5000)
    clean = {r.doc_id: r.text for r in sanitise(_frame(spark, rows[-200:] + rows[:2400])).collect()}
    assert clean[5000] == "the many words [TERM] and more [TERM] [EMAIL] of other texts" and clean[5001] == rows[-1][1]


def test_clashing_and_odd_columns_stay(spark):
    df = spark.createDataFrame(
        [(1, "mail a@b.org now", "x", [1], {"k": 2}, 16), (None, None, "y", None, None, None), (1, "", "z", [], {}, 0)],
        "doc_id long, text string, _terms string, txt array<int>, `r.z` map<string,int>, n_chars int")
    out = {r["_terms"]: r for r in sanitise(df).collect()}
    assert out["x"]["text"] == "mail [EMAIL] now" and out["x"]["n_chars"] == 16 and out["x"]["txt"] == [1] and out["x"]["r.z"] == {"k": 2}
    assert out["y"]["text"] is None and out["z"]["text"] == "" and sanitise(df).columns == df.columns
    assert {r.doc_id: r.spans for r in report(df).collect()}[None] == ""


def test_empty_and_very_long(spark):
    assert report(_frame(spark, [])).count() == 0 and sanitise(_frame(spark, [])).count() == 0
    long = "a@b.org " + "word " * 400_000 + "+49 30 123456"
    r = report(_frame(spark, [(1, long), (2, long), (2, long)])).collect()
    assert len(r) == 3 and all(x.n_email == 1 and x.n_phone == 1 and x.spans.endswith(f":{len(long)}") for x in r)
