"""The pipeline stage by stage against plain Python, on a small corpus with copies, near copies, personal data and nulls."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from seqlake.llm import ordinal
from seqlake.llm.disclosure import KINDS, base_spans
from seqlake.llm.mixing import mix_report
from seqlake.llm.pieces import model as piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(90):
        w = [r.choice(vocab) for _ in range(r.choice([0, 3, 30, 80]))]
        if i % 9 == 0 and w:
            w.insert(len(w) // 2, r.choice(["ann@mail.example.org", "10.20.30.40", "+49 30 1234567"]))
        rows.append((i, " ".join(w)))
    for i in range(20):
        w = rows[i * 3][1].split()
        if len(w) > 25:
            w[r.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (None, "   "), (None, rows[5][1]), rows[7], rows[7], (301, "junk spam " * 5)]
    return [(i, t, "en", ["a", "b", None][(i or 0) % 3], len(t or "")) for i, t in rows]


def _shingles(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _one_of_each(rows):
    sets = [_shingles(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    best = {}
    for i, row in enumerate(rows):
        key = (row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).digest())
        if sets[i]:
            best[root(i)] = min(best.get(root(i), (key, row)), (key, row), key=lambda x: x[0])
    return Counter([row for _, row in best.values()] + [row for s, row in zip(sets, rows) if not s])


def _hide(text):
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in sorted((a, b, KINDS[k]) for k, a, b in base_spans(text)):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_every_stage(spark, tmp_path):
    rows = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 11 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "SentencePiece encoding and decoding"]

    kept = stage["quality classifier"](spark, docs, str(tmp_path))
    m = ordinal.train(docs, labels)
    w = m.weights.astype(np.float32)
    good = [r for r in rows if m.tails(np.array([float(w[ordinal.features(r[1])].sum(dtype=np.float64))]))[0, -1] >= ordinal.KEEP]
    assert Counter(map(tuple, kept.collect())) == Counter(good) and kept.schema == docs.schema

    every = stage["n-gram Jaccard join"](spark, docs, "")
    assert Counter(map(tuple, every.collect())) == _one_of_each(rows) and every.columns == docs.columns

    hidden = stage["PII"](spark, docs, "")  # too few documents for a term to disclose
    want = Counter((i, _hide(t), lang, s, len(_hide(t) or "") if t is not None else None) for i, t, lang, s, _ in rows)
    assert Counter(map(tuple, hidden.collect())) == want and hidden.columns == docs.columns

    mixed = Counter(r.doc_id for r in stage["mixing sources to target weights"](spark, docs, "").collect())
    taken = Counter()
    for r in mix_report(docs).collect():
        if r.size:
            taken[r.doc_id] += r.taken // r.size
    assert mixed == +taken

    ids = stage["SentencePiece encoding and decoding"](spark, docs, "").collect()
    pieces = piece_model(str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = Counter((i, t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, pieces.decode(r.ids)) for r in ids) == texts
