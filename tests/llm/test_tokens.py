"""op3 against a plain Viterbi, op9 against the tokenizer library document by document; words whose plain hashes meet."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from seqlake.llm import wordhash
from seqlake.llm.pieces import decode, encode
from seqlake.llm.tokenfiles import documents, write

PIECES, WORDS = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("word_bpe_49k.json"))


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


PAIR = _thue_morse(2048), _thue_morse(2048).translate(str.maketrans("ab", "ba"))
r = random.Random(8)
TEXTS = ["", None, " ", "Plain words, twice. Plain words!", "a▁b", "▁", "tab\tand\nlines\r\n", "日本語 emoji 😀 é", "x" * 300,
         PAIR[0] + " " + PAIR[1], PAIR[1], " lead and trail  ", "double  space", "1234567890 3.14", "\x00\x01 odd"]
TEXTS += [" ".join(r.choice(["the", "of", "Zor", "né", "42", "—", "wörd"]) for _ in range(r.randrange(40))) for _ in range(40)]


def _frame(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(4)


def test_long_regular_words_differ():
    data = np.frombuffer((PAIR[0] + PAIR[1]).encode(), np.uint8)
    h = wordhash.span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] != h[1]


def _viterbi(text, model):
    """Best-scored split into pieces, by trying every piece that ends at each place; bytes for what no piece covers."""
    scores = {model.id_to_piece(i).replace("▁", " "): (model.get_score(i), i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    return scores


def test_pieces_decode_to_the_text(spark):
    out = encode(_frame(spark), PIECES)
    got = {x.doc_id: x for x in out.collect()}
    back = {x.doc_id: x.text for x in decode(out.select("doc_id", "ids"), PIECES).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = _viterbi("", model)
    for i, t in enumerate(TEXTS):
        t = t or ""
        assert got[i].n_tokens == len(got[i].ids)
        assert got[i].roundtrip == (back[i] == t) == ("▁" not in t)
        # no other split into pieces scores better: plain dynamic programming over all pieces
        body = " " + t.replace("▁", " ") if t else ""
        if len(body) > 120 or not all(c in vocabulary for c in body):
            continue
        best = [0.0] + [-1e18] * len(body)
        for e in range(1, len(body) + 1):
            for s in range(max(0, e - 32), e):
                if body[s:e] in vocabulary:
                    best[e] = max(best[e], best[s] + vocabulary[body[s:e]][0])
        mine = sum(model.get_score(p) for p in got[i].ids)
        assert abs(mine - best[-1]) < 1e-3 * max(1, len(body)), (t, mine, best[-1])


def test_pieces_edges(spark):
    assert encode(_frame(spark, []), PIECES).count() == 0
    same = encode(_frame(spark, ["a b", "a b", "a b"], [None, 5, 5]), PIECES).collect()
    assert len(same) == 3 and len({tuple(x.ids) for x in same}) == 1


def _library(texts):
    tok = Tokenizer.from_file(WORDS)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_files_equal_the_library(spark):
    got = {x.doc_id: x for x in documents(write(_frame(spark), WORDS)).collect()}
    at = 0
    for i, ids in enumerate(_library(TEXTS)):
        x = got[i]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), TEXTS[i]
        at += len(ids)


def test_files_edges(spark):
    assert documents(write(_frame(spark, []), WORDS)).count() == 0
    texts, ids = ["same words", "same words", "other", None, "same words"], [3, 3, None, 1, None]
    got = documents(write(_frame(spark, texts, ids), WORDS)).collect()
    assert len(got) == 5 and sorted(x.start for x in got)[0] == 0
    ends = sorted((x.start, x.start + x.n_tokens) for x in got)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("name", ["pieces", "files"])
def test_very_long_text(spark, name):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    df = _frame(spark, [long, "short"])
    if name == "pieces":
        assert all(x.roundtrip for x in encode(df, PIECES).collect())
    else:
        got = {x.doc_id: x.n_tokens for x in documents(write(df, WORDS)).collect()}
        assert [got[0], got[1]] == [len(x) for x in _library([long, "short"])]
