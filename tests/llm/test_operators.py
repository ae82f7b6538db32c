import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

BASE = [f"w{i}" for i in range(60)]


def _rows():
    near = list(BASE)
    near[30] = "changed"
    return [(1, " ".join(BASE), "a"), (2, " ".join(BASE).upper(), "a"), (3, " ".join(near), "b"), (4, None, "b"),
            (5, "", None), (6, "   \n", "c"), (7, "one two", "c"), (8, "One\ttwo", "c"), (9, "one two three", "c"),
            (10, " ".join(f"z{i}" for i in range(30_000)), "a"), (10, " ".join(BASE), "a"), (None, "no id here at all", "a")]


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def _components(sets, linked):
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_jaccard_groups_equal_brute_force(spark, docs_of):
    from seqlake.llm.jaccardjoin import groups

    rows = _rows()
    for k in range(20):  # chained edits: neighbours link, the ends do not
        w = [f"c{i}" for i in range(80)]
        w[:k * 4] = [f"d{i}" for i in range(k * 4)]
        rows.append((100 + k, " ".join(w), "a"))
    sets = [_set(t) for _, t, _ in rows]
    g = _components(sets, lambda x, y: len(x & y) and 100 * len(x & y) >= 75 * len(x | y))
    low = {}
    for (i, _, _), k in zip(rows, g):
        low[k] = min(x for x in (low.get(k), i) if x is not None) if (low.get(k), i) != (None, None) else None
    want = Counter((i, len(s), low[k]) for (i, _, _), s, k in zip(rows, sets, g))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in groups(docs_of(rows)).collect())
    assert got == want
    assert groups(docs_of(rows).limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark, docs_of):
    from seqlake.llm.jaccardjoin import keep_one

    kept = sorted(r.doc_id for r in keep_one(docs_of([r for r in _rows() if r[0] is not None and r[0] < 10])).collect())
    assert kept == [1, 4, 5, 6, 7, 9]


def test_unrelated_texts_of_one_id_stay(spark, docs_of):
    from seqlake.llm.jaccardjoin import keep_one

    rows = _rows() + [(None, "another text of a null id", "b"), (None, " ".join(BASE), "c"), (None, "no id HERE at all", "c"),
                      (10, "a second text of id ten", "b"), (10, "a second text of id ten", "b"), (4, None, "b"), (None, "", "a")]
    kept = Counter((r.doc_id, r.text) for r in keep_one(docs_of(rows)).collect())
    want = Counter((i, t) for i, t, _ in rows if i in (1, 4, 5, 6, 7, 9))
    want += Counter([(10, rows[9][1]), (10, "a second text of id ten"), (None, "another text of a null id"), (None, "")])
    alike = {k for k in kept if k[1] and k[1].lower() == "no id here at all"}
    assert len(alike) == 1 and kept == want + Counter(alike)


def test_words_of_a_huge_text_equal_brute_force():
    import pyarrow as pa

    from seqlake.llm import wordhash

    w = [f"{i % 20_000}".rjust(800, "x") for i in range(21_500)]
    huge = " ".join(w)
    assert len(huge) > 16 << 20
    hashed = []
    for text in (huge, " ".join(w[:20])):
        (_, _, data, off), = wordhash.runs(pa.array([text]))
        h, bounds, _, _ = wordhash.words(data, off)
        hashed.append((h, next(wordhash.shingles(h, bounds))))
    assert len(hashed[0][1]) == len(_set(huge)) and len(np.unique(hashed[0][0])) == 20_000
    assert (hashed[0][0][:20] == hashed[1][0]).all() and (hashed[0][0][20_000:] == hashed[0][0][:1_500]).all()
    assert np.isin(hashed[1][1], hashed[0][1]).all()


def test_near_vectors_equal_brute_force(spark):
    from seqlake.llm.pstable import near_duplicates

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = np.repeat(centres, 8, axis=0) + 0.1 * rng.standard_normal((160, 16))
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)] + [
        (200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, [1.0, 2.0])]
    rows += [(300 + i, rows[0][1]) for i in range(5)]
    df = spark.createDataFrame([(i, v, "e") for i, v in rows], "vec_id long, embedding array<float>, c string")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([v / np.linalg.norm(v) for _, v in good])
    links = (m @ m.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i, _ in good])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 206))
    assert got[300].component_id == 0 and not got[300].kept


def test_fingerprints_follow_the_contract(spark, docs_of):
    from seqlake.llm.simhash import fingerprint_report, near_pairs

    rows = [r for r in _rows() if r[0] is not None][:10]
    out = {r.doc_id: r for r in fingerprint_report(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        t, o = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + o[:h]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= out[i].near_next <= 1 and len(out[i].fingerprint) == 16
    assert out[1].fingerprint == out[2].fingerprint and out[4].fingerprint == "0" * 16
    fps = ["%016x" % v for v in (0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 7)]
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint string")
    want = {(a, b) for a in fps for b in fps if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    assert {(r.query, r.fingerprint) for r in near_pairs(df, df).collect()} == want


def test_long_text_votes_are_exact(spark):
    from seqlake.llm.simhash import fingerprints

    text = "a b " * 700_000 + "c d"
    df = spark.createDataFrame([(1, text), (2, "a b " * 20 + "c d")], "k int, text string")
    assert len({r.fingerprint for r in fingerprints(df, ["k"]).collect()}) == 1


@pytest.mark.parametrize("text,kinds", [
    ("mail a@b.c_d@e.fr now", [0, 0]), ("x@y z", []), ("at 1.2.3.4.5 or 1.2.3.256", [1]),
    ("card 4111 1111 1111 1111!", [2]), ("card 4111 1111 1111 1112", []), ("call +49 (30) 123456.", [3]),
    ("9" * 5000 + ".1.1.1", []), (None, []), ("", [])])
def test_base_spans(text, kinds):
    from seqlake.llm.disclosure import base_spans

    assert [k for k, _, _ in base_spans(text or "")] == kinds


def test_disclosing_terms_are_found_and_removed(spark, docs_of):
    from seqlake.llm.disclosure import report, sanitise

    rows = [(i, f"common words number {'abcdefghij'[i % 10]} about Zorblax owner bob@mail.com write soon", "a") for i in range(5)]
    rows += [(100 + i, f"common words number about write soon owner {i} of other things kind{i}", "a") for i in range(200)]
    rows += [(900, None, "b"), (901, "", "b")]
    out = {r.doc_id: r for r in report(docs_of(rows)).collect()}
    at = rows[0][1].index("Zorblax")
    assert out[0].n_email == 1 and f"term:{at}:{at + 7}" in out[0].spans and out[0].spans.count("term") == 1
    start = rows[0][1].index("bob@")
    assert out[0].base_sha256 == hashlib.sha256(f"email:{start}:{start + 12}".encode()).hexdigest()
    assert out[900].spans == "" and out[100].spans == ""
    clean = {r.doc_id: r.text for r in sanitise(docs_of(rows)).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "Zorblax" not in clean[0]
    assert clean[900] is None and clean[100] == rows[5][1] and len(clean) == len(rows)


def test_copies_do_not_hide_a_disclosing_term(spark, docs_of):
    from seqlake.llm.disclosure import report, sanitise

    rows = [(i, f"common words about Zorblax owner bob@mail.com write soon part{i}", "a") for i in range(4)]
    rows += [(1000 + i, rows[0][1], "a") for i in range(300)]
    rows += [(2000 + i, f"common words about write soon owner {i} of other things kind{i}", "a") for i in range(200)]
    out = {r.doc_id: r.spans for r in report(docs_of(rows)).collect()}
    at = rows[0][1].index("Zorblax")
    assert len(out) == len(rows) and all(f"term:{at}:{at + 7}" in s for i, s in out.items() if i < 2000)
    assert not any("Zorblax" in r.text for r in sanitise(docs_of(rows)).collect())


def test_terms_anywhere_in_a_text_with_their_entity(spark, docs_of):
    from seqlake.llm.disclosure import report, sanitise

    filler = " ".join(f"common{'abcdefghijklmnopqrst'[k]} words" for k in range(20))
    rows = [(i, f"File Qvex77 opened {filler} owner bob@mail.com write {filler} signed user4711 for QVEX77 part{i}", "a") for i in range(4)]
    rows += [(50, "user4711 in a text without the address", "b"), (None, rows[0][1], "c")]
    rows += [(100 + i, f"file opened {filler} owner write signed for part kind{i}", "a") for i in range(200)]
    out = Counter((r.doc_id, r.spans) for r in report(docs_of(rows)).collect())
    want = Counter()
    for i, t, _ in rows:
        found = [("email", *m.span()) for m in re.finditer(r"bob@mail\.com", t)]
        found += [("term", *m.span()) for m in re.finditer(r"(?i)qvex77|user4711", t) if found]
        want[(i, ",".join(f"{k}:{a}:{b}" for k, a, b in found))] += 1
    assert out == want
    clean = [r.text for r in sanitise(docs_of(rows)).filter("doc_id < 50 or doc_id is null").collect()]
    assert len(clean) == 5 and all(t.count("[TERM]") == 3 and t.count("[EMAIL]") == 1 for t in clean)


def test_ordinal_grades_held_out(spark):
    from seqlake.llm.ordinal import keep, quality_report

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    r = quality_report(docs, labels.filter(half == 0)).join(labels.filter(half == 1), "doc_id")
    got = {(x.quality, x.toxic): x.k for x in r.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert got[1, 0] > 0.9 and got[0, 0] < 0.5 and got[1, 1] < 0.6  # one label in twenty is wrong by design
    few = docs.limit(5).withColumn("tails", F.lit("x"))
    assert keep(few, labels.limit(0)).count() == 5
    assert keep(few.limit(0), labels).count() == 0


def test_mix_follows_targets(spark, docs_of):
    from seqlake.llm.mixing import mix, mix_report

    rows = [(i, " ".join(["w"] * (1 + i % 9)), "abc"[i % 3] if i % 4 else None) for i in range(400)] + [(999, None, "a")]
    r = mix_report(docs_of(rows)).collect()
    per = {}
    for x in r:
        s = per.setdefault(x.source, [0, x.target, x.source_size])
        s[0] += x.taken
        assert x.taken <= 3 * x.size
    assert all(abs(t - target) <= 20 and target <= 3 * size + 1e-6 for t, target, size in per.values())
    assert Counter(x.doc_id for x in mix(docs_of(rows)).collect()) == Counter(
        {x.doc_id: x.taken // x.size for x in r if x.taken})
    assert mix_report(docs_of(rows).limit(0)).count() == 0


def test_shards_and_tokens(spark, docs_of):
    from seqlake.llm.hilbert import shard_report
    from seqlake.llm.pieces import decode, encode
    from seqlake.llm.queries import tokenizer_file

    rows = [r for r in _rows() if r[0] is not None]
    docs = docs_of(rows).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    shards = shard_report(docs).collect()
    assert len(shards) == len(rows) and all(0 <= s.shard < 16 for s in shards)
    assert sorted(s.text_crc32 for s in shards) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows)
    path = tokenizer_file(spark, "piece_bpe_32k.model")
    ids = encode(docs, path)
    back = Counter((r.doc_id, r.text) for r in decode(ids, path).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows) and all(r.roundtrip for r in ids.collect())


def test_main_text_of_pages(spark):
    from seqlake.llm.htmltext import extract

    body = "".join(f"<p>Sentence {i} of the article, long enough to count as prose, with commas and more words.</p>" for i in range(8))
    html = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{body}</article><footer>Imprint</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html, 0), (2, "u", None, 0), (3, "u", "", 0)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in extract(df).collect()}
    assert out[1].text.count("Sentence") == 8 and "Home" not in out[1].text and "Imprint" not in out[1].text
    assert out[1].n_chars == len(out[1].text) and out[2].text == "" and out[3].n_chars == 0


def test_all_sections_of_an_article_come_out():
    from seqlake.llm.htmltext import main_text

    def prose(name, n):
        return "".join(f"<p>{name} {i} of the text, long enough to count as prose, with commas and more words.</p>" for i in range(n))

    menu = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul>"
    lead = f"{menu}<div class=content><h1>The title</h1><div class=lead>{prose('Lead', 1)}</div><div class=text>{prose('Body', 9)}</div></div>"
    text = main_text(lead)
    assert text.startswith("The title\n\nLead 0") and text.count("Body") == 9 and "Home" not in text
    for tag in ("div", "article", "section"):
        text = main_text(f"{menu}<div><{tag}>{prose('First', 9)}</{tag}><{tag}>{prose('Second', 3)}</{tag}></div>")
        assert text.count("First") == 9 and text.count("Second") == 3
    assert main_text(f"{menu}<div class='notice reply'>{prose('Hinted', 9)}</div>").count("Hinted") == 9
    text = main_text(f"<div>{prose('Body', 9)}<div class=share>Share this</div>{prose('More', 3)}</div>")
    assert text.count("Body") == 9 and text.count("More") == 3 and "Share" not in text
    assert main_text(f"<div><h1>The title</h1><div>{prose('Body', 9)}</div></div>").startswith("The title")


def test_shard_files_hold_every_row_once(spark, tmp_path):
    from seqlake.llm.hilbert import write_shards

    rows = [(i % 5 or None, f"text {i % 7}" if i % 3 else None, "en", "a" if i % 2 else None) for i in range(50)] + [(1, "text 1", "en", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    write_shards(df, str(tmp_path / "shards"), 4)
    out = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in out) == Counter(rows)
    for k in range(4):
        slots = sorted(r.slot for r in out if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (13, 14)


def test_pipeline_keeps_columns_and_counts(spark):
    from corpus_pipeline import STAGES, run

    assert len(STAGES) == 5
    out = run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r.roundtrip for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 3
