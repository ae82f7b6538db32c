"""Literal k-mer / GC / text-rule cases (hand-computed)."""

import pytest
from pyspark.sql import functions as F

from seqlake.functions import sequence as sf
from seqlake.operators import kmers


def _long(spark, seq, mode, k=3):
    df = spark.createDataFrame([("s1", seq)], "sample_id string, sequence string")
    rows = kmers.kmer_counts(df, k=k, mode=mode).collect()
    return {r["kmer"]: (r["kmer_count"], r["total"], r["freq"]) for r in rows}


def test_strip_mode_literal(spark):
    got = _long(spark, "ACNGTacgR", "strip")
    assert {k: v[0] for k, v in got.items()} == {"ACG": 2, "CGT": 1, "GTA": 1, "TAC": 1}
    assert all(v[1] == 5 for v in got.values())
    assert got["ACG"][2] == pytest.approx(0.4)


def test_skip_n_mode_literal(spark):
    got = _long(spark, "ACNGTacgR", "skip_n")
    assert {k: v[0] for k, v in got.items()} == {"GTa": 1, "Tac": 1, "acg": 1, "cgR": 1}
    assert all(v[1] == 4 for v in got.values())


def test_too_short_keeps_zero_row(spark):
    df = spark.createDataFrame([("a", "AC"), ("b", "ACGT")], "sample_id string, sequence string")
    assert _long(spark, "AC", "strip") == {}
    wide = {r["sample_id"]: r for r in kmers.sequence_features(df, k=3).collect()}
    assert sum(wide["a"][f"kmer_{lv}"] for lv in kmers.kmer_levels(3)) == 0.0
    assert wide["b"]["kmer_ACG"] == 0.5 and wide["b"]["kmer_CGT"] == 0.5


def test_long_sequence_chunks_and_long_k(spark):
    seq = "ACGT" * 5000
    got = _long(spark, seq, "strip", k=4)
    assert sum(v[0] for v in got.values()) == len(seq) - 3
    assert set(got) == {"ACGT", "CGTA", "GTAC", "TACG"}


@pytest.mark.parametrize("seq,expected", [("ATCGATCGATCGATCG", 0.5), (None, 0.0), ("", 0.0), ("gcNN", 0.5)])
def test_gc_content(spark, seq, expected):
    df = spark.createDataFrame([(seq,)], "s string")
    assert df.select(sf.gc_content("s")).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("text,expected", [
    ("genotype 1 virus", "DENV-1"),          # pattern 3 also matches inside "genotype"
    ("Dengue virus type 2 isolate", "DENV-2"),
    ("Dengue virus 3, complete genome", "DENV-3"),
    ("DENV-4 strain", "DENV-4"),
    ("Flavivirus sp.", None),
])
def test_serotype_patterns(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sf.infer_serotype("t")).first()[0] == expected


def test_strict_serotype_needs_word_boundary(spark):
    df = spark.createDataFrame([("genotype 1 virus",)], "t string")
    assert df.select(sf.infer_serotype("t", strict=True)).first()[0] is None


def test_year_and_complete(spark):
    df = spark.createDataFrame([("12-Mar-2010", "Dengue virus 1, Complete Genome"), ("2010-03", "x")],
                               "d string, desc string")
    rows = df.select(sf.year_from_date("d").alias("y"), sf.year_from_date("d", "regex").alias("r"),
                     sf.is_complete("desc").alias("c")).collect()
    assert [tuple(r) for r in rows] == [("2010", "2010", True), ("0-03", "2010", False)]


def test_validation_helpers(spark):
    df = spark.createDataFrame([("acg t\nNNX Z",)], "s string")
    c = df.select(sf.clean_sequence("s").alias("c"))
    r = c.select("c", sf.invalid_chars("c").alias("bad"), sf.ambiguous_count("c").alias("amb"),
                 sf.preview("c", 3).alias("p")).first()
    assert r["c"] == "ACGTNNXZ" and r["bad"] == "XZ" and r["amb"] == 2 and r["p"] == "ACG..."


def test_to_numeric(spark):
    df = spark.createDataFrame([("3.5", True), ("abc", False), (None, None)], "a string, b boolean")
    rows = df.select(sf.to_numeric(F.col("a")), sf.to_numeric(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(3.5, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_sparse_kmers_of_an_open_alphabet(spark):
    import random

    from seqlake.operators import kmers

    r = random.Random(3)
    rows = [(f"s{i}", "".join(r.choice("ACGTRYKMNacgé") for _ in range(r.choice([0, 5, 8, 300])))) for i in range(160)] + [("none", None)]
    df = spark.createDataFrame(rows, "sample_id string, sequence string").repartition(3)
    vec, dictionary = kmers.sequence_vectors(df, k=8)
    names = {r["slot"]: r["kmer"] for r in dictionary.collect()}
    assert len(names) > 4096 and sorted(names) == list(range(len(names))) and [names[i] for i in range(len(names))] == sorted(names.values())
    got = {r["sample_id"]: r["kmers"] for r in vec.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, seq in rows:
        windows = [seq[j:j + 8] for j in range(len(seq or "") - 7) if "N" not in seq[j:j + 8]]
        want = {w: windows.count(w) / len(windows) for w in windows}
        assert {names[int(s)]: v for s, v in zip(got[i].indices, got[i].values)} == want and got[i].size == len(names)
    wide = kmers.sequence_features(df, k=8, mode="skip_n")
    assert wide.columns == ["sample_id", "gc_content", "kmers"] and wide.count() == 161
    few = dictionary.where("slot < 50")
    assert all(int(s) < 50 for r in kmers.sequence_vectors(df, k=8, dictionary=few)[0].collect() for s in r["kmers"].indices)
