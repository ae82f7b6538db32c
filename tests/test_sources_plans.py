"""Ingest, persistence and the composite plans."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.sources import genbank, persist, text
from seqlake.sources.tables import load_table_set, write_table

GB = """LOCUS       AB000001 20 bp    RNA     linear   VRL 01-JAN-2020
DEFINITION  Dengue virus 2 isolate X, complete genome.
ACCESSION   AB000001
VERSION     AB000001.1
SOURCE      Dengue virus 2
  ORGANISM  Dengue virus 2
            Viruses; Riboviria.
FEATURES             Location/Qualifiers
     source          1..20
                     /genotype="Cosmopolitan"
                     /country="Indonesia: Jakarta"
                     /host="Homo sapiens"
                     /collection_date="12-Mar-2010"
ORIGIN      
        1 acgtacgtac gtacgtacgt
//
LOCUS       AB000002 12 bp    RNA     linear   VRL 01-JAN-2020
DEFINITION  Flavivirus sp. strain Y.
ACCESSION   AB000002
VERSION     AB000002.3
SOURCE      Flavivirus sp.
  ORGANISM  Flavivirus sp.
FEATURES             Location/Qualifiers
     source          1..12
ORIGIN      
        1 nnnnacgtac gt
//
"""


def test_genbank_file_two_records(spark):
    d = tempfile.mkdtemp(prefix="gb-")
    with open(os.path.join(d, "recs.gb"), "w") as f:
        f.write(GB)
    recs = genbank.read_genbank(spark, d)
    rows = {r["sample_id"]: r for r in recs.collect()}
    assert set(rows) == {"AB000001.1", "AB000002.3"}
    a = rows["AB000001.1"]
    assert a["description"] == "Dengue virus 2 isolate X, complete genome"
    assert a["sequence"] == "ACGTACGTACGTACGTACGT" and a["country"] == "Indonesia: Jakarta"
    meta = {r["sample_id"]: r for r in genbank.genbank_metadata(recs).collect()}
    assert meta["AB000001.1"]["serotype"] == "DENV-2" and meta["AB000001.1"]["year"] == "2010"
    assert meta["AB000001.1"]["is_complete"] is True and meta["AB000002.3"]["serotype"] is None
    assert meta["AB000002.3"]["genome_length"] == 12


def test_render_parse_roundtrip(spark):
    df = spark.createDataFrame([("S1", "Dengue virus type 1 isolate", "g", None, "h", "01-Jan-1999", "ACGT" * 40)],
                               "sample_id string, description string, genotype string, country string, "
                               "host string, collection_date string, sequence string")
    back = genbank.parse_records(genbank.render_records(df)).first()
    assert back["sequence"] == "ACGT" * 40 and back["country"] is None and back["genotype"] == "g"


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "  acg t\n\nID7, ggcc \n tta ")], "doc_id long, text string")
    rows = [tuple(r) for r in text.parse_sequence_lines(df, group_col="doc_id").orderBy("line_no").collect()]
    assert rows == [(1, 1, "SAMPLE_0001", "ACGT", 4), (1, 2, "ID7", "GGCC", 4), (1, 3, "SAMPLE_0003", "TTA", 3)]
    d = tempfile.mkdtemp(prefix="txt-")
    with open(os.path.join(d, "in.txt"), "w") as f:
        f.write("acgt\n\n  \nX1,gg\nttt\n")
    got = [tuple(r) for r in text.read_sequence_file(spark, d).orderBy("line_no").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [(1, "SAMPLE_0001", "ACGT"), (2, "X1", "GG"), (3, "SAMPLE_0003", "TTT")]


def test_table_set_missing_files_warn(spark):
    d = tempfile.mkdtemp(prefix="set-")
    meta = spark.createDataFrame([("a", "d", "DENV-1", None, None, "2001", None, 10, False)],
                                 "sample_id string, description string, serotype string, genotype string, "
                                 "country string, year string, host string, genome_length int, is_complete boolean")
    write_table(meta.coalesce(1), os.path.join(d, "sample_metadata.csv"), fmt="csv")
    ts = load_table_set(spark, d)
    assert ts["metadata"].count() == 1 and ts["labels"] is None


def test_model_persistence_roundtrip(spark):
    from seqlake.operators.models.autoencoder import fit_autoencoder
    from seqlake.operators.models.iforest import fit_isolation_forest

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"r{i}", rng.normal(size=3).tolist()) for i in range(60)],
                               "sample_id string, features array<double>")
    d = tempfile.mkdtemp(prefix="models-")
    m = fit_isolation_forest(df, n_trees=10)
    persist.save_isolation_forest(spark, m, os.path.join(d, "if"))
    m2 = persist.load_isolation_forest(spark, os.path.join(d, "if"))
    a = [r["score"] for r in m.score(df).orderBy("sample_id").collect()]
    b = [r["score"] for r in m2.score(df).orderBy("sample_id").collect()]
    assert np.allclose(a, b)
    ae = fit_autoencoder(df, steps=3, hidden_layers=(4,), encoding_dim=2)
    persist.save_autoencoder(spark, ae, os.path.join(d, "ae"))
    ae2 = persist.load_autoencoder(spark, os.path.join(d, "ae"))
    X = rng.normal(size=(5, 3))
    assert np.allclose(ae.errors(X), ae2.errors(X)) and ae2.threshold == pytest.approx(ae.threshold)


def test_classifier_shapley_and_plans(spark):
    from seqlake.operators.models.classify import fit_classifier
    from seqlake.operators.models.shapley import sampled_shapley
    from seqlake.plans import derived
    from seqlake.plans.inference import OUTPUT_COLUMNS, infer_from_sequences
    from seqlake.plans.training import train_all

    sf = "/root/testdata/sf0.001"
    c = derived.cleaned(spark, sf)
    feats = ["gc_content", "kmer_AAA", "kmer_ACG", "kmer_TTT", "mutation_density"]
    clf = fit_classifier(c, feats, "serotype", rf_trees=10, max_depth=4)
    rows = c.orderBy("sample_id").limit(3)
    attr = sampled_shapley(clf, rows, c.orderBy("sample_id").limit(4), n_permutations=4)
    sums = {r["sample_id"]: r["s"] for r in attr.groupBy("sample_id").agg(F.sum("attribution").alias("s")).collect()}
    # efficiency: attributions add up to f(x) - mean over the used backgrounds
    p = {r["sample_id"]: r for r in clf.model.transform(
        c.select("sample_id", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in feats])).collect()}
    bg_ids = [r["sample_id"] for r in c.orderBy("sample_id").limit(4).collect()]
    for sid, s in sums.items():
        fx = p[sid]["probability"][0]
        base = np.mean([p[bg_ids[j % 4]]["probability"][0] for j in range(4)])
        assert s == pytest.approx(fx - base, abs=1e-9)
    res = train_all(c, tasks=(1, 2, 3), cv_folds=2, rf_trees=5, gbt_iter=2, max_depth=3, n_trees=10, ae_steps=3,
                    kinds=("random_forest",))
    assert res.task1_metrics.count() == 1
    out = infer_from_sequences(res, derived.raw_sequences(spark, sf))
    assert out.columns == OUTPUT_COLUMNS and out.count() == derived.raw_sequences(spark, sf).count()


def test_streaming_scoring_available_now(spark):
    from seqlake.plans import derived
    from seqlake.plans.training import train_all
    from seqlake.streaming.scoring import start_scoring

    sf = "/root/testdata/sf0.001"
    c = derived.cleaned(spark, sf)
    res = train_all(c, tasks=(2,), n_trees=5)
    d = tempfile.mkdtemp(prefix="stream-")
    inp, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    os.makedirs(inp)
    with open(os.path.join(inp, "a.csv"), "w") as f:
        f.write("sample_id,sequence\nS1,ACGTACGTAAAC\n,GGGCCCAAATTT\n")
    q = start_scoring(spark, res, inp, out, ck, tasks=(2,))
    q.awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert sorted(r["sample_id"] for r in got) == ["B0_SAMPLE_0001", "S1"]
    assert all(r["anomaly_score"] is not None for r in got)
