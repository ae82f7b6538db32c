"""k-mers in bounded pieces by either dictionary form, and a forest's attributions without its nodes on the driver."""

import numpy as np
from pyspark.sql import functions as F

from seqlake.operators import kmers
from seqlake.operators.models import pathshap
from seqlake.operators.models.classify import fit_classifier
from seqlake.operators.sparse import ACTIVE, VALUES

ROWS = [("a", "ACGTRNACGTacgt"), ("b", None), ("c", "AC"), ("d", "NNNNNN"), ("a", "ACGTACGTT"), (None, "GATTACAGATTACA"), ("e", "")]


def _plain(k):
    """Slots and shares by a plain loop over windows."""
    rows = []
    for _, s in ROWS:
        w = [s[i:i + k] for i in range(len(s or "") - k + 1) if "N" not in s[i:i + k]]
        rows.append({x: w.count(x) / len(w) for x in w})
    place = {x: i for i, x in enumerate(sorted(set().union(*rows)))}
    return sorted((str(n), sorted((place[x], f) for x, f in r.items())) for (n, _), r in zip(ROWS, rows))


def _parts(spark, k):
    df = spark.createDataFrame(ROWS, "sample_id string, sequence string").repartition(2)
    p, _ = kmers.sequence_parts(df, k=k)
    return p, sorted((str(r["sample_id"]), sorted(zip(r[ACTIVE], r[VALUES]))) for r in p.collect())


def test_vectors_equal_plain_counts_in_either_form(spark, monkeypatch):
    monkeypatch.setattr(kmers, "CELLS", 3)
    monkeypatch.setattr(kmers, "ROWS", 2)
    narrow, got = _parts(spark, 3)
    assert got == _plain(3)
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")  # the test's own repartition
    monkeypatch.setattr(kmers, "DICTIONARY_BYTES", 0)
    assert _parts(spark, 3)[1] == _plain(3)


def test_long_counts_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(kmers, "CELLS", 2)
    monkeypatch.setattr(kmers, "ROWS", 2)
    df = spark.createDataFrame([(s, x) for s, x in ROWS], "sample_id string, sequence string").coalesce(1)
    got = kmers.kmer_counts(df.withColumn("tag", F.upper("sample_id")), k=3, mode="skip_n", keep=["tag"]).collect()
    per: dict = {}
    for _, s in ROWS:
        for i in range(len(s or "") - 2):
            if "N" not in s[i:i + 3]:
                per[s, s[i:i + 3]] = per.get((s, s[i:i + 3]), 0) + 1
    assert sorted(r["kmer_count"] for r in got) == sorted(per.values()) and {r["kmer"] for r in got} == {w for _, w in per}
    assert all(r["freq"] == r["kmer_count"] / r["total"] and r["tag"] == (r["sample_id"] and r["sample_id"].upper()) for r in got)


def test_batches_stay_small(spark, monkeypatch):
    monkeypatch.setattr(kmers, "CELLS", 40)
    df = spark.createDataFrame([(str(i), "ACGTTGCAAGCT") for i in range(300)], "sample_id string, sequence string").coalesce(1)
    held = kmers.kmer_counts(df, k=3, mode="skip_n").mapInArrow(lambda it: (b.select(["total"]) for b in it), "total long")
    assert held.count() == 300 * 10  # one k-mer per window


def test_attributions_leave_the_nodes_in_spark(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 4)).round(2)
    y = np.where(x[:, 0] + x[:, 1] * x[:, 2] > 0, "a", "b")
    df = spark.createDataFrame([(f"s{i}", str(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y))], ["sample_id", "label", "p", "q", "r", "s"])
    clf = fit_classifier(df, ["p", "q", "r", "s"], "label", "random_forest", rf_trees=5, max_depth=6)
    paths = pathshap.leaf_paths(pathshap.forest_nodes(spark, clf.model.stages[-2]))
    want = pathshap.shapley(paths, x, 0, 4)

    def refused(*_):
        raise AssertionError("the whole forest was read by the driver")

    monkeypatch.setattr(pathshap, "forest_nodes", refused)
    monkeypatch.setattr(pathshap, "ROWS", 7)  # several blocks of rows per tree
    attr, base = clf.attributions(df)
    rows = attr.collect()
    assert abs(base - pathshap.base_value(paths)[0]) < 1e-9 and len(rows) == len({(r["sample_id"], r["feature"]) for r in rows})
    for r in rows:
        i, j = int(r["sample_id"][1:]), "pqrs".index(r["feature"])
        assert abs(r["attribution"] - want[i, j]) < 1e-9 and r["feature_value"] == x[i, j]
    assert len(rows) == 120 * 4
