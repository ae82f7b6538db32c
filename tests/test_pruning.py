"""Queries that use no k-mer value have no Python stage in their plans; those that do compute the vector once."""

import numpy as np
import pytest

import __spark_entry__ as entry
from seqlake.operators import kmers
from tests.conftest import SF_SMALL

PYTHON = ("ArrowEvalPython", "MapInPandas", "MapInArrow", "BatchEvalPython", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["label_filter", "mutation_defaults", "table_counts", "aligned_features"])
def test_only_used_kmers_are_computed(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    if name == "aligned_features":
        assert plan.count("ArrowEvalPython") == 1
    else:
        assert not any(p in plan for p in PYTHON), plan


def test_vector_equals_the_long_form(spark):
    rows = [("a", "ACGNTacgR"), ("b", "AC"), ("c", ""), ("d", None), ("e", "TTTTT"), ("f", "ACGTRYKMé")]
    df = spark.createDataFrame(rows, "sample_id string, sequence string")
    for mode, levels in (("strip", kmers.kmer_levels(3)), ("skip_n", ["ACG", "GTa", "cgR", "TTT"])):
        wide = {r[0]: r[1:] for r in kmers.kmer_wide_counts(df, levels, 3, mode, keep=["sample_id"]).collect()}
        long = {(r["sample_id"], r["kmer"]): r["freq"] for r in kmers.kmer_counts(df, 3, mode).collect()}
        assert all(wide[i] == tuple(long.get((i, lv), 0.0) for lv in levels) for i, _ in rows)
        assert np.isfinite([x for w in wide.values() for x in w]).all()
