"""Stored intermediates: bucketed tables join without a shuffle of their side, and tables can be dropped."""

import os

from seqlake.session import discard, materialize, materialize_by


def test_bucketed_side_is_not_shuffled(spark):
    big = materialize_by(spark.range(1000).selectExpr("id % 97 as c", "id as v"), "side-table", "c")
    small = spark.range(97).selectExpr("id as a")
    j = big.hint("merge").join(small.hint("merge"), big["c"] == small["a"])
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and j.count() == 1000
    path = big._table_path.removeprefix("file:")
    assert os.path.isdir(path)
    discard(big)
    assert not os.path.exists(path)


def test_discard_leaves_other_frames(spark):
    kept = materialize(spark.range(5).toDF("x"), "kept")
    gone = materialize(spark.range(5).toDF("x"), "gone")
    discard(gone, spark.range(3))
    discard(gone)
    assert kept.count() == 5 and not os.path.exists(str(gone._table_path).removeprefix("file:"))
