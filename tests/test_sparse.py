"""Sparse one-hot against the dense form."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier

from seqlake.operators import features, sparse
from seqlake.operators.sparse import fit_sparse


def _frame(spark):
    rows = [(i, float(i % 5), None if i % 7 == 0 else f"c.{i % 4} x", i % 3 == 0 if i % 4 else None, None) for i in range(60)]
    return spark.createDataFrame(rows, "sample_id int, n double, `co.untry x` string, flag boolean, none string").repartition(3)


def test_equals_scaled_dense_columns(spark, monkeypatch):
    df = _frame(spark).withColumnRenamed("co.untry x", "country")
    enc = fit_sparse(df, ["n"], ["country", "flag", "none"])
    lv = {"country": [f"c.{i} x" for i in range(4)], "flag": [False, True]}
    dense = features.one_hot(df, lv).select("sample_id", "n", "`country_c.1 x`", "`country_c.2 x`", "`country_c.3 x`", "flag_True")
    want = {r[0]: np.array(r[1:], float) for r in dense.collect()}
    all_rows = np.array(list(want.values()))
    std, mean = all_rows.std(axis=0), all_rows.mean(axis=0)
    names = [r["feature"] for r in enc.names().orderBy("pos").collect()]
    assert names == ["n", "country_c.1 x", "country_c.2 x", "country_c.3 x", "flag_True"] and enc.size == 5
    offset = np.array([-mean[0] / std[0] * 0] + [r["offset"] for r in enc.levels.where("pos is not null").orderBy("pos").collect()])
    for limit in (sparse.BROADCAST_BYTES, -1):  # both ways of joining the levels
        monkeypatch.setattr(sparse, "BROADCAST_BYTES", limit)
        for r in enc.vectors(df, ["sample_id"]).collect():
            x = want[r["sample_id"]]
            assert np.abs(r["features"].toArray() + offset - (x - mean) / std).max() < 1e-9


def test_unseen_and_missing_columns_give_zeros(spark):
    enc = fit_sparse(_frame(spark), ["n"], ["flag", "co.untry x"])
    new = spark.createDataFrame([(1, "other")], "sample_id int, `co.untry x` string")
    v = enc.vectors(new, ["sample_id"]).first()["features"]
    assert len(v) == enc.size and all(i == 0 for i in v.indices)


def test_trains_a_spark_forest(spark):
    df = spark.range(3_000).selectExpr("concat('k', id % 1500) as c", "cast(id % 2 as double) as y", "cast(id % 2 as double) + 0.1 as x")
    enc = fit_sparse(df, ["x"], ["c"])
    data = enc.vectors(df, ["y"])
    model = RandomForestClassifier(labelCol="y", numTrees=5, featureSubsetStrategy="all", seed=1).fit(data)
    assert model.transform(data).where("prediction = y").count() == 3_000
