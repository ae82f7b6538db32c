"""Splits, dense ids, prefix sums and metrics against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import metrics, splits
from seqlake.operators.ids import dense_index, prefix_sum, with_sample_ids


def _df(spark, n=300, classes=3):
    rows = [(f"id{i}", f"c{i % classes}") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, y string")


def test_stratified_split_exact_and_partition_independent(spark):
    df = _df(spark)
    a = splits.stratified_split(df, "y")
    b = splits.stratified_split(df.repartition(5), "y")
    counts = {r["y"]: r["n"] for r in a.where("is_test").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"c0": 20, "c1": 20, "c2": 20}
    assert sorted(a.where("is_test").select("sample_id").collect()) == \
        sorted(b.where("is_test").select("sample_id").collect())


def test_hash_rank_matches_global_sort(spark):
    import hashlib
    df = _df(spark, 200, 1)
    got = {r["sample_id"]: r["_rank"] for r in splits.hash_rank(df, "y", "sample_id").collect()}
    keys = sorted(df.select("sample_id").collect(), key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]))
    assert [got[r[0]] for r in keys] == list(range(1, 201))


def test_folds_balanced(spark):
    f = splits.fold_ids(_df(spark, 100, 2), "y", k=5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [20, 20, 20, 20, 20]


def test_novelty_and_open_set_splits(spark):
    rows = [(f"s{i}", ["g1", "g2", "g3", None][i % 4], f"DENV-{i % 4 + 1}") for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id string, genotype string, serotype string")
    train, test = splits.novelty_split(df)
    assert train.count() == 20
    t = {r["y_true"]: r["count"] for r in test.groupBy("y_true").count().collect()}
    assert t == {1: 40, 0: 20}  # only 20 rows are in neither list (the null genotypes)
    train, test = splits.open_set_split(df)
    t = {r["y_true"]: r["count"] for r in test.groupBy("y_true").count().collect()}
    assert train.count() == 40 and t == {1: 40, 0: 10}


def test_dense_index_and_ids(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = dense_index(df, "k", "i").collect()
    assert sorted(r["i"] for r in out) == list(range(1, 1001))
    assert all(r["i"] == r["k"] + 1 for r in out)
    ids = with_sample_ids(df, order_by="k").where(F.col("k") == 0).first()["sample_id"]
    assert ids == "SAMPLE_0001"


def test_prefix_sum(spark):
    df = spark.range(0, 500, 1, 6).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    got = {r["k"]: r["_cum"] for r in prefix_sum(df, "k", "v").collect()}
    want = np.cumsum([k % 3 for k in range(500)])
    assert all(got[k] == want[k] for k in range(500))


def test_roc_auc_brute_force(spark):
    rnd = random.Random(0)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.roc_auc(df, "y", "s").first()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    one = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, s double")
    assert metrics.roc_auc(one, "y", "s").first()[0] == 0.0


def test_multiclass_metrics_hand_case(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "y_true string, y_pred string")
    rep = {r["label"]: r for r in metrics.per_class_report(df).collect()}
    assert rep["a"]["precision"] == pytest.approx(0.5) and rep["a"]["recall"] == pytest.approx(0.5)
    assert rep["b"]["f1"] == pytest.approx(0.8) and rep["c"]["f1"] == 0.0
    s = metrics.classification_summary(df).first()
    assert s["accuracy"] == pytest.approx(0.6)
    assert s["macro_f1"] == pytest.approx((0.5 + 0.8 + 0.0) / 3)
    assert s["weighted_f1"] == pytest.approx((0.5 * 2 + 0.8 * 2 + 0) / 5)
    cm = metrics.confusion_matrix(df)
    assert cm.count() == 9 and cm.where("y_true = 'c' and y_pred = 'a'").first()["n"] == 1


def test_binary_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = metrics.binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_describe_and_box_modes(spark):
    from seqlake.operators import eda

    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    ex = eda.describe(df, ["x"]).first()
    ap = eda.describe(df, ["x"], mode="approx").first()
    assert (ex["p25"], ex["p50"], ex["p75"]) == (25.75, 50.5, 75.25)
    assert abs(ap["p50"] - 50.5) <= 1.0
    b = eda.box_stats(df, "x").first()
    assert b["iqr"] == 49.5 and b["n_outliers"] == 0
    h = eda.histogram(df, "x", 10).collect()
    assert sum(r["count"] for r in h) == 100 and h[-1]["count"] == 10


def test_folds_fall_back_to_plain_kfold(spark):
    rows = [(f"id{i}", "big") for i in range(20)] + [("tiny0", "small"), ("tiny1", "small")]
    df = spark.createDataFrame(rows, "sample_id string, y string")
    f = splits.fold_ids(df, "y", k=5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sum(sizes) == 22 and max(sizes) - min(sizes) <= 1


def test_index_and_prefix_sum_lose_no_rows_over_many_partitions(spark):
    from seqlake.operators.ids import dense_index, prefix_sum

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 300_000
        df = spark.range(n).select(F.xxhash64("id").alias("key"), (F.col("id") % 7).alias("v"),
                                   F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"))
        ids = dense_index(df, order_by="key").agg(F.count("_idx"), F.countDistinct("_idx"), F.min("_idx"), F.max("_idx")).first()
        assert tuple(ids) == (n, n, 1, n)
        total = sum(i % 7 for i in range(n))
        got = prefix_sum(df, "key", "v").agg(F.count("_cum"), F.max("_cum")).first()
        assert tuple(got) == (n, total)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_split_keeps_rows_without_class(spark):
    from seqlake.operators.splits import stratified_split

    df = spark.createDataFrame([(f"s{i}", None if i % 3 else "a") for i in range(60)], "sample_id string, label string")
    assert stratified_split(df, "label").count() == 60
