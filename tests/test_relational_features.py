"""Merging, filters, encoding and scaling rules."""

import pytest
from pyspark.sql import functions as F

from seqlake.operators import features, relational


def test_merge_suffixes_and_left_semantics(spark):
    meta = spark.createDataFrame([("a", "DENV-1"), ("b", None)], "sample_id string, serotype string")
    lab = spark.createDataFrame([("a", "DENV-1", True)], "sample_id string, serotype string, known_genotype boolean")
    m = relational.merge_tables(meta, labels=lab)
    assert set(m.columns) == {"sample_id", "serotype", "serotype_label", "known_genotype"}
    assert m.count() == 2
    assert relational.filter_missing_labels(m).count() == 1
    only_label = m.drop("serotype")
    assert relational.filter_missing_labels(only_label).count() == 1
    assert relational.filter_missing_labels(m.drop("serotype", "serotype_label")).count() == 2


def test_outlier_trim_inclusive_linear(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "x double")
    out = relational.filter_outliers(df, "x", 0.01, 0.99)
    vals = sorted(r[0] for r in out.collect())
    # numpy linear quantiles: 1.99 and 99.01 -> 2..99 kept, null dropped
    assert vals[0] == 2.0 and vals[-1] == 99.0 and len(vals) == 98
    assert relational.filter_outliers(df, "missing_col").count() == 101


def test_min_class_size_and_filter(spark):
    assert relational.min_class_size(5, 0.2) == 7
    rows = [("c1",)] * 7 + [("c2",)] * 6
    df = spark.createDataFrame(rows, "y string")
    assert relational.filter_min_class(df, "y").groupBy("y").count().collect()[0]["y"] == "c1"


def test_negated_membership_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    assert relational.filter_membership(df, "g", ["a"], negate=True).count() == 2
    assert relational.filter_membership(df, "g", ["a"]).count() == 1
    many = [f"v{i}" for i in range(2000)] + ["a"]
    assert relational.filter_membership(df, "g", many, negate=True).count() == 2


def test_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    model = features.fit_scaler(df, ["a", "b"])
    assert model.std["a"] == pytest.approx(1.247219, abs=1e-6)
    new = spark.createDataFrame([(1.0, 9.0)], "a double, b double")
    r = model.transform(new).first()
    assert r["b"] == pytest.approx(4.0)
    assert r["a"] == pytest.approx((1.0 - 7.0 / 3.0) / 1.247219, abs=1e-5)


def test_one_hot_drop_first_and_nulls(spark):
    df = spark.createDataFrame([("x", "b"), ("y", "a"), ("z", None)], "id string, c string")
    lv = features.category_levels(df, ["c"])
    assert lv == {"c": ["a", "b"]}
    out = {r["id"]: r for r in features.one_hot(df, lv).collect()}
    assert set(out["x"].asDict()) == {"id", "c_b"}
    assert out["x"]["c_b"] == 1 and out["y"]["c_b"] == 0 and out["z"]["c_b"] == 0


def test_column_kind_rule(spark):
    rows = [(i % 3, float(i), str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "low int, high double, s string")
    assert features.column_kinds(df, ["low", "high", "s"]) == {"low": "categorical", "high": "numeric",
                                                              "s": "categorical"}


def test_align_and_schema_roundtrip(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, extra double")
    out = features.align_features(df, ["b", "a"])
    assert out.columns == ["b", "a"] and tuple(out.first()) == (0.0, 1.0)
    schema = features.FeatureSchema(["a", "c_x"], ["a"], {"c": ["w", "x"]})
    assert features.FeatureSchema.from_json(schema.to_json()).names == ["a", "c_x"]


def test_label_encoding_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    got = {r["y"]: r["y_idx"] for r in features.label_encode(df, "y", out_col="y_idx").select(
        F.col("y"), "y_idx").collect()}
    assert got == {"a": 0, "b": 1, None: 2}


def test_feature_groups_rules():
    cols = ["sample_id", "gc_content", "kmer_ACG", "mutation_density", "length_diff", "NS1_x", "e_score",
            "year", "host", "genome_length", "serotype_label"]
    g = features.group_features(cols)
    assert g["X_seq"] == ["gc_content", "kmer_ACG"]
    assert g["X_mut"] == ["mutation_density", "length_diff"]
    assert "NS1_x" in g["X_prot"] and "e_score" in g["X_prot"] and "sample_id" in g["X_prot"]  # the 'e_' quirk
    assert g["X_meta"] == ["year", "host", "genome_length"]
    assert features.features_for_task(["gc_content", "kmer_ACG", "year"], g, "novelty") == ["gc_content", "kmer_ACG"]
    assert features.novelty_feature_columns(cols) == ["gc_content", "kmer_ACG", "mutation_density"]


def test_long_membership_list_keeps_column_order(spark):
    from seqlake.operators.relational import filter_membership

    df = spark.createDataFrame([("a", "1", 1), ("b", None, 2), ("c", "x", 3)], "sample_id string, g string, n int")
    values = [str(i) for i in range(1001)]
    inside, outside = filter_membership(df, "g", values), filter_membership(df, "g", values, negate=True)
    assert inside.columns == outside.columns == df.columns
    assert [r.sample_id for r in inside.collect()] == ["a"]
    assert sorted(r.sample_id for r in outside.collect()) == ["b", "c"]


def test_crosstab_has_no_level_limit(spark):
    from seqlake.operators.eda import crosstab

    df = spark.range(1500).selectExpr("cast(id as string) as a", "cast(id % 2 as string) as b")
    out = crosstab(df.union(spark.createDataFrame([(None, "0"), ("0", None)], "a string, b string")), "a", "b")
    assert out.count() == 3000 and out.where("count = 1").count() == 1500 and out.where("count = 0").count() == 1500
    assert crosstab(df.where("a = 'none'"), "a", "b").count() == 0
