"""A column of more levels than fit a table column each takes part in the registered model queries."""

from pyspark.sql import functions as F

from seqlake.operators import features, splits
from seqlake.plans import catalog


def _wide(spark, monkeypatch):
    """60 hosts, the first 30 of them of serotype a; nothing else tells the serotypes apart."""
    rows = [(f"S{i:03d}", "ab"[i % 60 >= 30], f"h{i % 60:02d}", float(i * 7919 % 101) / 10) for i in range(480)]
    c = spark.createDataFrame(rows, "sample_id string, serotype string, host string, gc_content double").repartition(3)
    real = features.fit_feature_schema
    monkeypatch.setattr(features, "fit_feature_schema", lambda *a, **k: real(*a, **{**k, "max_levels": 20}))
    monkeypatch.setattr(catalog.derived, "cleaned", lambda *a: c)
    monkeypatch.setattr(catalog, "input_key", lambda *a: "wide")
    for name in ("_TASK1", "_FOREST"):
        monkeypatch.setattr(catalog, name, {})
    return c


def test_levels_beyond_the_bound_have_importance_and_attribution(spark, monkeypatch):
    c = _wide(spark, monkeypatch)
    found = {r["feature"]: r["importance"] for r in catalog.QUERIES["feature_importance"](spark, "").collect()}
    hosts = {f for f in found if f.startswith("host_h")}
    assert len(hosts) > 10 and sum(found[f] for f in hosts) > 0.2
    hit = catalog.QUERIES["random_forest_predictions"](spark, "")
    assert hit.count() == 96 and hit.where("predicted = serotype").count() > 80
    schema, S = catalog._task1_frames(spark, "")
    attr, _ = catalog._forest(spark, "").attributions(splits.hash_sample(S, 5, seed=42))
    assert attr.where("feature like 'host_h%' and attribution <> 0").count() > 0
    prepared = catalog.QUERIES["prepared_features"](spark, "")
    assert prepared.count() == c.count() and "gc_content" in prepared.columns
    assert prepared.agg(F.abs(F.avg(F.when(~F.col("is_test"), F.col("gc_content"))))).first()[0] < 1e-5
