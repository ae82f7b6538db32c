"""Interpretation: importance ranking, feature meaning, attribution summary,
report table (H1, H3, H4, H5). Sampled Shapley values (H2) are in
``seqlake.operators.models.shapley``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: default feature -> meaning rules, tried in this order as
# substrings of the lowercased name, then the fallbacks below
DEFAULT_MEANINGS = [
    ("gc_content", "GC Content - Overall nucleotide composition"),
    ("mutation_density", "Mutation Density - Rate of genetic variation"),
    ("kmer_", "k-mer frequencies - Sequence patterns"),
]
FALLBACK_MEANINGS = [
    ("kmer", "k-mer pattern"),
    ("mutation", "Mutation profile"),
    ("gc", "GC content"),
]
OTHER = "Other feature"


def map_features(df: DataFrame, feature_col: str = "feature", mapping=None,
                 out_col: str = "biological_interpretation") -> DataFrame:
    """First rule whose key is a substring of the lowercased name, else fallbacks."""
    rules = list(mapping.items()) if isinstance(mapping, dict) else list(mapping or DEFAULT_MEANINGS)
    name = F.lower(F.col(feature_col))
    expr = None
    for key, meaning in rules + FALLBACK_MEANINGS:
        cond = name.contains(key.lower() if isinstance(key, str) else key)
        expr = F.when(cond, F.lit(meaning)) if expr is None else expr.when(cond, F.lit(meaning))
    return df.withColumn(out_col, expr.otherwise(F.lit(OTHER)))


def top_importances(importances: dict[str, float] | list[tuple[str, float]], spark, top_n: int = 20) -> DataFrame:
    """feature, importance, rank: highest first, ties by name (driver list is one
    entry per feature, so it is bounded by the model width)."""
    items = list(importances.items()) if isinstance(importances, dict) else list(importances)
    df = spark.createDataFrame([(str(f), float(v)) for f, v in items], "feature string, importance double")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def attribution_summary(attr: DataFrame, top_n: int = 20) -> DataFrame:
    """Mean |attribution| per feature, top ``top_n`` (H3)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"))
                .orderBy(F.col("mean_abs_attribution").desc(), "feature").limit(top_n))


def interpretation_report(importance: DataFrame | None, attribution: DataFrame | None = None,
                          top_n: int = 20) -> DataFrame | None:
    """Tidy report ``section, rank, feature, value, meaning`` (H5)."""
    parts = []
    if importance is not None:
        imp = map_features(importance.select("feature", F.col("importance").alias("value"), "rank"))
        parts.append(imp.select(F.lit("feature_importance").alias("section"), "rank", "feature", "value",
                                F.col("biological_interpretation").alias("meaning")))
    if attribution is not None:
        from pyspark.sql import Window
        s = attribution_summary(attribution, top_n)
        s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_attribution").desc(), "feature")))
        s = map_features(s.select("feature", F.col("mean_abs_attribution").alias("value"), "rank"))
        parts.append(s.select(F.lit("attribution").alias("section"), "rank", "feature", "value",
                              F.col("biological_interpretation").alias("meaning")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
