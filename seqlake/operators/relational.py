"""Merging, label/outlier/class-size filters, membership, alerts, unions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.common import bounded_broadcast
from seqlake.operators.quantiles import quantiles

MERGE_SUFFIXES = {"sequence_features": "_seq", "mutation_profile": "_mut", "labels": "_label"}


def _suffix_overlaps(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    clash = set(left.columns) & set(right.columns) - {key}
    return right.select(*[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns])


def null_id_counts(tables: dict[str, DataFrame | None], key: str = "sample_id") -> DataFrame:
    """``table_name, n_rows, n_null_ids``: rows that no merge can match, per table given."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_null_ids"))
             for name, df in tables.items() if df is not None]
    if not parts:
        raise ValueError("no table given")
    return reduce(DataFrame.unionByName, parts)


def merge_tables(metadata: DataFrame, sequence_features: DataFrame | None = None,
                 mutation_profile: DataFrame | None = None, labels: DataFrame | None = None,
                 key: str = "sample_id") -> DataFrame:
    """metadata LEFT JOIN each present table on ``key``; a right column whose name
    is already taken gets ``_seq`` / ``_mut`` / ``_label``.

    All joins are on the same key, so after the first sort-merge join the left
    side stays hash-partitioned by ``key`` and only the right sides shuffle.
    """
    if metadata is None:
        raise ValueError("metadata table is required")
    merged = metadata
    for name, right in (("sequence_features", sequence_features),
                        ("mutation_profile", mutation_profile), ("labels", labels)):
        if right is None:
            continue
        merged = merged.join(_suffix_overlaps(merged, right, key, MERGE_SUFFIXES[name]), key, "left")
    return merged


def filter_missing_labels(df: DataFrame, label_column: str = "serotype") -> DataFrame:
    """Drop rows with a null label (``label`` else ``label_label``; else no-op)."""
    if label_column in df.columns:
        return df.where(F.col(label_column).isNotNull())
    if f"{label_column}_label" in df.columns:
        return df.where(F.col(f"{label_column}_label").isNotNull())
    return df


def quantile_bounds(df: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99,
                    mode: str = "exact", accuracy: int = 1_000_000) -> tuple[float, float] | None:
    """``(lo, hi)``, linear-interpolated quantiles, or None without a value.

    ``exact`` narrows to the ranks in bounded memory; ``approx`` is one pass of a sketch.
    """
    if mode == "exact":
        found = quantiles(df, [column], [lower, upper])[0]
    elif mode == "approx":
        found = df.select(F.percentile_approx(F.col(column).cast("double"), F.array(F.lit(lower), F.lit(upper)), accuracy)).first()[0]
    else:
        raise ValueError(mode)
    return (float(found[0]), float(found[1])) if found else None


def filter_outliers(df: DataFrame, column: str = "genome_length", lower: float = 0.01,
                    upper: float = 0.99, mode: str = "exact") -> DataFrame:
    """Keep ``q_lower <= x <= q_upper`` (inclusive); nulls dropped; no-op if absent.

    The bounds are found first; the filter then uses literals, so it reaches the
    Parquet scan (row-group skipping) when the column is stored.
    """
    if column not in df.columns:
        return df
    bounds = quantile_bounds(df, column, lower, upper, mode)
    if bounds is None:
        return df.where(F.lit(False))
    x = F.col(column).cast("double")
    return df.where((x >= F.lit(bounds[0])) & (x <= F.lit(bounds[1])))


def min_class_size(cv_folds: int = 5, test_size: float = 0.2) -> int:
    return max(2, math.ceil(cv_folds / (1 - test_size)))


def filter_min_class(df: DataFrame, label: str, min_count: int | None = None,
                     cv_folds: int = 5, test_size: float = 0.2) -> DataFrame:
    """Keep only classes with at least ``min_count`` rows (7 by default).

    Counting is a partial-aggregated groupBy (skew-safe); the class table is
    broadcast only after its size is checked.
    """
    m = min_class_size(cv_folds, test_size) if min_count is None else min_count
    keep = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= m).select(label)
    return df.join(bounded_broadcast(keep), label, "left_semi")


def filter_membership(df: DataFrame, column: str, values, negate: bool = False) -> DataFrame:
    """``column IN values``; with ``negate`` keeps nulls (pandas ``~isin``).

    The list is the caller's literal; Spark turns it into a hash-set lookup at any length.
    """
    m = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.where(~m if negate else m)


def numeric_filter(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` parses as a number (others dropped)."""
    return df.where(F.col(column).try_cast("double").isNotNull())


def alert_list(df: DataFrame, flag_col: str, score_col: str, id_col: str = "sample_id",
               n: int = 10) -> DataFrame:
    """Flagged rows, highest score first (ties by id), first ``n`` (a top-k)."""
    return (df.where(F.col(flag_col)).select(id_col, score_col)
              .orderBy(F.col(score_col).desc(), F.col(id_col)).limit(n))


def union_with_truth(known: DataFrame, novel: DataFrame, truth_col: str = "y_true") -> DataFrame:
    """Known rows (truth 0) + novel rows (truth 1), matched by column name."""
    return (known.withColumn(truth_col, F.lit(0))
                 .unionByName(novel.withColumn(truth_col, F.lit(1))))
