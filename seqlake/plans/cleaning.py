"""Load -> merge -> drop missing labels -> trim length outliers -> summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from seqlake.operators import eda, relational
from seqlake.sources.tables import load_table_set, write_table


@dataclass
class CleaningResult:
    cleaned: DataFrame
    summary: DataFrame
    label_distribution: DataFrame


def clean_tables(tables: dict[str, DataFrame | None], label_column: str = "serotype",
                 outlier_column: str = "genome_length", lower: float = 0.01, upper: float = 0.99) -> CleaningResult:
    merged = relational.merge_tables(tables.get("metadata"), tables.get("sequence_features"),
                                     tables.get("mutation_profile"), tables.get("labels"))
    labelled = relational.filter_missing_labels(merged, label_column)
    cleaned = relational.filter_outliers(labelled, outlier_column, lower, upper)
    dist = eda.value_counts(cleaned, label_column) if label_column in cleaned.columns else None
    return CleaningResult(cleaned, eda.dataset_summary(cleaned), dist)


def run_cleaning(spark: SparkSession, directory: str, output: str | None = None, fmt: str = "csv",
                 label_column: str = "serotype") -> CleaningResult:
    res = clean_tables(load_table_set(spark, directory, fmt), label_column)
    if output:
        write_table(res.cleaned, output, "parquet")
    return res
