"""Acquisition outputs as DataFrames: metadata, QC'd sequences, mutation
proxy, label table, inference-time mutation defaults (A4, B2, B7, B8, B9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.sequence import infer_serotype, is_complete, year_from_date

REFERENCE_LENGTH = 10700  # fixed value: reference genome length for the proxy
MIN_LENGTH = 9000          # fixed value: QC minimum length


def sample_metadata(records: DataFrame, year_mode: str = "last4",
                    serotype_from: list[str] | None = None) -> DataFrame:
    """``sample_id, description, serotype, genotype, country, year, host,
    genome_length, is_complete`` from parsed records.

    ``serotype`` is inferred from the text columns in ``serotype_from``
    (description, organism, source by default, those present).
    """
    cols = set(records.columns)
    src = [c for c in (serotype_from or ["description", "organism", "source"]) if c in cols]
    opt = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    year = year_from_date(F.col("collection_date"), year_mode) if "collection_date" in cols else opt("year")
    return records.select(
        "sample_id", "description",
        infer_serotype(*src).alias("serotype"),
        opt("genotype").alias("genotype"), opt("country").alias("country"),
        year.cast("string").alias("year"), opt("host").alias("host"),
        F.coalesce(F.length("sequence"), F.lit(0)).alias("genome_length"),
        is_complete(F.col("description")).alias("is_complete"))


def qc_sequences(records: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Keep records whose sequence is present and at least ``min_length`` long."""
    return (records.where(F.col("sequence").isNotNull() & (F.length("sequence") >= min_length))
                   .select("sample_id", "sequence"))


def qc_report(records: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row: kept and skipped record counts."""
    ok = F.col("sequence").isNotNull() & (F.length("sequence") >= min_length)
    return records.agg(F.count_if(ok).alias("kept"),
                       F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))


def mutation_profile(seqs: DataFrame, reference_length: int = REFERENCE_LENGTH) -> DataFrame:
    """Length-based proxy: ``length_diff`` and ``mutation_density``."""
    n = F.length("sequence")
    return seqs.select("sample_id", (n - F.lit(reference_length)).alias("length_diff"),
                       (F.abs(n - F.lit(reference_length)).cast("double")
                        / F.lit(float(reference_length))).alias("mutation_density"))


def label_table(metadata: DataFrame) -> DataFrame:
    return metadata.select("sample_id", "serotype", "genotype",
                           F.col("genotype").isNotNull().alias("known_genotype"))


def add_mutation_defaults(df: DataFrame, reference_length: int | None = None) -> DataFrame:
    """Add ``mutation_density`` 0.0, ``total_mutations`` 0 and ``length_diff``
    (genome_length - reference, or 0) only where absent."""
    out = df
    if "mutation_density" not in df.columns:
        out = out.withColumn("mutation_density", F.lit(0.0))
    if "total_mutations" not in df.columns:
        out = out.withColumn("total_mutations", F.lit(0).cast("long"))
    if "length_diff" not in df.columns:
        ld = (F.col("genome_length") - F.lit(reference_length)) if reference_length is not None else F.lit(0)
        out = out.withColumn("length_diff", ld.cast("long"))
    return out
