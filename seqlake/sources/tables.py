"""Table-set and input loading, writers.

Schemas are explicit (no inference pass over the data); the wide feature
table's column list is read from its header line only.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

TABLE_FILES = {
    "metadata": "sample_metadata",
    "sequence_features": "sequence_features",
    "mutation_profile": "mutation_profile",
    "labels": "label_table",
    "protein_level_features": "protein_level_features",
}

SCHEMAS = {
    "metadata": "sample_id string, description string, serotype string, genotype string, country string, "
                "year string, host string, genome_length int, is_complete boolean",
    "mutation_profile": "sample_id string, length_diff int, mutation_density double",
    "labels": "sample_id string, serotype string, genotype string, known_genotype boolean",
    "raw_sequences": "sample_id string, sequence string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _header_schema(spark: SparkSession, path: str) -> T.StructType:
    """sample_id string + every other header column as double (one line read)."""
    header = spark.read.text(path).first()[0]
    cols = [c.strip().strip('"') for c in header.split(",")]
    return T.StructType([T.StructField(c, T.StringType() if c == "sample_id" else T.DoubleType()) for c in cols])


def read_table(spark: SparkSession, path: str, name: str | None = None, fmt: str = "csv") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    schema = SCHEMAS.get(name) if name else None
    if schema is None:
        schema = _header_schema(spark, path)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def load_table_set(spark: SparkSession, directory: str, fmt: str = "csv") -> dict[str, DataFrame | None]:
    """All known tables of a directory; a missing file only warns (-> None)."""
    out = {}
    for key, stem in TABLE_FILES.items():
        path = f"{directory.rstrip('/')}/{stem}.{'csv' if fmt == 'csv' else 'parquet'}"
        if _exists(spark, path):
            out[key] = read_table(spark, path, key, fmt)
        else:
            log.warning("File %s not found!", path)
            out[key] = None
    return out


def load_input(spark: SparkSession, source, fmt: str = "csv") -> DataFrame:
    """A2: a path (CSV with header, or parquet) or an existing DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if fmt == "parquet":
        return spark.read.parquet(source)
    return spark.read.option("header", True).option("inferSchema", False).csv(source)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a table (parquet by default, CSV with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def with_nan_as_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; Spark's NaN is a value. Map it to null."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
