"""GenBank flat-file ingest as a Spark job (A3).

``spark.read.text(path, lineSep='\\n//\\n')`` yields one row per record, so
files of any size are split across tasks; every field is then a regular
expression over the record text (no per-record Python parser).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.tables import sample_metadata

RECORD_SEP = "\n//\n"


def _line_field(text: Column, key: str) -> Column:
    """Value of a top-level keyword line plus its 12-space continuation lines."""
    raw = F.regexp_extract(text, rf"(?m)^{key} +(.*(?:\n {{12}}.*)*)", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, r"\n {12}", " ")), F.lit(""))


def _qualifier(text: Column, name: str) -> Column:
    """First ``/name="value"`` of the record (the source feature comes first)."""
    raw = F.regexp_extract(text, rf'/{name}="([^"]*)"', 1)
    return F.nullif(F.trim(F.regexp_replace(raw, r"\s*\n\s+", " ")), F.lit(""))


def parse_records(records: DataFrame, text_col: str = "value") -> DataFrame:
    """Record text -> sample_id, description, organism, source, genotype,
    country, host, collection_date, sequence."""
    t = F.col(text_col)
    version = F.regexp_extract(t, r"(?m)^VERSION +(\S+)", 1)
    accession = F.regexp_extract(t, r"(?m)^ACCESSION +(\S+)", 1)
    definition = _line_field(t, "DEFINITION")
    origin = F.regexp_extract(t, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    seq = F.upper(F.regexp_replace(origin, r"[0-9\s/]", ""))
    return records.select(
        F.coalesce(F.nullif(version, F.lit("")), F.nullif(accession, F.lit(""))).alias("sample_id"),
        F.regexp_replace(definition, r"\.$", "").alias("description"),
        F.nullif(F.regexp_extract(t, r"(?m)^  ORGANISM +(.*)$", 1), F.lit("")).alias("organism"),
        _line_field(t, "SOURCE").alias("source"),
        _qualifier(t, "genotype").alias("genotype"),
        _qualifier(t, "country").alias("country"),
        _qualifier(t, "host").alias("host"),
        _qualifier(t, "collection_date").alias("collection_date"),
        F.nullif(seq, F.lit("")).alias("sequence"),
    ).where(F.col("sample_id").isNotNull() & (F.col("sample_id") != ""))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Parsed records of every GenBank file under ``path``."""
    recs = spark.read.option("lineSep", RECORD_SEP).text(path)
    recs = recs.where(F.col("value").contains("LOCUS"))
    return parse_records(recs)


def genbank_metadata(records: DataFrame, year_mode: str = "last4") -> DataFrame:
    """Metadata table (serotype inferred from description, organism, source)."""
    return sample_metadata(records, year_mode=year_mode)


def render_records(df: DataFrame) -> DataFrame:
    """Format ``sample_id, description, genotype, country, host,
    collection_date, sequence`` rows as GenBank text (60 bases per line)."""
    def q(name):
        return F.when(F.col(name).isNotNull(),
                      F.concat(F.lit(f'                     /{name}="'), F.col(name), F.lit('"\n'))).otherwise(F.lit(""))

    seq = F.lower(F.coalesce(F.col("sequence"), F.lit("")))
    n = F.length(seq)
    # cut into 60-base lines with one linear regex pass (substring offsets into
    # a long UTF-8 string would rescan it from the start for every line)
    lines = F.split(F.regexp_replace(seq, "(.{60})", "$1\n"), "\n")
    lines = F.filter(lines, lambda l, i: (l != "") | (i == 0))
    fmt = F.transform(lines, lambda l, i: F.concat(
        F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.regexp_replace(l, "(.{10})(?=.)", "$1 ")))
    origin = F.array_join(fmt, "\n")
    text = F.concat(
        F.lit("LOCUS       "), F.col("sample_id"), F.lit(" "), n.cast("string"), F.lit(" bp    RNA     linear   VRL\n"),
        F.lit("DEFINITION  "), F.col("description"), F.lit(".\n"),
        F.lit("ACCESSION   "), F.col("sample_id"), F.lit("\n"),
        F.lit("VERSION     "), F.col("sample_id"), F.lit(".1\n"),
        F.lit("SOURCE      Dengue virus\n  ORGANISM  Dengue virus\n            Viruses; Riboviria.\n"),
        F.lit("FEATURES             Location/Qualifiers\n     source          1.."), n.cast("string"), F.lit("\n"),
        q("genotype"), q("country"), q("host"), q("collection_date"),
        F.lit("ORIGIN      \n"), origin, F.lit("\n"))
    return df.select(text.alias("value"))
