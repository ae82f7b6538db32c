"""Pasted/uploaded multi-sequence text (A5).

Each line is ``id,sequence`` (split at the first comma) or a bare sequence
whose id is ``SAMPLE_%04d`` from its 1-based position among the non-blank
lines. Whitespace is stripped, sequences are uppercased, empty ones dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.ids import dense_index

_WS = r"^\s+|\s+$"


def parse_lines(lines: DataFrame, line_col: str = "line", index_col: str = "line_no") -> DataFrame:
    """Parse already numbered non-blank lines into ``sample_id, sequence``."""
    line = F.col(line_col)
    has_comma = F.instr(line, ",") > 0
    rest = F.substring_index(line, ",", 1)
    sid = F.when(has_comma, F.regexp_replace(rest, _WS, "")).otherwise(
        F.format_string("SAMPLE_%04d", F.col(index_col)))
    raw = F.when(has_comma, F.expr(f"substring({line_col}, instr({line_col}, ',') + 1)")).otherwise(line)
    seq = F.upper(F.regexp_replace(raw, r"\s+", ""))
    out = lines.withColumn("sample_id", sid).withColumn("sequence", seq)
    return out.where(F.length("sequence") > 0).withColumn("length", F.length("sequence"))


def parse_sequence_lines(df: DataFrame, text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """Every row's text is one pasted input: lines numbered per row (no shuffle)."""
    stripped = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.regexp_replace(x, _WS, "")),
                        lambda x: x != "")
    keep = [group_col] if group_col else []
    ex = df.select(*keep, F.posexplode(stripped).alias("_pos", "line"))
    ex = ex.withColumn("line_no", (F.col("_pos") + 1).cast("long")).drop("_pos")
    return parse_lines(ex).select(*keep, "line_no", "sample_id", "sequence", "length")


def read_sequence_file(spark, path: str) -> DataFrame:
    """A text file of sequence lines, numbered densely in file order.

    Line numbers come from per-partition offsets (no single-task window), so
    one large file is still read and parsed in parallel.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", _WS, "").alias("line"))
    lines = lines.where(F.col("line") != "")
    numbered = dense_index(lines, order_by=None, col="line_no", start=1)
    return parse_lines(numbered).select("line_no", "sample_id", "sequence", "length")
