"""Percentile thresholds and strict-greater flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.quantiles import quantiles


def percentile_threshold(df: DataFrame, score_col: str, percentile: float = 95.0,
                         mode: str = "exact", accuracy: int = 1_000_000) -> float:
    """Linear-interpolated percentile of the scores.

    ``exact`` narrows to the wanted rank in bounded memory (:mod:`seqlake.operators.quantiles`);
    ``approx`` is one pass of a sketch, not interpolated.
    """
    p = percentile / 100.0
    if mode == "exact":
        found = quantiles(df, [score_col], [p])[0]
        v = found[0] if found else None
    else:
        v = df.select(F.percentile_approx(F.col(score_col).cast("double"), F.lit(p), accuracy).alias("t")).first()["t"]
    if v is None:
        raise ValueError("no scores to threshold")
    return float(v)


def flag(df: DataFrame, score_col: str, threshold: float | None, out_col: str = "is_novel") -> DataFrame:
    """``score > threshold`` (strict). ``threshold`` must be set (0 is a valid value)."""
    if threshold is None:
        raise ValueError("Threshold not set!")
    return df.withColumn(out_col, F.col(score_col) > F.lit(float(threshold)))
