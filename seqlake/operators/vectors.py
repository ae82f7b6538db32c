"""Vector helpers on ``array<double>`` columns (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double_array(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def columns_to_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def mean_vector(df: DataFrame, vec_col: str) -> list[float]:
    """Element-wise mean of one partial-aggregated pass; the result has one value per dimension."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.transform(vec_col, lambda x: x.cast("double")))
    row = df.where(F.col(vec_col).isNotNull()).select(Summarizer.mean(v).alias("m")).first()
    return [float(x) for x in row["m"]] if row and row["m"] is not None else []


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def distance(vec_col, center, method: str = "euclidean") -> Column:
    """Distance of every row's vector to a fixed ``center``."""
    v = F.col(vec_col) if isinstance(vec_col, str) else vec_col
    c = _lit_array(center)
    zero = F.lit(0.0)
    if method == "euclidean":
        sq = F.zip_with(v, c, lambda a, b: (a - b) * (a - b))
        return F.sqrt(F.aggregate(sq, zero, lambda acc, x: acc + x))
    if method == "manhattan":
        ab = F.zip_with(v, c, lambda a, b: F.abs(a - b))
        return F.aggregate(ab, zero, lambda acc, x: acc + x)
    if method == "cosine":
        dot = F.aggregate(F.zip_with(v, c, lambda a, b: a * b), zero, lambda acc, x: acc + x)
        nv = F.sqrt(F.aggregate(v, zero, lambda acc, x: acc + x * x))
        nc = float(sum(float(x) * float(x) for x in center)) ** 0.5
        sim = F.when((nv > 0) & F.lit(nc > 0), dot / (nv * F.lit(nc))).otherwise(F.lit(0.0))
        return F.least(F.greatest(F.lit(1.0) - sim, F.lit(0.0)), F.lit(2.0))
    raise ValueError(f"Unknown distance method: {method}")
