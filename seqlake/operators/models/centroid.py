"""Centroid-distance open-set detector (F9): mean vector of the training rows,
distance of each row to it, 95th-percentile threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.operators.models.threshold import flag, percentile_threshold
from seqlake.operators.vectors import distance, mean_vector

METHODS = ("euclidean", "cosine", "manhattan")


@dataclass
class CentroidDetector:
    centroid: list[float]
    method: str = "euclidean"
    threshold: float | None = None

    def score(self, df: DataFrame, vec_col: str = "features", out_col: str = "score") -> DataFrame:
        return df.withColumn(out_col, distance(vec_col, self.centroid, self.method))

    def predict(self, df: DataFrame, vec_col: str = "features", threshold: float | None = None,
                out_col: str = "is_novel") -> DataFrame:
        t = self.threshold if threshold is None else threshold
        return flag(self.score(df, vec_col), "score", t, out_col)


def fit_centroid(train: DataFrame, vec_col: str = "features", method: str = "euclidean",
                 percentile: float = 95.0) -> CentroidDetector:
    if method not in METHODS:
        raise ValueError(f"Unknown distance method: {method}")
    det = CentroidDetector(mean_vector(train, vec_col), method)
    det.threshold = percentile_threshold(det.score(train, vec_col), "score", percentile)
    return det
