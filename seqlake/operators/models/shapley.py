"""Sampled Shapley attributions (H2) as one Spark job.

For every explained row x (a bounded hash sample) and permutation j, a
background row b_j is taken and features are switched from b_j to x in the
permutation's order; the change in the model output at each switch is that
feature's marginal contribution. All coalition vectors are generated by a
``mapInPandas`` stage, scored by one ``model.transform``, and differenced
with a lag over (row, permutation) groups of d+1 rows; contributions are
averaged per (row, feature). For each row the attributions sum to the mean of
f(x) - f(b_j) over its permutations.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.ids import dense_index


def sampled_shapley(classifier, rows: DataFrame, background: DataFrame, id_col: str = "sample_id",
                    n_permutations: int = 16, class_index: int = 0, seed: int = 42) -> DataFrame:
    """``id_col, feature, attribution`` for P(class ``class_index``).

    Background rows are numbered in content-hash order; the permutations of a row start at a
    place given by the row's hash and take the background rows that follow, so all of
    them take part over the rows, and neither side passes through the driver.
    """
    from seqlake.functions.sequence import to_numeric

    feats = list(classifier.features)
    d = len(feats)
    num = lambda df, keep: df.select(*keep, F.array(*[to_numeric(F.col(c)) for c in feats]).alias("_x"))
    bg = dense_index(num(background, []).withColumn("_hash", F.xxhash64("_x")), order_by=["_hash"], col="_bi", start=0)
    size = bg.count()
    if not size:
        raise ValueError("empty background")
    x = num(rows, [id_col]).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    x = x.withColumn("_bi", F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)) + F.col("_j"), F.lit(size)))
    x = x.join(bg.select("_bi", F.col("_x").alias("_z")), "_bi").drop("_bi")
    id_type = rows.schema[id_col].dataType.simpleString()

    def coalitions(batches):
        for pdf in batches:
            out_id, out_j, out_k, out_f, out_v = [], [], [], [], []
            for rid, xv, zv, j in zip(pdf[id_col], pdf["_x"], pdf["_z"], pdf["_j"]):
                key = zlib.crc32(f"{rid}|{int(j)}|{seed}".encode())  # stable across processes
                rng = np.random.default_rng([seed, int(j), key])
                perm = rng.permutation(d)
                z = np.array(zv, np.float64)
                xv = np.asarray(xv, np.float64)
                out_id.append(rid); out_j.append(j); out_k.append(0); out_f.append(-1); out_v.append(z.copy())  # noqa: E702
                for k, f in enumerate(perm, start=1):
                    z[f] = xv[f]
                    out_id.append(rid); out_j.append(j); out_k.append(k); out_f.append(int(f)); out_v.append(z.copy())  # noqa: E702
            yield pd.DataFrame({id_col: out_id, "_j": out_j, "_k": out_k, "_f": out_f,
                                "_v": [v.tolist() for v in out_v]})

    co = x.mapInPandas(coalitions, f"`{id_col}` {id_type}, _j int, _k int, _f int, _v array<double>")
    wide = co.select(id_col, "_j", "_k", "_f", *[F.col("_v")[i].alias(c) for i, c in enumerate(feats)])
    pred = classifier.model.transform(wide)
    pcol = "probability" if "probability" in pred.columns else "rawPrediction"
    p = pred.select(id_col, "_j", "_k", "_f", vector_to_array(pcol)[class_index].alias("_p"))
    w = Window.partitionBy(id_col, "_j").orderBy("_k")
    delta = p.withColumn("_d", F.col("_p") - F.lag("_p").over(w)).where(F.col("_k") > 0)
    names = F.element_at(F.array(*[F.lit(c) for c in feats]), F.col("_f") + 1)
    return delta.groupBy(id_col, names.alias("feature")).agg(
        (F.sum("_d") / F.lit(float(n_permutations))).alias("attribution"))
