"""Embedding near-duplicates: p-stable (Gaussian) projections bucket unit vectors, an exact cosine decides.

Each of ``TABLES`` tables keys a vector by ``HASHES`` values ``floor((a.x + b) / WIDTH)``.
At cosine 0.9 two vectors are 0.447 apart, one value agrees with probability 0.82, a
table with 0.21, some table of 12 with 0.94; closer pairs more often.

Equal vectors are one class, so copies are never paired. A bucket is cut into blocks of
``BLOCK`` classes by a seeded hash and the block pairs are spread over tasks,
each comparing two blocks at most; only pairs that reach the threshold leave.

Edge cases: null, zero-length or all-zero vectors and those with null or non-finite
components link with nothing; vectors of different lengths never link; repeated rows are
linked copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.components import components
from seqlake.session import materialize

THRESHOLD, TABLES, HASHES, WIDTH, SEED, BLOCK = 0.9, 12, 8, 2.0, 42, 512


def _unit(column) -> tuple[list, list]:
    """``(class key or None, unit vector or None)`` per row, in double precision."""
    keys, units = [], []
    for v in column:
        x = np.array([np.nan if e is None else e for e in v], dtype=np.float64) if v is not None else np.zeros(0)
        top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
        if not top:
            keys.append(None)
            units.append(None)
            continue
        x = x / top
        x = x / np.sqrt((x * x).sum()) + 0.0
        keys.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True))
        units.append(x)
    return keys, units


def _classes(rows: DataFrame, id_type: str) -> DataFrame:
    def batches(it):
        for batch in it:
            keys, units = _unit(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(units, pa.list_(pa.float64()))],
                                             names=["vec_id", "c", "unit"])

    return rows.mapInArrow(batches, f"vec_id {id_type}, c long, unit array<double>")


def _buckets(classes: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """``c, unit, t, bucket``: one row per class and table, without the vector."""

    def batches(it):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            c, units = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_size.setdefault(len(u), []).append(i)
            for d, at in by_size.items():
                if d not in planes:
                    rng = np.random.default_rng((seed, d))
                    planes[d] = rng.standard_normal((d, tables * hashes)), rng.random(tables * hashes) * width
                a, b = planes[d]
                x = np.array([units[i] for i in at])
                q = np.floor((x @ a + b) / width).astype(np.int16).reshape(len(at), tables, hashes)
                ids = np.array([c[i] for i in at], np.int64)
                keys = [hashlib.blake2b(q[i, t].tobytes() + bytes([t]) + d.to_bytes(4, "big"), digest_size=8).digest()
                        for i in range(len(at)) for t in range(tables)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, tables)), pa.array(np.frombuffer(b"".join(keys), np.int64))], names=["c", "bucket"])

    return classes.select("c", "unit").mapInArrow(batches, "c long, bucket long")


def near_links(classes: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES,
               width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """Linked class pairs ``a < b`` of ``classes(c, unit)``."""
    placed = materialize(_buckets(classes, tables, hashes, width, seed), "pstable-buckets")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    placed = placed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("c", "bucket"), F.col("blocks")))
    # every block meets every other block of its bucket, and itself, in one task's group
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("c", "bucket", "block", other).select(
        "c", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.join(classes.select("c", "unit"), "c")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        left, right = pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]
        out_a, out_b = [], []
        if len(left) and len(right):
            y, yc = np.array(right["unit"].tolist()), right["c"].to_numpy()
            for s in range(0, len(left), 1024):
                part = left.iloc[s:s + 1024]
                xc = part["c"].to_numpy()
                i, j = np.nonzero(np.array(part["unit"].tolist()) @ y.T >= threshold)
                keep = xc[i] < yc[j] if lo == hi else xc[i] != yc[j]
                out_a.append(np.minimum(xc[i], yc[j])[keep])
                out_b.append(np.maximum(xc[i], yc[j])[keep])
        cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
        return pd.DataFrame({"a": cat(out_a), "b": cat(out_b)})

    return dealt.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(vectors: DataFrame, column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row; copies of a vector count as links of each other."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(_classes(vectors.select(vectors["vec_id"], vectors[column]), id_type), "pstable-rows")
    classes = rows.filter("c is not null").groupBy("c").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "pstable-classes")
    links = materialize(near_links(classes, threshold), "pstable-links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("c").alias("b"), "copies")
    degree = both.join(size, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    comp = components(links)
    per = classes.select("c", "copies").join(degree, F.col("c") == F.col("a"), "left").join(
        comp, F.col("c") == F.col("node"), "left")
    per = per.select(F.col("c").alias("k"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "c").alias("g"))
    m = rows.select("vec_id", "c").join(per, F.col("c") == F.col("k"), "left")
    lows = m.filter("g is not null").groupBy(F.col("g").alias("low_g")).agg(F.min("vec_id").alias("low"))
    m = m.join(lows, F.col("g") == F.col("low_g"), "left")
    low = F.coalesce("low", "vec_id")
    return m.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), low.alias("component_id"),
                    F.col("vec_id").eqNullSafe(low).alias("kept"))
