"""One-hot features for any number of levels, held sparse.

The levels of all categorical columns come from one grouped count and are numbered
densely in (column, level) order by a range sort, so no level list reaches the driver. The
level table is a stored table; rows find their positions by joining it, broadcast
only where its measured bytes allow. As in the dense form the first sorted
level of a column has no position, and a null or unseen value sets none.

A row's features are its numeric values, standardised, followed by one slot per
remaining level. A slot's value is 1 / std of its 0/1 column (population std, from the
level's count); its mean is not subtracted, which would fill every slot. Trees split alike either
way, and ``offset`` in the level table holds the shift for those who need it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.sequence import to_numeric
from seqlake.operators.features import ScalerModel, fit_scaler
from seqlake.operators.ids import dense_index
from seqlake.session import materialize

BROADCAST_BYTES = 64 << 20
NUMERIC, ACTIVE, VALUES = "_numeric", "_active", "_values"


@dataclass
class SparseEncoder:
    """Fitted state: scaler of the numeric columns, level table ``column, level, n, pos, value, offset``."""

    numeric: list[str]
    categorical: list[str]
    scaler: ScalerModel
    levels: DataFrame
    size: int
    level_bytes: dict[str, int]

    def _places(self, column: str, i: int) -> DataFrame:
        rows = self.levels.where((F.col("column") == column) & F.col("pos").isNotNull())
        rows = rows.select(F.col("level").alias(f"_l{i}"), F.col("pos").alias(f"_p{i}"), F.col("value").alias(f"_v{i}"))
        return F.broadcast(rows) if self.level_bytes.get(column, 0) <= BROADCAST_BYTES else rows

    def parts(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns, ``_numeric array<double>`` (scaled), ``_active array<int>`` and ``_values array<double>``."""
        have = set(df.columns)
        keep = [c for c in (keep or []) if c in have]
        inputs = {c: to_numeric(named(c)) if c in have else F.lit(0.0) for c in self.scaler.features}
        number = F.array(*self.scaler.exprs(inputs)) if self.numeric else F.array().cast("array<double>")
        used = [c for c in self.categorical if c in have]
        cur = df.select(*keep, number.alias(NUMERIC), *[level_text(named(c), df.schema[c].dataType).alias(f"_c{i}") for i, c in enumerate(used)])
        for i, c in enumerate(used):
            cur = cur.join(self._places(c, i), F.col(f"_c{i}") == F.col(f"_l{i}"), "left")
        pick = lambda p, kind: (F.array_compact(F.array(*[F.col(f"{p}{i}") for i in range(len(used))])) if used
                                else F.array()).cast(kind)
        return cur.select(*keep, NUMERIC, pick("_p", "array<int>").alias(ACTIVE), pick("_v", "array<double>").alias(VALUES))

    def vectors(self, df: DataFrame, keep: list[str] | None = None, out_col: str = "features") -> DataFrame:
        """``keep`` columns and a ``SparseVector`` column for any ``pyspark.ml`` estimator."""
        return to_vectors(self.parts(df, keep), self.size, out_col)

    def names(self) -> DataFrame:
        """``pos, feature, source, level`` of every slot, numeric ones first."""
        spark = self.levels.sparkSession
        first = spark.createDataFrame([(i, c, c, None) for i, c in enumerate(self.numeric)], "pos int, feature string, source string, level string")
        rest = self.levels.where("pos is not null").select(
            "pos", F.concat_ws("_", "column", "level").alias("feature"), F.col("column").alias("source"), "level")
        return first.unionByName(rest)

    def save(self, path: str) -> None:
        from seqlake.sources.persist import save_json

        spark = self.levels.sparkSession
        self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        save_json(spark, {"numeric": self.numeric, "categorical": self.categorical, "size": self.size, "level_bytes": self.level_bytes,
                          "scaler": json.loads(self.scaler.to_json())}, f"{path}/params")

    @staticmethod
    def load(spark, path: str) -> "SparseEncoder":
        from seqlake.sources.persist import load_json

        p = load_json(spark, f"{path}/params")
        return SparseEncoder(p["numeric"], p["categorical"], ScalerModel.from_json(json.dumps(p["scaler"])),
                             spark.read.parquet(f"{path}/levels"), p["size"], p["level_bytes"])


def named(column: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def level_text(col: Column, kind: T.DataType) -> Column:
    """Level name of a value: booleans as in the column names of the dense form."""
    if isinstance(kind, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    return col.cast("string")


def level_table(df: DataFrame, columns: list[str], first_slot: int) -> DataFrame:
    """``column, level, n, pos, value, offset``: counted levels with their slot, null for each column's first."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), level_text(named(c), df.schema[c].dataType).alias("level"))
                                for i, c in enumerate(columns)])).alias("x")
    counts = df.select(cells).select("x.*").where("level is not null").groupBy("i", "column", "level").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(dense_index(counts, order_by=["i", "level"], col="at", start=0), "levels")
    firsts = placed.groupBy(F.col("i").alias("fi")).agg(F.min("at").alias("first"))  # one row per column
    placed = placed.join(F.broadcast(firsts), F.col("i") == F.col("fi"))
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("n") / total
    std = F.sqrt(share * (1 - share))
    std = F.when(std > 0, std).otherwise(1.0)
    held = F.col("at") > F.col("first")
    return placed.select("column", "level", "n", F.when(held, F.col("at") - F.col("i") - 1 + F.lit(first_slot)).cast("int").alias("pos"),
                         (1.0 / std).alias("value"), (-share / std).alias("offset"))


def fit_sparse(df: DataFrame, numeric: list[str], categorical: list[str]) -> SparseEncoder:
    """Count levels and fit the scaler on ``df`` (the training rows)."""
    places = [f"n{i}" for i in range(len(numeric))]
    scaler = ScalerModel([])
    if numeric:
        fitted = fit_scaler(df.select(*[to_numeric(named(c)).alias(p) for c, p in zip(numeric, places)]), places)
        scaler = ScalerModel(list(numeric), *[{c: d[p] for c, p in zip(numeric, places)} for d in (fitted.mean, fitted.std)])
    # a column without a value has no level and takes no slot
    present = categorical and df.agg(*[F.count(named(c)).alias(f"n{i}") for i, c in enumerate(categorical)]).first()
    categorical = [c for i, c in enumerate(categorical) if present[f"n{i}"]] if present else []
    if not categorical:
        empty = df.sparkSession.createDataFrame([], "column string, level string, n long, pos int, value double, offset double")
        return SparseEncoder(list(numeric), [], scaler, empty, len(numeric), {})
    levels = materialize(level_table(df, categorical, len(numeric)), "level-slots")
    per = levels.groupBy("column").agg(F.count("pos").alias("k"), F.sum(F.octet_length("level") + 48).alias("b")).collect()  # one row per column
    return SparseEncoder(list(numeric), categorical, scaler, levels, len(numeric) + sum(r["k"] for r in per),
                         {r["column"]: int(r["b"]) for r in per})


def to_vectors(parts: DataFrame, size: int, out_col: str = "features") -> DataFrame:
    """``SparseVector`` column from the parts, built batch by batch in Arrow; zeros are left out."""
    keep = [f for f in parts.schema.fields if f.name not in (NUMERIC, ACTIVE, VALUES)]
    schema = T.StructType([*keep, T.StructField(out_col, VectorUDT())])
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def build(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            m = batch.num_rows
            d = len(cols[NUMERIC][0]) if m else 0
            x = cols[NUMERIC].flatten().to_numpy(zero_copy_only=False).reshape(m, d)
            row, at = np.nonzero(x)
            act = cols[ACTIVE]
            rows = np.concatenate((row, np.repeat(np.arange(m), act.value_lengths().to_numpy(zero_copy_only=False))))
            idx = np.concatenate((at, act.flatten().to_numpy(zero_copy_only=False)))
            val = np.concatenate((x[row, at], cols[VALUES].flatten().to_numpy(zero_copy_only=False)))
            order = np.lexsort((idx, rows))
            ends = np.searchsorted(rows[order], np.arange(m + 1)).astype(np.int32)
            lists = lambda v, k: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[order], k))
            vec = pa.StructArray.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, size, np.int32)),
                                              lists(idx, pa.int32()), lists(val, pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*[cols[f.name] for f in keep], vec], names=[*[f.name for f in keep], out_col])

    return parts.mapInArrow(build, schema)
